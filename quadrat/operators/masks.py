"""Masks as rows: polygons to run lengths by scan lines, run lengths to contours by successor joins.

Nothing is traced in a loop over an image. A polygon's scan lines and a mask's borders are rows; what follows what is a
join, and which ring a border belongs to, and at what place, are found by jumps of doubled length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrat.functions import geometry as G
from quadrat.session import stored


def polygon_runs(polygons: DataFrame, key: str, coords: str) -> DataFrame:
    """``key, left, top, width, height, runs`` of polygons with whole coordinates (flat ``array<double>``, as many as three
    points or not): the mask of the smallest box around the points, row by row, as run lengths that begin with zeros. A
    pixel belongs to the mask if its point lies inside (even-odd) or on an edge. Polygons without a point give no row."""
    ring = polygons.select(key, G.points(F.col(coords)).alias("_p")).where(F.size("_p") > 0)
    xs, ys = F.transform("_p", lambda p: p["x"].cast("long")), F.transform("_p", lambda p: p["y"].cast("long"))
    ends = {"left": F.array_min(xs), "top": F.array_min(ys), "right": F.array_max(xs), "bottom": F.array_max(ys)}
    box = F.struct(*[c.alias(name) for name, c in ends.items()])
    boxed = stored(ring.select(key, "_p", box.alias("_b")).select(key, "_p", "_b.*"))
    sides = F.transform("_p", lambda p, i: F.struct(p.alias("p"), F.get(F.col("_p"), (i + 1) % F.size("_p")).alias("q")))
    edges = boxed.select(key, F.explode(sides).alias("e")).select(key, *[F.col(f"e.{v}.{a}").alias(f"{v}{a}") for v in "pq" for a in "xy"])

    low, high = F.least("py", "qy").cast("long"), F.greatest("py", "qy").cast("long")
    lines = edges.where("py <> qy").select("*", F.explode(F.sequence(low, high)).alias("row"))
    x = F.col("px") + (F.col("row") - F.col("py")) * (F.col("qx") - F.col("px")) / (F.col("qy") - F.col("py"))
    lines = lines.withColumns({"x": F.when(F.col("row") == F.col("py"), F.col("px")).when(F.col("row") == F.col("qy"), F.col("qx")).otherwise(x), "inner": F.col("row") < high})
    crossed = lines.groupBy(key, "row").agg(F.array_sort(F.collect_list(F.when(F.col("inner"), F.col("x")))).alias("c"))
    span = lambda a, b: F.struct(F.ceil(a).alias("x0"), F.floor(b).alias("x1"))
    pairs = F.transform(F.filter(F.col("c"), lambda _, i: i % 2 == 0), lambda a, i: span(a, F.get("c", 2 * i + 1)))
    inside = crossed.select(key, "row", F.explode(pairs).alias("s"))
    on = lines.select(key, "row", span(F.col("x"), F.col("x")).alias("s"))
    flat = edges.where("py = qy").select(key, F.col("py").cast("long").alias("row"), span(F.least("px", "qx"), F.greatest("px", "qx")).alias("s"))
    spans = inside.unionByName(on).unionByName(flat).select(key, "row", "s.x0", "s.x1").where("x0 <= x1")

    frame = boxed.select(key, "left", "top", (F.col("right") - F.col("left") + 1).alias("width"), (F.col("bottom") - F.col("top") + 1).alias("height"))
    at = lambda c: (F.col("row") - F.col("top")) * F.col("width") + F.col(c) - F.col("left")
    placed = spans.join(frame, key).select(key, at("x0").alias("a"), (at("x1") + 1).alias("b"))
    order = Window.partitionBy(key).orderBy("a", "b")
    so_far = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = placed.withColumn("_new", (so_far.isNull() | (F.col("a") > so_far)).cast("int")).withColumn("_n", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ones = parts.groupBy(key, "_n").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    filled = ones.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("o"))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("o", i - 1)["b"])
    runs = F.flatten(F.transform("o", lambda s, i: F.array(s["a"] - before(i), s["b"] - s["a"])))
    rest = F.col("width") * F.col("height") - F.element_at("o", -1)["b"]
    whole = F.concat(runs, F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    return frame.join(filled, key).select(key, "left", "top", "width", "height", whole.alias("runs"))


def mask_pixels(masks: DataFrame, key: str, runs: str, width: str) -> DataFrame:
    """``key, x, y`` of the ones of masks given by run lengths."""
    upto = F.aggregate(F.slice(F.col("_r"), 1, F.col("_i") + 1), F.lit(0).cast("long"), lambda a, r: a + r)
    rows = masks.select(key, F.col(width).cast("long").alias("_w"), F.col(runs).cast("array<bigint>").alias("_r"))
    ones = rows.select(key, "_w", "_r", F.posexplode("_r").alias("_i", "_n")).where("_i % 2 = 1 AND _n > 0")
    at = ones.select(key, "_w", F.explode(F.sequence(upto - F.col("_n"), upto - 1)).alias("_at"))
    return at.select(key, (F.col("_at") % F.col("_w")).alias("x"), F.expr("_at div _w").alias("y"))


#: Sides of a pixel in the order in which its border is walked: down its left, right along its bottom, up its right, left
#: along its top; with the corners where they begin and end.
SIDES = (((0, 0), (0, 1)), ((0, 1), (1, 1)), ((1, 1), (1, 0)), ((1, 0), (0, 0)))


#: Bits of a coordinate in a side's number, which is y, x and which side it is.
_BITS = 30


def _y(at: str) -> Column:
    return F.shiftright(at, _BITS + 2)


def _x(at: str) -> Column:
    return F.shiftright(at, 2).bitwiseAND(F.lit((1 << _BITS) - 1))


def _side(at: str) -> Column:
    return F.col(at).bitwiseAND(F.lit(3))


def _borders(pixels: DataFrame, key: str) -> DataFrame:
    """``key, at, next``: the numbers of the sides between a pixel and the background, and of the ones that follow."""
    corner = lambda c: F.shiftleft(F.col("y") + c[1], _BITS) + F.col("x") + c[0]
    side = lambda i: F.struct(
        (F.shiftleft(F.shiftleft("y", _BITS) + F.col("x"), 2) + i).alias("at"), *[corner(c).alias(n) for n, c in zip(("begin", "end"), SIDES[i])]
    )
    all_sides = pixels.select(key, F.explode(F.array(*map(side, range(4)))).alias("s")).select(key, "s.*")
    # a side that two pixels have, once in each direction, is no border
    line = all_sides.groupBy(key, F.least("begin", "end").alias("_a"), F.greatest("begin", "end").alias("_b"))
    single = line.agg(F.count("*").alias("n"), F.first("at").alias("at"), F.first("begin").alias("begin"), F.first("end").alias("end"))
    single = stored(single.where("n = 1").select(key, "at", "begin", "end"))
    leaving = single.groupBy(key, F.col("begin").alias("end")).agg(F.collect_list("at").alias("_on"))  # two at most
    other = F.filter("_on", lambda s: F.shiftright(s, 2) != F.shiftright("at", 2))
    # where two pixels meet at a corner only, the walk goes over to the other one
    follows = F.when(F.size("_on") == 1, F.get("_on", F.lit(0))).otherwise(F.get(other, F.lit(0)))
    return single.join(leaving, [key, "end"]).select(key, "at", follows.alias("next"))


def _doubled(df: DataFrame, key: str, combine) -> DataFrame:
    """One round: each row with what ``combine`` makes of its value and that of the row that it points to, and with the
    pointer of that row."""
    there = df.select(key, F.col("at").alias("to"), F.col("to").alias("_to"), F.col("value").alias("_value"))
    return stored(df.join(there, [key, "to"]).select(key, "at", F.col("_to").alias("to"), combine(F.col("value"), F.col("_value")).alias("value")))


def _settled(df: DataFrame, key: str, combine) -> DataFrame:
    """Rounds until no value changes."""
    state = lambda d: d.agg(F.sum(F.xxhash64(key, "at", "value") % 1_000_000_007)).first()[0]
    now = state(df)
    while True:
        df = _doubled(df, key, combine)
        before, now = now, state(df)
        if now == before:
            return df


def contours(masks: DataFrame, key: str, runs: str, width: str, least: int = 3) -> DataFrame:
    """``key, y, x, points`` of the outer border of each part of a mask (pixels that touch by side or corner) that lies in
    no hole of another part: ``points`` are flat pixel coordinates, from the first pixel (x, y) of the part in reading
    order, down its left side; points in the middle of a straight or diagonal line are left out. Borders with fewer than
    ``least`` points go."""
    runs_of = stored(masks.select(key, runs, width))  # else their expression is computed again for each run
    borders = stored(_borders(mask_pixels(runs_of, key, runs, width), key))
    named = stored(borders.select(key, "at", F.col("next").alias("to"), F.least("at", "next").alias("value")))
    ring = _settled(named, key, F.least).select(key, "at", F.col("value").alias("ring"))
    # steps to the first side, where pointers stay
    first = lambda c: F.col(c) == F.col("ring")
    steps = borders.join(ring, [key, "at"])
    steps = stored(steps.select(key, "at", F.when(first("at"), F.col("at")).otherwise(F.col("next")).alias("to"), F.when(first("at"), 0).otherwise(1).cast("long").alias("value")))
    steps = _settled(steps, key, lambda a, b: a + b)
    placed = stored(steps.select(key, "at", (-F.col("value")).alias("place")).join(ring, [key, "at"]))

    # a ring is outer if it begins at the left of its first pixel; what stands left of that in the row tells where it lies
    rights = placed.where(_side("at") == 2).select(key, _y("at").alias("y"), _x("at").alias("x"), F.col("ring").alias("_left"))
    heads = placed.where((F.col("at") == F.col("ring")) & (_side("at") == 0)).select(key, _y("at").alias("y"), _x("at").alias("x"), "ring")
    row = Window.partitionBy(key, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    both = rights.join(heads, [key, "y", "x"], "full").withColumn("_by", F.last("_left", ignorenulls=True).over(row)).where("ring IS NOT NULL")
    known = both.select(key, F.col("ring").alias("at"), F.col("_by").alias("to"))
    status = stored(known.select(key, "at", "to", F.when(F.col("to").isNull(), 1).when(_side("to") != 0, 0).alias("value")))
    while not status.where("value IS NULL").isEmpty():
        there = status.select(key, F.col("at").alias("to"), F.col("to").alias("_to"), F.col("value").alias("_value"))
        joined = status.join(there, [key, "to"], "left")
        onward = F.when(F.col("value").isNull() & F.col("_value").isNull(), F.col("_to")).otherwise(F.col("to"))
        status = stored(joined.select(key, "at", onward.alias("to"), F.coalesce("value", "_value").alias("value")))
    outer = placed.join(status.where("value = 1").select(key, F.col("at").alias("ring")), [key, "ring"])

    around = Window.partitionBy(key, "ring").orderBy("place")
    whole = Window.partitionBy(key, "ring").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pixel = F.struct(_x("at").alias("x"), _y("at").alias("y"))

    def beside(c: str, shift: int) -> Column:
        """The value of the row before or after, around the ring."""
        return F.coalesce(F.lag(c, shift).over(around), (F.last(c) if shift > 0 else F.first(c)).over(whole))

    # the first side (place 0) comes last by place, as steps are counted towards it; it begins the ring
    chain = outer.withColumn("place", F.when(F.col("place") == 0, F.lit(-(1 << 60))).otherwise(F.col("place"))).withColumn("p", pixel)
    chain = chain.withColumn("_before", beside("p", 1)).where((F.col("p") != F.col("_before")) | (F.col("place") == -(1 << 60)))
    chain = chain.withColumns({"_b": beside("p", 1), "_a": beside("p", -1)})
    # the walk may come back to the first pixel before it reaches the first side
    chain = chain.where(~((F.col("place") > -(1 << 60)) & (F.col("p.x") == _x("ring")) & (F.col("p.y") == _y("ring")) & (F.col("_a") == F.col("p"))))
    chain = chain.withColumns({"_b": beside("p", 1), "_a": beside("p", -1)})
    turn = (F.col("p.x") - F.col("_b.x") != F.col("_a.x") - F.col("p.x")) | (F.col("p.y") - F.col("_b.y") != F.col("_a.y") - F.col("p.y"))
    points = chain.where(turn | (F.col("_b") == F.col("p"))).groupBy(key, "ring").agg(F.array_sort(F.collect_list(F.struct("place", "p"))).alias("_c"))
    flat = F.flatten(F.transform("_c", lambda c: F.array(c["p"]["x"], c["p"]["y"])))
    return points.where(F.size("_c") >= least).select(key, _y("ring").alias("y"), _x("ring").alias("x"), flat.alias("points"))
