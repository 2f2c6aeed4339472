"""Polygons and boxes as columns. A polygon is ``array<double>`` x0, y0, x1, y1, ...; a box is four columns or a struct
of x1, y1, x2, y2. Everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it: without this, nested builders would repeat
    their argument's expression tree at every use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def points(coords: Column) -> Column:
    """``array<struct<x, y>>`` of flat coordinates; a last odd value is left out."""
    return bound(coords, _points)


def _points(coords: Column) -> Column:
    n = F.floor(F.size(coords) / 2).cast("int")
    return F.when(n < 1, F.array().cast("array<struct<x:double,y:double>>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct(F.get(coords, 2 * i).cast("double").alias("x"), F.get(coords, 2 * i + 1).cast("double").alias("y")),
        )
    )


def polygon_area(coords: Column) -> Column:
    """Shoelace area. Fewer than three points have area 0."""
    return bound(coords, _polygon_area)


def _polygon_area(coords: Column) -> Column:
    n = F.floor(F.size(coords) / 2).cast("int")

    def term(i: Column) -> Column:
        j = (i + n - 1) % n
        return F.get(coords, 2 * i) * F.get(coords, 2 * j + 1) - F.get(coords, 2 * i + 1) * F.get(coords, 2 * j)

    folded = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, i: acc + term(i).cast("double"))
    return F.when(n >= 3, F.lit(0.5) * F.abs(folded)).otherwise(F.lit(0.0))


def label_area(coords: Column) -> Column:
    """Area of a label line's values: four are a box (width times height where the last two are under 1, else corners),
    fewer than six have none, others are a polygon."""
    c = [F.get(coords, i) for i in range(4)]
    box = F.when((c[2] < 1) & (c[3] < 1), c[2] * c[3]).otherwise((c[2] - c[0]) * (c[3] - c[1]))
    return F.when(F.size(coords) == 4, box).when(F.size(coords) < 6, F.lit(0.0)).otherwise(polygon_area(coords))


def scale(coords: Column, width: Column, height: Column) -> Column:
    """Coordinates times width (x) and height (y)."""
    return F.transform(coords, lambda c, i: F.when(i % 2 == 0, c * width).otherwise(c * height))


def pixel_area(coords: Column, width: Column, height: Column) -> Column:
    """Points are scaled before the area is taken, as rounding depends on the order."""
    return polygon_area(scale(coords, width, height))


def bbox(coords: Column) -> Column:
    """Smallest box around a polygon."""
    return bound(coords, _bbox)


def _bbox(coords: Column) -> Column:
    xs = F.filter(coords, lambda c, i: i % 2 == 0)
    ys = F.filter(coords, lambda c, i: i % 2 == 1)
    return F.struct(
        F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")
    )


def box_polygon(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The four corners of a box as a polygon."""
    return F.array(*[c.cast("double") for c in (x1, y1, x2, y1, x2, y2, x1, y2)])


def centre_to_corners(xc: Column, yc: Column, w: Column, h: Column) -> Column:
    return F.struct((xc - w / 2).alias("x1"), (yc - h / 2).alias("y1"), (xc + w / 2).alias("x2"), (yc + h / 2).alias("y2"))


def corners_to_xywh(box: Column) -> Column:
    return F.array(box["x1"], box["y1"], box["x2"] - box["x1"], box["y2"] - box["y1"])


def box_area(box: Column) -> Column:
    return (box["x2"] - box["x1"]) * (box["y2"] - box["y1"])


def intersection_area(a: Column, b: Column) -> Column:
    """0 for boxes that are apart or only touch."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def box_iou(a: Column, b: Column) -> Column:
    inter = intersection_area(a, b)
    union = box_area(a) + box_area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def within(a: Column, b: Column) -> Column:
    """Whether box a lies in box b; borders count."""
    return (a["x1"] >= b["x1"]) & (a["y1"] >= b["y1"]) & (a["x2"] <= b["x2"]) & (a["y2"] <= b["y2"])


def overlaps(a: Column, b: Column) -> Column:
    """Whether boxes meet; a touch counts."""
    return (a["x1"] <= b["x2"]) & (b["x1"] <= a["x2"]) & (a["y1"] <= b["y2"]) & (b["y1"] <= a["y2"])


def to_pixels(coords: Column, width: Column, height: Column) -> Column:
    """Scaled and rounded half to even."""
    return F.transform(scale(coords, width, height), lambda c: F.rint(c))


def to_tile(coords: Column, x0: Column, y0: Column, tile_w: Column, tile_h: Column) -> Column:
    """Pixels to fractions of a tile; the far edge is exactly 1."""

    def one(c: Column, i: Column) -> Column:
        start = F.when(i % 2 == 0, x0).otherwise(y0)
        size = F.when(i % 2 == 0, tile_w).otherwise(tile_h)
        return F.when(c == start + size, F.lit(1.0)).otherwise((c - start) / size)

    return F.transform(coords, one)


def clip(coords: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """``array<struct<x, y>>``: the polygon cut to a rectangle, one half-plane after the other. Parts of a concave
    polygon stay joined by edges of no area, so the area is exact."""

    none = F.array().cast("array<struct<x:double,y:double>>")

    def half(ring: Column, axis: str, limit: Column, keep_less: bool) -> Column:
        def inside(p: Column) -> Column:
            return p[axis] <= limit if keep_less else p[axis] >= limit

        def crossing(p: Column, q: Column) -> Column:
            t = (limit - p[axis]) / (q[axis] - p[axis])
            x = limit if axis == "x" else p["x"] + t * (q["x"] - p["x"])
            y = limit if axis == "y" else p["y"] + t * (q["y"] - p["y"])
            return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

        def edge(e: Column) -> Column:
            p, q = e["p"], e["q"]
            return (
                F.when(inside(q) & inside(p), F.array(q))
                .when(inside(q), F.array(crossing(p, q), q))
                .when(inside(p), F.array(crossing(p, q)))
                .otherwise(none)
            )

        def cut(r: Column) -> Column:
            n = F.size(r)
            edges = F.transform(r, lambda q, i: F.struct(F.get(r, (i + n - 1) % n).alias("p"), q.alias("q")))
            return F.flatten(F.transform(edges, edge))

        return bound(ring, cut)

    ring = points(coords)
    for axis, limit, less in (("x", x0, False), ("x", x1, True), ("y", y0, False), ("y", y1, True)):
        ring = half(ring, axis, limit, less)
    return ring


def flat(ring: Column) -> Column:
    """Points back to flat coordinates."""
    return F.flatten(F.transform(ring, lambda p: F.array(p["x"], p["y"])))


def clipped_area(coords: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return polygon_area(flat(clip(coords, x0, y0, x1, y1)))


def centroid(coords: Column) -> Column:
    """Centre of area; the middle of the box where the area is 0."""
    return bound(coords, _centroid)


def _centroid(coords: Column) -> Column:
    n = F.floor(F.size(coords) / 2).cast("int")
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(acc: Column, i: Column) -> Column:
        j = (i + 1) % n
        xi, yi, xj, yj = (F.get(coords, k).cast("double") for k in (2 * i, 2 * i + 1, 2 * j, 2 * j + 1))
        cross = xi * yj - xj * yi
        return F.struct(
            (acc["a"] + cross).alias("a"), (acc["x"] + (xi + xj) * cross).alias("x"), (acc["y"] + (yi + yj) * cross).alias("y")
        )

    total = F.aggregate(F.sequence(F.lit(0), n - 1), zero, add)

    def centre(v: Column) -> Column:
        sums, box = v["sums"], v["box"]
        usable = (n >= 3) & (sums["a"] != 0)
        return F.struct(
            F.when(usable, sums["x"] / (3 * sums["a"])).otherwise((box["x1"] + box["x2"]) / 2).alias("x"),
            F.when(usable, sums["y"] / (3 * sums["a"])).otherwise((box["y1"] + box["y2"]) / 2).alias("y"),
        )

    return bound(F.struct(total.alias("sums"), bbox(coords).alias("box")), centre)


def affine(coords: Column, matrix: list[list[float]]) -> Column:
    """Points under a 3 x 3 matrix, divided by the third coordinate."""
    (a, b, c), (d, e, f), (g, h, i) = matrix

    def one(p: Column) -> Column:
        w = g * p["x"] + h * p["y"] + i
        return F.array((a * p["x"] + b * p["y"] + c) / w, (d * p["x"] + e * p["y"] + f) / w)

    return F.flatten(F.transform(points(coords), one))


def is_simple(coords: Column) -> Column:
    """Whether no two edges that aren't neighbours cross or touch."""
    return bound(points(coords), _is_simple)


def _is_simple(p: Column) -> Column:
    n = F.size(p)

    def turn(a: Column, b: Column, c: Column) -> Column:
        return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))

    def at(i: Column) -> Column:
        return F.get(p, i % n)

    def cross(i: Column, j: Column) -> Column:
        a, b, c, d = at(i), at(i + 1), at(j), at(j + 1)
        # edges on one line have no turns; they meet only if their extents do
        near = [F.greatest(a[x], b[x]) >= F.least(c[x], d[x]) for x in "xy"] + [F.greatest(c[x], d[x]) >= F.least(a[x], b[x]) for x in "xy"]
        return near[0] & near[1] & near[2] & near[3] & (turn(a, b, c) * turn(a, b, d) <= 0) & (turn(c, d, a) * turn(c, d, b) <= 0)

    indexes = F.sequence(F.lit(0), n - 1)
    apart = lambda i, j: (j > i + 1) & ~((i == 0) & (j == n - 1))
    return (n >= 3) & ~F.exists(indexes, lambda i: F.exists(indexes, lambda j: apart(i, j) & cross(i, j)))


def overlap_area(a: Column, b: Column) -> Column:
    """Area that two simple polygons (flat coordinates) share, exact but for rounding, convex or not.

    A polygon is the signed sum of the strips between its edges and a base line below both; two strips share what lies
    below the lower of their edges over their common width, which is one or two trapezoids.
    """

    def edges(coords: Column) -> Column:
        def one(p: Column) -> Column:
            n = F.size(p)
            pairs = F.transform(p, lambda u, i: F.struct(u.alias("u"), F.get(p, (i + 1) % n).alias("v")))

            def turned(e: Column) -> Column:
                on = e["u"]["x"] <= e["v"]["x"]
                first, last = F.when(on, e["u"]).otherwise(e["v"]), F.when(on, e["v"]).otherwise(e["u"])
                steep = (e["v"]["y"] - e["u"]["y"]) / (e["v"]["x"] - e["u"]["x"])
                return F.struct(
                    first["x"].alias("x0"), last["x"].alias("x1"), first["y"].alias("y0"), steep.alias("k"), F.when(on, 1.0).otherwise(-1.0).alias("s")
                )

            return F.transform(F.filter(pairs, lambda e: e["u"]["x"] != e["v"]["x"]), turned)

        return bound(points(coords), one)

    def shared(low: Column, e: Column, f: Column) -> Column:
        x0, x1 = F.greatest(e["x0"], f["x0"]), F.least(e["x1"], f["x1"])
        at = lambda g, x: g["y0"] + g["k"] * (x - g["x0"]) - low
        h = F.array(at(e, x0), at(f, x0), at(e, x1), at(f, x1))

        def strip(v: Column) -> Column:
            y, w = [F.get(v["h"], i) for i in range(4)], v["w"]
            d0, d1 = y[0] - y[1], y[2] - y[3]
            # the edges cross at a share t of the width
            t = d0 / (d0 - d1)
            middle = y[0] + t * (y[2] - y[0])
            m0, m1 = F.least(y[0], y[1]), F.least(y[2], y[3])
            return w * F.when(d0 * d1 < 0, (t * (m0 + middle) + (1 - t) * (middle + m1)) / 2).otherwise((m0 + m1) / 2)

        return F.when(x0 < x1, e["s"] * f["s"] * bound(F.struct(h.alias("h"), (x1 - x0).alias("w")), strip)).otherwise(0.0)

    def both(v: Column) -> Column:
        row = lambda acc, e: acc + F.aggregate(v["f"], F.lit(0.0), lambda a2, f: a2 + shared(v["low"], e, f))
        return F.abs(F.aggregate(v["e"], F.lit(0.0), row))

    low = F.least(bbox(a)["y1"], bbox(b)["y1"])
    return bound(F.struct(edges(a).alias("e"), edges(b).alias("f"), low.cast("double").alias("low")), both)


def polygon_iou(a: Column, b: Column) -> Column:
    inter = overlap_area(a, b)
    return bound(
        F.struct(inter.alias("i"), (polygon_area(a) + polygon_area(b)).alias("u")),
        lambda v: F.when((v["i"] > 0) & (v["u"] > v["i"]), v["i"] / (v["u"] - v["i"])).otherwise(F.lit(0.0)),
    )
