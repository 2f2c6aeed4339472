"""Polygons cut to tiles in numpy, against the column builders that cut one after the other."""

import math
import random

from pyspark.sql import functions as F

from quadrat.functions import cuts
from quadrat.functions import geometry as G
from quadrat.functions import parts as P
from quadrat.operators import tiling

SMALL = tiling.Tiling(20, 16, 0.5, 0.5, 3.0, 0.1)


def polygons(seed):
    rng = random.Random(seed)
    out = []
    for k in range(240):
        cx, cy, n = rng.uniform(5, 70), rng.uniform(5, 60), rng.choice([3, 4, 4, 5, 8, 12, 30])
        r = rng.choice([3, 8, 25, 60])
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        reach = [r] * n if k % 2 else [r * rng.uniform(0.2, 1) for _ in range(n)]
        out.append([c for a, q in zip(turns, reach) for c in (cx + q * math.cos(a), cy + q * math.sin(a))])
    out += [[rng.randint(0, 60) for _ in range(2 * rng.choice([3, 4, 5]))] for _ in range(60)]  # most cross themselves
    comb = [0, 0, 5, 0, 5, 12, 10, 12, 10, 0, 15, 0, 15, 12, 20, 12, 20, 0, 25, 0, 25, 20, 0, 20]
    out += [[c + d for c in comb] for d in (0, 3, 8, 10, 20)] + [[10, 8, 30, 8, 30, 24, 10, 24], [10, 8, 20, 8, 20, 16, 10, 16]]
    return out + [[5, 5, 9, 9], [1, 1], [], [1, 1, 9, 1, 9, 9, 1, 9, 7], [1, 1, math.nan, 1, 9, 9], [1, 1, math.inf, 1, 9, 9]]


def frames(spark):
    rows = [(i % 3, i, [c / (80 if j % 2 == 0 else 64) for j, c in enumerate(map(float, p))]) for i, p in enumerate(polygons(3))]
    labels = spark.createDataFrame([*rows, (0, 999, None), (7, 998, rows[0][2])], "image_id long, k long, coords array<double>")
    return labels, spark.createDataFrame([(0, 80, 64), (1, 80, 64), (2, 70, 15)], "image_id long, width long, height long")


def one_by_one(labels, images, t):
    """The same by columns: candidates, then each cut by itself."""
    px = labels.join(images, "image_id").withColumn("px", G.to_pixels(F.col("coords"), F.col("width"), F.col("height")))
    px = px.where(G.is_simple(F.col("px")) & ~F.exists("px", lambda c: F.isnan(c) | (c > 1e300)))
    px = px.select("*", G.bbox(F.col("px")).alias("b")).select("*", "b.*").drop("width", "height")
    c = tiling.candidate_tiles(px.withColumn("convex", P.is_convex(F.col("px"))), images, t)
    tile = [F.col("tx"), F.col("ty"), F.col("tx") + t.width, F.col("ty") + t.height]
    both = c.where("convex").withColumn("parts", F.array(G.flat(G.clip(F.col("px"), *tile))))
    both = both.unionByName(c.where("NOT convex").withColumn("parts", P.clip_parts("px", *tile)))
    inside = F.aggregate("parts", F.lit(0.0), lambda a, p: a + G.polygon_area(p))
    kept = both.where(tiling.keeps(G.polygon_area(F.col("px")), inside, t)).select("*", F.posexplode("parts").alias("part_no", "part"))
    coords = G.to_tile(F.col("part"), F.col("tx"), F.col("ty"), F.lit(t.width), F.lit(t.height)).alias("tile_coords")
    return kept.where(F.size("part") >= 6).select("image_id", "k", "tx", "ty", "part_no", G.polygon_area(F.col("part")).alias("inside"), "part", coords)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_equal_to_column_builders(spark):
    labels, images = frames(spark)
    for t in (SMALL, tiling.Tiling(20, 16, 0.5, 0.5, 0.0, 0.0)):
        want = rows_of(one_by_one(labels, images, t))
        assert len(want) > 800 and any(r[4] > 0 for r in want)
        found = tiling.tile_polygons(labels, images, t)
        assert rows_of(found.select("image_id", "k", "tx", "ty", "part_no", "inside", "part", "tile_coords")) == want


def test_bounded_steps_give_the_same(spark, monkeypatch):
    """However few numbers are worked on at once, and without the columns that aren't wanted."""
    import pyarrow as pa

    labels, images = frames(spark)
    rows = labels.where("image_id < 2").collect()
    batch = pa.RecordBatch.from_pydict({"k": [r.k for r in rows], "coords": pa.array([r.coords for r in rows], pa.list_(pa.float64())), "_w": [80] * len(rows), "_h": [64] * len(rows)})
    of = lambda wanted: sorted(tuple(r.values()) for b in cuts.cut(iter([batch]), SMALL, ["k"], wanted) for r in b.to_pylist())
    whole = of(["part"])
    monkeypatch.setattr(cuts, "VALUES", 50)
    assert of(["part"]) == whole and [r[:5] for r in whole] == of([])


def test_queries_cut_in_batches(spark):
    """No polygon is cut by nested column expressions, one row after the other."""
    from quadrat.plans import catalogue_labels  # noqa: F401  adds to the table
    from quadrat.plans.catalogue import QUERIES

    plan = QUERIES["tile_polygon_labels"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan


def test_concave_labels_are_cut_in_batches(spark):
    """Each part of a label with a notch, without a function that is called for one row after the other."""
    from quadrat.plans import catalogue_masks  # noqa: F401  adds to the table
    from quadrat.plans.catalogue import QUERIES

    plan = QUERIES["tile_concave_labels"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan and "aggregate(" not in plan
