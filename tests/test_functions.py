import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from quadrat.functions import geometry as G
from quadrat.functions import names as N
from quadrat.functions import rle


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def coords(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_areas(spark):
    assert one(spark, G.polygon_area(coords(0, 0, 4, 0, 4, 3, 0, 3))) == 12
    assert one(spark, G.polygon_area(coords(0, 0, 4, 0))) == 0
    assert one(spark, G.label_area(coords(0.5, 0.5, 0.2, 0.1))) == pytest.approx(0.02)
    assert one(spark, G.label_area(coords(1, 2, 5, 7))) == 20
    assert one(spark, G.pixel_area(coords(0, 0, 1, 0, 1, 1, 0, 1), F.lit(10), F.lit(20))) == 200


def test_clip_keeps_area(spark):
    concave = coords(0, 0, 10, 0, 10, 10, 5, 2, 0, 10)
    whole = one(spark, G.polygon_area(concave))
    parts = [
        one(spark, G.clipped_area(concave, F.lit(a), F.lit(b), F.lit(a + 5), F.lit(b + 5))) for a, b in itertools.product((0.0, 5.0), (0.0, 5.0))
    ]
    assert sum(parts) == pytest.approx(whole)
    assert one(spark, G.clipped_area(concave, F.lit(20.0), F.lit(20.0), F.lit(30.0), F.lit(30.0))) == 0


def test_simple_and_centroid(spark):
    assert one(spark, G.is_simple(coords(0, 0, 4, 0, 4, 3, 0, 3)))
    assert not one(spark, G.is_simple(coords(0, 0, 4, 4, 4, 0, 0, 4)))
    c = one(spark, G.centroid(coords(0, 0, 4, 0, 4, 2, 0, 2)))
    assert (c.x, c.y) == (2, 1)
    assert one(spark, G.affine(coords(1, 2), [[2, 0, 1], [0, 3, 1], [0, 0, 1]])) == [3, 7]


def test_pixels_and_tiles(spark):
    assert one(spark, G.to_pixels(coords(0.25, 0.35), F.lit(10), F.lit(10))) == [2, 4]
    assert one(spark, G.to_tile(coords(640, 100), F.lit(0), F.lit(100), F.lit(640), F.lit(640))) == [1.0, 0.0]


def test_rle(spark):
    rng = random.Random(1)
    for _ in range(8):
        bits = [rng.randint(0, 1) for _ in range(rng.randint(1, 12))]
        runs = one(spark, rle.encode(F.array(*map(F.lit, bits))))
        want, last, n = [], 0, 0
        for b in bits:
            if b != last:
                want.append(n)
                last, n = b, 0
            n += 1
        assert runs == [*want, n]
        assert one(spark, rle.decode(F.array(*map(F.lit, runs)))) == bits


def test_names(spark):
    path = F.lit("a/set/images/x_0640_12800.jpg")
    assert one(spark, N.label_path(path)) == "a/set/labels/x_0640_12800.txt"
    assert one(spark, N.dataset_name(path, "before_images")) == "set"
    assert one(spark, N.dataset_name(path, "last_other")) == "set"
    assert one(spark, N.dataset_name(path, "second")) == "set"
    assert one(spark, N.without_tile(N.stem(path))) == "x"
    assert one(spark, N.tile_name(F.lit("s"), F.lit(5), F.lit(12800))) == "s_0005_12800"
    assert one(spark, N.tray_folder(F.lit("T3"))) == "T03 (Done)"
    assert one(spark, N.tray_folder(F.lit("T23"))) == "T23"
    assert one(spark, N.numbers(F.lit("x=1.5, y=-2"))) == [1.5, -2.0]


def test_exact_overlap(spark):
    """Against counted pixels, and shapes whose overlap is plain."""
    from quadrat.operators import matching

    u = [0, 0, 90, 0, 90, 90, 60, 90, 60, 30, 30, 30, 30, 90, 0, 90]
    rows = [(u, [0, 50, 100, 50, 100, 70, 0, 70], 1200.0), (u, u, 30 * 90 * 2 + 30 * 30.0), (u, [40, 40, 50, 40, 50, 50], 0.0), ([0, 0, 10, 0, 0, 10], [10, 10, 0, 10, 10, 0], 0.0),
            ([0, 0, 10, 0, 10, 10, 0, 10], [10, 0, 20, 0, 20, 10], 0.0), ([5, 5], u, 0.0), ([0, 10, 10, 10, 10, 0, 0, 0], [5, 5, 15, 5, 15, 15, 5, 15], 25.0)]
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b], c) for a, b, c in rows], "a array<double>, b array<double>, area double")
    assert [r[0] for r in df.select(F.round(G.overlap_area(F.col("a"), F.col("b")), 6)).collect()] == [c for *_, c in rows]
    rng = random.Random(3)
    many = [([rng.uniform(0, 600) for _ in range(6)], [rng.uniform(0, 600) for _ in range(6)]) for _ in range(40)]
    df = spark.createDataFrame(many, "a array<double>, b array<double>")
    for r in df.select(G.polygon_iou(F.col("a"), F.col("b")).alias("exact"), matching.raster_iou("a", "b").alias("counted")).collect():
        assert abs(r.exact - r.counted) < 0.01


def test_clip_parts(spark):
    """Parts of concave polygons: plain ones, teeth that touch the border, and areas of random stars."""
    from quadrat.functions import parts as P

    u = [0, 0, 3, 0, 3, 5, 7, 5, 7, 0, 10, 0, 10, 9, 0, 9]
    comb = [0, 0, 1, 4, 2, 2, 3, 4, 4, 0, 5, 8, -1, 8]  # teeth upward with a low gap at y = 2
    stars = []
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(5, 14)
        at = [(rng.uniform(5, 60), 2 * math.pi * k / n) for k in range(n)]
        stars.append([c for r, t in at for c in (50 + r * math.cos(t), 50 + r * math.sin(t))])
    shapes = [(u, 0, 0, 10, 4), (u, -5, -5, 20, 20), (u, 4, 0, 6, 4), (u, 0, 0, 10, 5), (u, 0, 5, 10, 9), (comb, -5, 0, 10, 2), (comb, -5, 0, 10, 4), (u[::1], 0, 4, 3, 9)]
    rows = [(i, [float(x) for x in p], *map(float, box)) for i, (p, *box) in enumerate(shapes)]
    rows += [(100 + i, p, 20.0, 30.0, 70.0, 75.0) for i, p in enumerate(stars)]
    df = spark.createDataFrame(rows, "id int, p array<double>, a double, b double, c double, d double")
    box = [F.col(x) for x in "abcd"]
    df = df.select("id", P.clip_parts("p", *box).alias("parts"), G.clipped_area(F.col("p"), *box).alias("area"), P.is_convex(F.col("p")).alias("convex"))
    found = {r.id: r for r in df.withColumn("sum", F.aggregate("parts", F.lit(0.0), lambda s, x: s + G.polygon_area(x))).collect()}
    assert spark.createDataFrame([([float(c) for c in u],)], "p array<double>").select(G.is_simple(F.col("p"))).first()[0]  # edges on one line
    assert [len(found[i].parts) for i in range(8)] == [2, 1, 0, 2, 1, 2, 3, 1] and not found[0].convex
    for r in found.values():
        assert r.sum == pytest.approx(r.area, abs=1e-6)
        for p in r.parts:
            assert len(p) >= 6
    assert spark.createDataFrame([([0.0, 0.0, 4.0, 0.0, 4.0, 4.0, 0.0, 4.0],)], "p array<double>").select(P.is_convex(F.col("p"))).first()[0]
