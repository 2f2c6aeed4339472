"""Pairs of first overlaps: folded and in rounds, alike; a box moves once where images are small."""

from quadrat.operators import matching
from test_hot_images import BOX, boxes


def test_folded_and_in_rounds(spark):
    rows = boxes(150, 8, (1, 1, 1, 2, 3, 4, 5, 6))
    rows += [(9, 1000 + k, 0, 0.5, 0.0, 0.0, 5.0 * (k + 1), 5.0) for k in range(5)] + [(10, 2000, 1, 0.1, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, BOX)
    key = lambda fold: sorted((tuple(r) for r in matching.first_overlaps(df, "k", fold=fold).collect()), key=lambda r: r[:2])
    rounds = key(-1)
    assert len(rounds) > 60 and any(r[2] is None for r in rounds) and any(r[2] is not None for r in rounds)
    assert key(100_000) == rounds and key(50) == rounds


def test_boxes_without_an_image_stay_alone(spark):
    df = spark.createDataFrame([(None, k, 0, 0.5, 0.0, 0.0, 5.0, 5.0) for k in range(3)] + [(1, k, 0, 0.5, 0.0, 0.0, 5.0, 5.0) for k in range(3)], BOX)
    for fold in (100, 0):
        found = matching.first_overlaps(df, "k", fold=fold).collect()
        assert sorted((r.image_id or 0, r.k, -1 if r.other is None else r.other) for r in found) == [(0, 0, -1), (0, 1, -1), (0, 2, -1), (1, 0, 1), (1, 2, -1)]


def test_small_images_need_no_join(spark):
    """One exchange of the boxes, by image."""
    plan = matching.first_overlaps(spark.createDataFrame(boxes(20, 5, tuple(range(9))), BOX), "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
