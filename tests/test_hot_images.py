"""Images that hold most of all boxes: grid join, greedy choices by rounds, pairs of boxes, and the counter with reset."""

import random

from pyspark.sql import functions as F

from quadrat.operators import areas, grid, matching

BOX = "image_id long, k long, class_id int, conf double, x1 double, y1 double, x2 double, y2 double"


def boxes(n, seed, images=(1, 1, 1, 2, 3)):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        x, y, w = rng.uniform(-50, 400), rng.uniform(-50, 400), rng.choice([5, 10, 20, 20, 300 if k % 50 == 0 else 8, 0])
        rows.append((rng.choice(images), k, k % 2, round(rng.random(), 1), x, y, x + w, y + w * 0.7))
    return rows


def meets(a, b, strict=False):
    if strict:
        return a[4] < b[6] and b[4] < a[6] and a[5] < b[7] and b[5] < a[7]
    return a[4] <= b[6] and b[4] <= a[6] and a[5] <= b[7] and b[5] <= a[7]


def test_grid_join_reports_each_pair_once(spark):
    rows = boxes(400, 1)
    df = spark.createDataFrame(rows, BOX)
    cells = grid.crowded(df, df, "image_id", whole=0)
    found = [(r.a.k, r.b.k) for r in grid.meeting(df, df, "image_id", cells).collect()]
    want = [(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and meets(a, b)]
    assert sorted(found) == sorted(want)


def test_candidates_of_crowded_images(spark):
    one, two = boxes(300, 2), boxes(300, 3)
    a, b = spark.createDataFrame(one, BOX), spark.createDataFrame(two, BOX)
    plain = matching.iou_candidates(a, b)
    key = lambda df: sorted((r.gt.k, r.pred.k, round(r.iou, 9)) for r in df.collect())
    for whole in (0, 5000):
        assert key(matching.iou_candidates(a, b, whole=whole)) == key(plain)
    assert {x[:2] for x in key(plain)} == {(g[1], p[1]) for g in one for p in two if g[0] == p[0] and g[2] == p[2] and meets(g, p, True)}


def test_suppression_by_rounds(spark):
    df = spark.createDataFrame([r for r in boxes(300, 4) if r[6] > r[4]], BOX)
    key = lambda fold, same: {(r.image_id, r.k, r.conf) for r in matching.suppress(df, "k", same_class=same, fold=fold).collect()}
    for same in (False, True):
        assert key(0, same) == key(10_000, same) != set()


def test_matches_of_a_hot_image(spark):
    """A hundred thousand boxes in one image, and a chain in which every pair waits for the one before."""
    n = 100_000
    side = 400
    cell = lambda i: (F.col(i) % side) * 10.0
    base = spark.range(n).select(F.lit(1).cast("long").alias("image_id"), F.col("id").alias("k"), F.lit(0).alias("class_id"), cell("id").alias("x1"), (F.floor(F.col("id") / side) * 10.0).alias("y1"))
    truth = base.select("*", (F.col("x1") + 8).alias("x2"), (F.col("y1") + 8).alias("y2"))
    preds = truth.withColumns({"x1": F.col("x1") + 1, "x2": F.col("x2") + 1})
    found = matching.iou_candidates(truth, preds).select("image_id", F.col("gt.k").alias("g"), F.col("pred.k").alias("p"), "iou")
    matched = matching.greedy_match(found, "g", "p")
    assert matched.count() == n and matched.where("g <> p").count() == 0
    chain = spark.createDataFrame([(1, g, p, 1 - (g + p) / 100) for g in range(12) for p in (g, g + 1)], "image_id long, g long, p long, iou double")
    assert sorted((r.g, r.p) for r in matching.greedy_match(chain, "g", "p", 0).collect()) == [(i, i) for i in range(12)]


def test_first_overlaps(spark):
    rows = boxes(200, 5)
    want, used = set(), set()
    for a in sorted(rows, key=lambda r: r[1]):
        if a[1] in used:
            continue
        b = next((b for b in sorted(rows, key=lambda r: r[1]) if b[1] > a[1] and b[1] not in used and b[0] == a[0] and meets(a, b)), None)
        used |= {a[1]} | ({b[1]} if b else set())
        want.add((a[1], b[1] if b else None, (a[2] if a[3] > b[3] else b[2]) if b else a[2], round((a[3] + b[3]) / 2 if b else a[3], 9)))
    found = matching.first_overlaps(spark.createDataFrame(rows, BOX), "k").collect()
    assert {(r.k, r.other, r.class_id, round(r.conf, 9)) for r in found} == want and len(found) == len(want)


def test_counter_with_reset(spark):
    rng = random.Random(6)
    rows = [(d, i, rng.choice([0, 1, 2, 5, 30])) for d in "abc" for i in range(200 if d != "c" else 1)] + [("d", 0, 99), ("d", 1, 1), ("d", 2, 1)]
    want = set()
    for d in "abcd":
        folder = held = 0
        for _, i, n in sorted(r for r in rows if r[0] == d):
            if held + n >= 20:
                folder, held = folder + 1, 0
            held += n
            want.add((d, i, folder))
    df = spark.createDataFrame(rows, "dataset string, i long, n int")
    assert {(r.dataset, r.i, r.folder) for r in areas.reset_groups(df, "n", "i", 20, ["dataset"]).collect()} == want


def test_sums_over_ranges(spark, monkeypatch):
    from quadrat import session

    rng = random.Random(7)
    rows = [(rng.choice("xy"), rng.choice([None, *range(40)]), i, rng.randint(-5, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, key long, i long, v long")
    monkeypatch.setattr(session, "BUCKET_ROWS", 60)
    for kind, backwards in (("sum", False), ("max", True), ("min", False), ("sum", True)):
        found = {r.i: (r.a, r.b) for r in session.running(df, {"a": "v", "b": "i"}, "key", ["g"], ["i"], kind, backwards).collect()}
        for g in "xy":
            order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]), reverse=backwards)
            for k in range(len(order)):
                fold = {"sum": sum, "max": max, "min": min}[kind]
                assert found[order[k][2]] == (fold(r[3] for r in order[: k + 1]), fold(r[2] for r in order[: k + 1]))
    ranks = {r.i: r.rn for r in session.ranked_by_key(df, "key", then=["i"]).collect()}
    assert [ranks[r[2]] for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))] == list(range(1, 501))
