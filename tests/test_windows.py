"""Regions in windows of their image: against a loop, and without a join of all windows."""

import random

from quadrat.operators import boxes, mosaics, tiling


def sample(spark, seed):
    rng = random.Random(seed)
    images = [(i, rng.randint(3, 2000), rng.randint(3, 2000)) for i in range(30)] + [(30, 640, 640), (31, 1000, 960)]
    rois = []
    for k in range(600):
        x, y = rng.randint(0, 1500), rng.randint(0, 1500)
        rois.append((rng.randrange(34), k, float(x), float(y), float(x + rng.choice([0, 5, 320])), float(y + rng.choice([0, 5, 320]))))
    schema = "image_id long, k long, x1 double, y1 double, x2 double, y2 double"
    return images, rois, spark.createDataFrame(images, "image_id long, width long, height long"), spark.createDataFrame(rois, schema)


def joins_images_only(df):
    """Windows are made above the join."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "Join" in plan and "Generate" in plan and "Generate" not in plan[plan.index("Join") :]


def test_regions_in_segments(spark):
    images, rois, i, r = sample(spark, 1)
    found = boxes.in_own_windows(r, i, lambda rows, keep: tiling.segments(rows, keep=keep))
    size = {image: (w // 3, h // 3) for image, w, h in images}
    want = [
        (k, row, col) for image, k, x1, y1, x2, y2 in rois if image in size for row in range(3) for col in range(3)
        if x1 >= col * size[image][0] and x2 <= (col + 1) * size[image][0] and y1 >= row * size[image][1] and y2 <= (row + 1) * size[image][1]
    ]
    assert sorted((x.k, x.w_row, x.w_col) for x in found.collect()) == sorted(want)


def test_segments_of_a_query_are_not_joined(spark):
    from quadrat.plans.catalogue import QUERIES

    assert joins_images_only(QUERIES["roi_containment"](spark, "/root/testdata/sf0.001"))


def test_regions_in_slices(spark):
    images, rois, i, r = sample(spark, 2)
    found = boxes.in_own_windows(r, i, lambda rows, keep: mosaics.slices(rows, keep=keep))
    starts = lambda n: [min(s, max(n - 640, 0)) for s in range(0, max(n - 640, 0) + 320, 320)]
    size = {image: (w, h) for image, w, h in images}
    want = [
        (k, x, y) for image, k, x1, y1, x2, y2 in rois if image in size for x in starts(size[image][0]) for y in starts(size[image][1])
        if x1 >= x and y1 >= y and x2 <= min(x + 640, size[image][0]) and y2 <= min(y + 640, size[image][1])
    ]
    assert sorted((x.k, x.w_x0, x.w_y0) for x in found.collect()) == sorted(want)


def test_slices_of_a_query_are_not_joined(spark):
    from quadrat.plans.catalogue import QUERIES

    assert joins_images_only(QUERIES["sliced_detections"](spark, "/root/testdata/sf0.001"))
