import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from quadrat.operators import areas, boxes, coco, counting, experiments, filters, matching, metrics, splitting, tiling
from quadrat.plans import pipeline
from quadrat.sources import files, manifest, sinks
from quadrat.streaming import ingest


def test_relabel(spark):
    df = spark.createDataFrame([(0,), (1,), (5,)], "class_id int")
    assert [r[0] for r in filters.relabel(df, {0: 2, 1: 3}).collect()] == [2, 3, 5]
    assert [r[0] for r in filters.relabel(df, {0: 2}, "drop").collect()] == [2]
    with pytest.raises(Exception, match="no mapping"):
        filters.relabel(df, {0: 2}, "fail").collect()
    assert [r[0] for r in filters.alive_or_dead(df, [0], [5]).collect()] == [0, 1]


def test_exact_split_is_best():
    rng = random.Random(2)
    for _ in range(5):
        counts = [(f"g{i}", rng.randint(1, 30)) for i in range(7)]
        chosen, objective = splitting.exact_groups(counts)
        best = min(
            splitting._objective(counts, dict(zip((v for v, _ in counts), s)), splitting.RATIOS)
            for s in itertools.product(splitting.SPLITS, repeat=7) if set(s) == set(splitting.SPLITS)
        )
        assert objective == pytest.approx(best) and set(chosen.values()) == set(splitting.SPLITS)
    assert splitting.exact_groups([("a", 1)])[0] == {"a": "train"}
    with pytest.raises(ValueError):
        splitting.check_ratios((0.5, 0.5, 0.5))


def test_tiles(spark):
    images = spark.createDataFrame([(1, 7360, 4912), (2, 600, 700)], "image_id long, width long, height long")
    grid = tiling.tiles(images)
    assert grid.count() == 308 and grid.agg(F.max("y1")).first()[0] == 4800
    assert tiling.tiles(images, tiling.Tiling(full_cover=True)).agg(F.max("y1")).first()[0] == 4912
    labels = spark.createDataFrame([(1, 0, [0.0, 0.0, 0.1, 0.0, 0.1, 0.1, 0.0, 0.1])], "image_id long, class_id int, coords array<double>")
    cut = tiling.tile_polygons(labels, images).select("tx", "ty", "tile_coords").collect()
    assert (0, 0) in {(r.tx, r.ty) for r in cut} and all(0 <= c <= 1 for r in cut for c in r.tile_coords)


def test_merge_boxes(spark):
    rows = [(1, 0, 0.5, 0.0, 0.0, 2.0, 2.0), (1, 1, 0.9, 1.0, 1.0, 3.0, 3.0), (1, 2, 0.1, 9.0, 9.0, 10.0, 10.0), (2, 0, 0.3, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "image_id long, class_id int, conf double, x1 double, y1 double, x2 double, y2 double")
    found = sorted(tuple(r) for r in matching.merge_boxes(df).collect())
    assert found == [(1, 1, 0.7, 0.0, 0.0, 3.0, 3.0), (1, 2, 0.1, 9.0, 9.0, 10.0, 10.0), (2, 0, 0.3, 0.0, 0.0, 1.0, 1.0)]


def test_predict(spark):
    def load():
        return lambda batch: batch.assign(class_id=0)[["image_id", "class_id"]]

    assert matching.predict(spark.range(3).withColumnRenamed("id", "image_id"), load, "image_id long, class_id int").count() == 3


def test_texts(spark):
    text = "x\n[[1 2.\n 3]\n [4 5 6]]\nall 10 20 0.5 0.6 0.9 0.8 0.5 0.6 0.7 0.4\na 1 2 0 0 0 0 0.1 0.2 0.3 0.4\nb 1 2 0 0 0 0 0.1 0.2 0.5 0.2\n"
    df = spark.createDataFrame([(text,), ("none",)], "t string")
    got = df.select(experiments.matrix_from_text(F.col("t")), experiments.mean_average_precision(F.col("t")), experiments.mean_average_precision(F.col("t"), [0])).collect()
    assert got[0][0] == [[1, 2, 3], [4, 5, 6]] and got[0][1] == 0.7 and got[0][2] == pytest.approx(0.5)
    assert got[1][0] is None


def test_metrics_of_nothing(spark):
    pairs = spark.createDataFrame([], "image_id long, true_label int, pred_label int")
    assert metrics.confusion_matrix(pairs).count() == 1
    assert metrics.class_metrics(pairs, [0]).count() == 0


def test_manifest(spark, tmp_path):
    p = tmp_path / "m.yaml"
    p.write_text("names: {0: a, 1: b}\ntrain: [s1/images, s2/images]\nval: v/images\ndata: {d: {images: d/images}}\n")
    paths, classes = manifest.read(spark, str(p))
    assert {tuple(r) for r in paths.collect()} == {("s1", "train", "s1/images"), ("s2", "train", "s2/images"), ("v", "val", "v/images"), ("d", "data", "d/images")}
    assert classes.count() == 2
    with pytest.raises(ValueError, match="names"):
        manifest.parse("train: []")
    with pytest.raises(ValueError, match="paths"):
        manifest.paths({"names": []})
    with pytest.raises(ValueError):
        manifest.paths({"names": [], "data": "a/images"}, ["data"], strict=True)
    assert manifest.merge_classes([["a", "b"], ["c"], {0: "d", 5: "e"}]) == {0: "a", 1: "b", 2: "c", 5: "e"}


def test_labels_and_states(spark, tmp_path):
    (tmp_path / "images").mkdir(), (tmp_path / "labels").mkdir()
    for n in "abcd":
        (tmp_path / "images" / f"{n}.jpg").write_bytes(b"x")
    line = "0 0 0 1 0 1 1 0 1"
    (tmp_path / "labels" / "a.txt").write_text(f"{line}\n1 2 3\n")
    (tmp_path / "labels" / "b.txt").write_text("")
    (tmp_path / "labels" / "c.txt").write_text(f"{line}\n0 x y 1 1 1 1 1 1\n")
    rows = files.label_lines(spark, str(tmp_path / "labels"))
    assert [(r.stem, r.class_id, len(r.coords)) for r in rows.collect()] == [("a", 0, 8)]
    assert files.label_lines(spark, str(tmp_path / "labels"), strict=False).count() == 2
    states = files.label_states(spark, str(tmp_path / "images"), str(tmp_path / "labels"))
    assert {tuple(r) for r in states.collect()} == {("a", "non_empty"), ("b", "empty"), ("c", "non_empty"), ("d", "missing")}
    assert files.pairs(spark, str(tmp_path / "images"), str(tmp_path / "labels")).count() == 3
    assert files.pairs(spark, str(tmp_path / "images"), str(tmp_path / "labels"), True).count() == 3
    sinks.write_labels(rows, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1


def test_documents(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.jpg", "width": 2, "height": 2}], "annotations": [], "categories": [{"id": 1, "name": "x"}]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    parts = files.coco(spark, str(tmp_path / "c.json"))
    assert parts["images"].count() == 1 and parts["annotations"].count() == 0
    sinks.write_coco(parts["images"], parts["annotations"], parts["categories"], str(tmp_path / "w"), tables=False)
    assert files.coco(spark, str(tmp_path / "w"))["categories"].first().name == "x"
    labels = spark.createDataFrame([(1, "i&.jpg", 9, 9, "a", [1.0, 2.0, 3.5, 4.0, 0.0, 5.0])], "image_id long, name string, width int, height int, label string, coords array<double>")
    sinks.write_cvat(labels, str(tmp_path / "x"))
    back = files.cvat_polygons(files.cvat(spark, str(tmp_path / "x"))).first()
    assert back.name == "i&.jpg" and back.coords == [1.0, 2.0, 3.5, 4.0]


def test_preparation(spark):
    rng = random.Random(1)
    images = spark.createDataFrame([(i, 1280, 1280, i % 5) for i in range(20)], "image_id long, width long, height long, tile int").withColumn("split", F.lit("all"))
    rows = []
    for i in range(15):
        x, y = rng.random() * 0.8, rng.random() * 0.8
        rows.append((i, 0, [x, y, x + 0.1, y, x + 0.1, y + 0.1, x, y + 0.1]))
    labels = spark.createDataFrame(rows, "image_id long, class_id int, coords array<double>")
    settings = pipeline.Settings.of({"patch": {"overlap": 0.25}, "split": {"seed": 3}})
    out, kept = pipeline.prepare(images, labels, settings)
    tiles, found = out.collect(), {r.image_id for r in kept.collect()}
    # every image has 3 x 3 tiles; of each split, as many empty tiles stay as there are tiles with labels (or fewer)
    assert {r.split for r in tiles} == {"train", "val", "test"} and settings.suffix() == "_filtered_split_tiled_balanced"
    for split in ("train", "val", "test"):
        own = [r.image_id for r in tiles if r.split == split]
        assert len(own) == len(set(own)) and sum(i in found for i in own) == sum(i not in found for i in own) > 0
    assert found <= {r.image_id for r in tiles} and all((r.width, r.height) == (640, 640) for r in tiles)
    with pytest.raises(ValueError):
        pipeline.Settings.of({"pipeline": ["nothing"]})


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(2).write.parquet(str(src))
    events = ingest.event_stream(spark, str(src))
    q = ingest.run_available(ingest.windowed_counts(events, late="400 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    assert q.exception() is None


def test_balance_and_samples(spark):
    df = spark.createDataFrame([(i, "a", "s", "empty" if i % 3 else "non_empty") for i in range(30)], "image_id long, dataset string, split string, state string")
    kept = counting.balance_sample(df, "image_id", 1)
    assert kept.where("state = 'empty'").count() == kept.where("state = 'non_empty'").count() == 10
    assert counting.fraction_head(df, "image_id", 0.5).count() == 15
    assert counting.first_negatives(df, "image_id").count() == 20
    assert areas.histogram(df.withColumn("a", F.lit(1.0)), "a", 5).agg(F.sum("n")).first()[0] == 30


def test_annotations_of_predictions(spark):
    rows = [(1, "x", 0.9, (0.0, 0.0, 2.0, 2.0), None), (1, "y", 0.8, (0.0, 0.0, 0.0, 2.0), None), (1, "z", 0.7, (0.0, 0.0, 1.0, 1.0), [[]])]
    df = spark.createDataFrame(rows, "image_id long, class_name string, conf double, box struct<x1:double,y1:double,x2:double,y2:double>, polygon array<array<double>>")
    out = coco.from_predictions(df, {"x": 2}).collect()
    assert [(r.id, r.category_id) for r in out] == [(1, 2)]
    assert boxes.flip(df.select("box.*"), F.lit(10), F.lit(10)).first().x1 == 8


def test_suppress_and_raster(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        x, y = rng.random() * 20, rng.random() * 20
        rows.append((i % 3, 0, round(rng.random(), 1), x, y, x + 1 + rng.random() * 6, y + 1 + rng.random() * 6, f"k{i:02d}"))
    df = spark.createDataFrame(rows, "image_id long, class_id int, conf double, x1 double, y1 double, x2 double, y2 double, k string")
    want = set()
    for image in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: (-r[2], r[7])):
            def cover(q):
                w, h = min(r[5], q[5]) - max(r[3], q[3]), min(r[6], q[6]) - max(r[4], q[4])
                return max(w, 0) * max(h, 0) / min((a[5] - a[3]) * (a[6] - a[4]) for a in (r, q)) if w > 0 and h > 0 else 0
            if all(cover(q) < 0.2 for q in kept):
                kept.append(r)
        want |= {(image, r[7]) for r in kept}
    assert {(r.image_id, r.k) for r in matching.suppress(df, "k").collect()} == want
    two = spark.createDataFrame([([0.0, 0.0, 10.0, 0.0, 10.0, 10.0, 0.0, 10.0], [5.0, 0.0, 15.0, 0.0, 15.0, 10.0, 5.0, 10.0])], "a array<double>, b array<double>")
    assert two.select(matching.raster_iou("a", "b", 32).alias("x")).first().x == pytest.approx(1 / 3)
