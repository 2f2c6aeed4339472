"""Predictions against ground truth."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions import geometry as G
from quadrat.operators import grid
from quadrat.operators.rounds import greedy_edges, greedy_kept
from quadrat.session import running, stored

BACKGROUND = 3


#: Pairs (of boxes, of an image) up to which an image's pairs are folded in one row.
FOLD = 400


def _sided(df: DataFrame, side: str) -> DataFrame:
    return df.select("image_id", *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c != "image_id"])


def iou_candidates(
    truth: DataFrame, preds: DataFrame, same_class: bool = True, least: float = 0.0, inclusive: bool = False, whole: int = grid.WHOLE
) -> DataFrame:
    """Pairs inside an image whose boxes overlap: ``gt, pred`` (structs) and ``iou``. ``truth`` and ``preds`` have
    image_id, class_id, x1, y1, x2, y2. The join is on image (and class), the overlap its condition; images with more than
    ``whole`` pairs are joined on cells of a grid."""
    hot = grid.any_crowded(truth, preds, "image_id", whole)
    crowded = stored(grid.crowded(truth, preds, "image_id", whole)) if hot else None
    rest = (lambda d: d.join(crowded, "image_id", "left_anti")) if hot else (lambda d: d)
    on = (
        (F.col("image_id") == F.col("p_image_id")) & (F.col("g_x1") < F.col("p_x2")) & (F.col("p_x1") < F.col("g_x2"))
        & (F.col("g_y1") < F.col("p_y2")) & (F.col("p_y1") < F.col("g_y2"))
    )
    p = _sided(rest(preds), "p").withColumnRenamed("image_id", "p_image_id")
    found = _sided(rest(truth), "g").join(p, on & (F.col("g_class_id") == F.col("p_class_id")) if same_class else on)
    if hot:
        near = grid.meeting(truth, preds, "image_id", crowded)
        both = (("g", "a", truth), ("p", "b", preds))
        near = near.select("image_id", *[F.col(f"{x}.{c}").alias(f"{s}_{c}") for s, x, d in both for c in d.columns if c != "image_id"])
        near = near.where("g_x1 < p_x2 AND p_x1 < g_x2 AND g_y1 < p_y2 AND p_y1 < g_y2")
        near = near.where("g_class_id = p_class_id") if same_class else near
        found = found.drop("p_image_id").unionByName(near)
    width = F.least("g_x2", "p_x2") - F.greatest("g_x1", "p_x1")
    height = F.least("g_y2", "p_y2") - F.greatest("g_y1", "p_y1")
    area = lambda s: (F.col(f"{s}_x2") - F.col(f"{s}_x1")) * (F.col(f"{s}_y2") - F.col(f"{s}_y1"))
    # boxes that meet have an intersection; the ratio is taken once, above the join, unless a bound is pushed below it
    rows = found.withColumn("_i", width * height).withColumn("iou", F.try_divide("_i", area("g") + area("p") - F.col("_i")))
    side = lambda s, columns: F.struct("image_id", *[F.col(f"{s}_{c}").alias(c) for c in columns if c != "image_id"])
    rows = rows.select("image_id", side("g", truth.columns).alias("gt"), side("p", preds.columns).alias("pred"), "iou")
    if inclusive:
        return rows.where(F.col("iou") >= least)
    return rows.where(F.col("iou") > least) if least > 0 else rows


def _large(rows: DataFrame, fold: int) -> DataFrame | None:
    """The images with more than ``fold`` rows, None without any. ``rows``: a stored table."""
    found = stored(rows.groupBy("image_id").agg(F.count("*").alias("n")).where(F.col("n") > fold).select("image_id"))
    return None if found.isEmpty() else found


def greedy_match(candidates: DataFrame, gt_key: str, pred_key: str, fold: int = FOLD) -> DataFrame:
    """One-to-one matches inside each image: pairs by falling ``iou`` (then the keys), each taken if both sides are free.

    ``candidates``: image_id, iou and the two key columns. Pairs of an image with at most ``fold`` are folded in the JVM,
    those of others are chosen in rounds.
    """
    once = stored(candidates.select("image_id", "iou", gt_key, pred_key))
    large = _large(once, fold)
    if large is None:
        return _folded(once, gt_key, pred_key)
    pairs = once.join(large, "image_id", "left_semi").withColumn("_o", -F.col("iou")).drop("iou")
    taken = greedy_edges(pairs, "image_id", gt_key, pred_key, ["_o", gt_key, pred_key])
    iou = once.groupBy("image_id", gt_key, pred_key).agg(F.max("iou").alias("iou"))
    taken = taken.join(iou, ["image_id", gt_key, pred_key])
    return _folded(once.join(large, "image_id", "left_anti"), gt_key, pred_key).unionByName(taken)


def _folded(candidates: DataFrame, gt_key: str, pred_key: str) -> DataFrame:
    order = F.sort_array(
        F.collect_list(F.struct((-F.col("iou")).alias("o"), F.col(gt_key).alias("g"), F.col(pred_key).alias("p")))
    )
    grouped = candidates.groupBy("image_id").agg(order.alias("_c"))
    kind = candidates.schema
    zero = F.array().cast(f"array<struct<o:double,g:{kind[gt_key].dataType.simpleString()},p:{kind[pred_key].dataType.simpleString()}>>")

    def take(acc, c):
        used = F.exists(acc, lambda m: (m["g"] == c["g"]) | (m["p"] == c["p"]))
        return F.when(used, acc).otherwise(F.concat(acc, F.array(c)))

    out = grouped.select("image_id", F.explode(F.aggregate("_c", zero, take)).alias("m"))
    return out.select("image_id", F.col("m.g").alias(gt_key), F.col("m.p").alias(pred_key), (-F.col("m.o")).alias("iou"))


def label_pairs(truth: DataFrame, preds: DataFrame, matched: DataFrame, gt_key: str, pred_key: str, background: int = BACKGROUND) -> DataFrame:
    """``image_id, true_label, pred_label``: matches, then missed truth against background, then extra predictions."""
    g, p = truth.select("image_id", gt_key, F.col("class_id").alias("true_label")), preds.select(
        "image_id", pred_key, F.col("class_id").alias("pred_label")
    )
    both = matched.join(g, ["image_id", gt_key]).join(p, ["image_id", pred_key]).select("image_id", "true_label", "pred_label")
    missed = g.join(matched, ["image_id", gt_key], "left_anti").select("image_id", "true_label", F.lit(background).alias("pred_label"))
    extra = p.join(matched, ["image_id", pred_key], "left_anti").select("image_id", F.lit(background).alias("true_label"), "pred_label")
    return both.unionByName(missed).unionByName(extra)


def best_by_iou(candidates: DataFrame, pred_key: str, gt_key: str) -> DataFrame:
    """For each prediction the truth with the largest overlap, the least key among equals."""
    return candidates.groupBy("image_id", pred_key).agg(
        F.min_by(F.struct(gt_key, "iou"), F.struct((-F.col("iou")).alias("o"), gt_key)).alias("b")
    ).select("image_id", pred_key, F.col(f"b.{gt_key}").alias(gt_key), F.col("b.iou").alias("iou"))


def best_or_background(
    truth: DataFrame, preds: DataFrame, candidates: DataFrame, gt_key: str, pred_key: str, background: int = BACKGROUND
) -> DataFrame:
    """``image_id, true_label, pred_label`` of each prediction: the truth that it overlaps most, or the background."""
    best = best_by_iou(candidates, pred_key, gt_key)
    named = best.join(truth.select("image_id", gt_key, F.col("class_id").alias("true_label")), ["image_id", gt_key])
    rows = preds.select("image_id", pred_key, F.col("class_id").alias("pred_label")).distinct()
    joined = rows.join(named.select("image_id", pred_key, "true_label"), ["image_id", pred_key], "left")
    return joined.select("image_id", F.coalesce("true_label", F.lit(background)).alias("true_label"), "pred_label")


def image_flags(truth: DataFrame, preds: DataFrame, candidates: DataFrame, gt_key: str, pred_key: str, least: float = 0.5) -> DataFrame:
    """``image_id, has_fp, has_fn``: by the counts where they differ, else by what no other side overlaps enough."""
    n = truth.groupBy("image_id").agg(F.count("*").alias("n_gt")).join(
        preds.groupBy("image_id").agg(F.count("*").alias("n_pred")), "image_id", "full"
    )
    good = candidates.where(F.col("iou") >= least)
    met = good.groupBy("image_id").agg(F.count_distinct(gt_key).alias("g_met"), F.count_distinct(pred_key).alias("p_met"))
    c = n.join(met, "image_id", "left").fillna(0)
    return c.select(
        "image_id",
        F.when(F.col("n_pred") != F.col("n_gt"), F.col("n_pred") > F.col("n_gt")).otherwise(F.col("p_met") < F.col("n_pred")).alias("has_fp"),
        F.when(F.col("n_pred") != F.col("n_gt"), F.col("n_pred") < F.col("n_gt")).otherwise(F.col("g_met") < F.col("n_gt")).alias("has_fn"),
    )


def average_precision(preds: DataFrame, positives: DataFrame) -> DataFrame:
    """``class_id, ap``: area under the precision envelope. ``preds``: class_id, conf, tp, key; ``positives``: class_id, n.

    Predictions of equal confidence count together, so a class is summed over its distinct confidences.
    """
    steps = preds.groupBy("class_id", "conf").agg(F.sum(F.col("tp").cast("long")).alias("tp"), F.count("*").alias("n_pred"))
    curve = running(steps, {"c_tp": "tp", "c_n_pred": "n_pred"}, "conf", ["class_id"], backwards=True)
    curve = running(curve.withColumn("precision", F.col("c_tp") / F.col("c_n_pred")), {"envelope": "precision"}, "conf", ["class_id"], kind="max")
    return positives.join(
        curve.groupBy("class_id").agg(F.sum(F.col("tp") * F.col("envelope")).alias("_area")), "class_id", "left"
    ).select("class_id", F.round(F.coalesce(F.col("_area") / F.col("n"), F.lit(0.0)), 6).alias("ap"))


def merge_boxes(boxes: DataFrame, by: str = "image_id") -> DataFrame:
    """Overlapping boxes of an image joined pair by pair until none overlap: the box around both, the class of the more
    confident one, the mean confidence. Partitions are sorted by image and streamed, one image in memory at a time."""
    names = boxes.columns

    def join(items: list[dict]) -> list[dict]:
        items.sort(key=lambda r: (r["x1"], r["y1"], r["x2"], r["y2"], r["class_id"], r["conf"]))
        at = 0
        while at < len(items):
            a = items[at]
            hit = next((j for j in range(at + 1, len(items)) if _meet(a, items[j])), None)
            if hit is None:
                at += 1
                continue
            b = items.pop(hit)
            top = a if a["conf"] >= b["conf"] else b
            items[at] = {
                **a, "class_id": top["class_id"], "conf": (a["conf"] + b["conf"]) / 2, "x1": min(a["x1"], b["x1"]),
                "y1": min(a["y1"], b["y1"]), "x2": max(a["x2"], b["x2"]), "y2": max(a["y2"], b["y2"]),
            }
            at = 0
        return items

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                if held and held[-1][by] != row[by]:
                    out += join(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(join(held), columns=names)

    return boxes.repartition(by).sortWithinPartitions(by).mapInPandas(run, boxes.schema)


def _meet(a: dict, b: dict) -> bool:
    return a["x1"] <= b["x2"] and b["x1"] <= a["x2"] and a["y1"] <= b["y2"] and b["y1"] <= a["y2"]


def predict(images: DataFrame, load, schema: str) -> DataFrame:
    """A model's rows for a table of images: ``load()`` gives a function from a data frame of images to one of
    predictions, and is called once a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return images.mapInPandas(run, schema)


def suppress(preds: DataFrame, key: str, threshold: float = 0.2, same_class: bool = False, fold: int = FOLD) -> DataFrame:
    """Predictions left after greedy suppression inside each image: by falling confidence (then the key), one goes if a
    kept one covers at least ``threshold`` of the smaller box. ``preds``: image_id, class_id, conf, x1, y1, x2, y2, key.
    Images with more than ``fold`` predictions are thinned in rounds over the pairs that overlap enough."""
    once = stored(preds.select("image_id", "class_id", "conf", "x1", "y1", "x2", "y2", key))
    large = _large(once, fold)
    if large is None:
        return _thinned(once, key, threshold, same_class)
    many = once.join(large, "image_id", "left_semi")
    cells = grid.crowded(many, many, "image_id", whole=0)
    pairs = grid.meeting(many, many, "image_id", cells)
    cover = G.intersection_area(F.col("a"), F.col("b")) / F.least(G.box_area(F.col("a")), G.box_area(F.col("b")))
    first = F.struct((-F.col("a.conf")).alias("o"), F.col(f"a.{key}").alias("k")) < F.struct((-F.col("b.conf")).alias("o"), F.col(f"b.{key}").alias("k"))
    hides = pairs.where(first & (cover >= threshold))
    hides = hides.where("a.class_id = b.class_id") if same_class else hides
    kept = greedy_kept(many, hides.select("image_id", F.col(f"a.{key}").alias("over"), F.col(f"b.{key}").alias("under")), "image_id", key)
    kept = kept.join(many.select("image_id", key, "conf"), ["image_id", key])
    return _thinned(once.join(large, "image_id", "left_anti"), key, threshold, same_class).unionByName(kept)


def _thinned(preds: DataFrame, key: str, threshold: float, same_class: bool) -> DataFrame:
    item = F.struct((-F.col("conf")).alias("o"), F.col(key).alias("k"), "class_id", "x1", "y1", "x2", "y2")
    grouped = preds.groupBy("image_id").agg(F.sort_array(F.collect_list(item)).alias("_c"))
    zero = F.filter("_c", lambda c: F.lit(False))

    def take(kept, c):
        def hides(k):
            cover = G.intersection_area(k, c) / F.least(G.box_area(k), G.box_area(c))
            return (cover >= threshold) & (k["class_id"] == c["class_id"]) if same_class else cover >= threshold

        return F.when(F.exists(kept, hides), kept).otherwise(F.concat(kept, F.array(c)))

    out = grouped.select("image_id", F.explode(F.aggregate("_c", zero, take)).alias("m"))
    return out.select("image_id", F.col("m.k").alias(key), (-F.col("m.o")).alias("conf"))


def first_overlaps(boxes: DataFrame, key: str, by: str = "image_id", fold: int = FOLD) -> DataFrame:
    """Boxes of an image joined in pairs: each free box, in the order of ``key``, with the first free one after it that it
    meets. ``by, key, other`` (null for a box that stays alone) and the box around both, the class of the more confident
    one (of the second if equal), the mean confidence. Keys are different in all boxes of an image.

    Images with at most ``fold`` pairs of boxes are folded in the JVM, so that a box moves once; the boxes of others are
    joined on cells of a grid and their pairs chosen in rounds."""
    rows = boxes.select(by, key, "class_id", "conf", *grid.BOX)
    large = stored(rows.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") * (F.col("n") - 1) / 2 > fold).select(by))
    if large.isEmpty():
        return _first_folded(rows, key, by)
    of_large = rows[by].eqNullSafe(large[by])
    many = _first_in_rounds(stored(rows.join(large, of_large, "left_semi")), key, by)
    return _first_folded(rows.join(large, of_large, "left_anti"), key, by).unionByName(many)


def _first_folded(rows: DataFrame, key: str, by: str) -> DataFrame:
    grouped = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), "class_id", "conf", *grid.BOX))).alias("_c"))
    indexes = F.sequence(F.lit(0), F.size("_c") - 1)

    def take(acc, i):
        a = F.get("_c", i)
        free = lambda j: ~F.exists(acc, lambda m: m["j"] == j)
        other = F.filter(indexes, lambda j: (j > i) & G.overlaps(a, F.get("_c", j)) & free(j) & F.col(by).isNotNull())
        return F.when(free(i), F.concat(acc, F.array(F.struct(i.alias("i"), F.coalesce(F.get(other, F.lit(0)), F.lit(-1)).alias("j"))))).otherwise(acc)

    # never empty; the plain form would be computed a second time, to see that
    pairs = grouped.select(by, "_c", F.explode_outer(F.aggregate(indexes, F.array().cast("array<struct<i:int,j:int>>"), take)).alias("m"))
    both = pairs.select(by, F.get("_c", F.col("m.i")).alias("a"), F.get("_c", F.col("m.j")).alias("b"))
    two, of = F.col("b").isNotNull(), lambda f: [f(f"a.{c}", f"b.{c}").alias(c) for c in (grid.BOX[:2] if f is F.least else grid.BOX[2:])]
    return both.select(
        by, F.col("a.k").alias(key), F.col("b.k").alias("other"),
        F.when(two & ~F.coalesce(F.col("a.conf") > F.col("b.conf"), F.lit(False)), F.col("b.class_id")).otherwise(F.col("a.class_id")).alias("class_id"),
        F.when(two, (F.col("a.conf") + F.col("b.conf")) / 2).otherwise(F.col("a.conf")).alias("conf"), *of(F.least), *of(F.greatest),
    )


def _first_in_rounds(once: DataFrame, key: str, by: str) -> DataFrame:
    """``once``: a stored table."""
    pairs = grid.meeting(once, once, by, grid.crowded(once, once, by, whole=0)).where(F.col(f"a.{key}") < F.col(f"b.{key}"))
    pairs = stored(pairs.select(by, F.col(f"a.{key}").alias(key), F.col(f"b.{key}").alias("other")))
    taken = greedy_edges(pairs, by, key, "other", [key, "other"], shared=True)
    second = once.select(by, F.col(key).alias("other"), *[F.col(c).alias(f"_{c}") for c in ("class_id", "conf", *grid.BOX)])
    both = taken.join(once, [by, key]).join(second, [by, "other"])
    least, most = (lambda c: F.least(c, f"_{c}").alias(c)), (lambda c: F.greatest(c, f"_{c}").alias(c))
    joined = both.select(
        by, key, "other", F.when(F.col("conf") > F.col("_conf"), F.col("class_id")).otherwise(F.col("_class_id")).alias("class_id"),
        ((F.col("conf") + F.col("_conf")) / 2).alias("conf"), least("x1"), least("y1"), most("x2"), most("y2"),
    )
    used = taken.select(by, key).unionByName(taken.select(by, F.col("other").alias(key)))
    alone = once.join(used, [by, key], "left_anti").withColumn("other", F.lit(None).cast(once.schema[key].dataType))
    return joined.unionByName(alone.select(*joined.columns))


def raster_iou(a: str, b: str, size: int = 640):
    """Overlap of two polygons (flat coordinates in 0 to ``size``) counted on pixel centres: for shapes whose exact
    overlap isn't a composition of built-in expressions."""
    import numpy as np

    @F.pandas_udf("double")
    def overlap(p: pd.Series, q: pd.Series) -> pd.Series:
        y, x = np.mgrid[0:size, 0:size] + 0.5

        def fill(flat) -> np.ndarray:
            points = np.asarray(flat, float)[: len(flat) // 2 * 2].reshape(-1, 2)
            inside = np.zeros((size, size), bool)
            for (x0, y0), (x1, y1) in zip(points, np.roll(points, -1, axis=0)):
                if y0 != y1:
                    crosses = (y0 > y) != (y1 > y)
                    inside ^= crosses & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
            return inside

        out = []
        for one, two in zip(p, q):
            if one is None or two is None:
                out.append(None)
                continue
            m, n = fill(one), fill(two)
            union = np.count_nonzero(m | n)
            out.append(np.count_nonzero(m & n) / union if union else 0.0)
        return pd.Series(out, dtype="float64")

    return overlap(a, b)
