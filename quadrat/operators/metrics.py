"""Confusion matrices and the measures drawn from them. Pairs are ``image_id, true_label, pred_label``; the background
has a label of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BACKGROUND = 3


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 for a denominator that isn't positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def active_labels(pairs: DataFrame, background: int = BACKGROUND) -> DataFrame:
    """Labels on either side, and the background."""
    both = pairs.select(F.col("true_label").alias("label")).unionByName(pairs.select(F.col("pred_label").alias("label"))).distinct()
    return both.where(F.col("label") != background).unionByName(
        pairs.sparkSession.range(1).select(F.lit(background).alias("label"))
    )


def confusion_matrix(pairs: DataFrame, background: int = BACKGROUND) -> DataFrame:
    """``true_label, pred_label, n`` over all active labels, zeros included. The grid is made of counted labels."""
    counts = pairs.groupBy("true_label", "pred_label").agg(F.count("*").alias("n"))
    labels = active_labels(counts, background)
    grid = labels.select(F.col("label").alias("true_label")).crossJoin(labels.select(F.col("label").alias("pred_label")))
    return grid.join(counts, ["true_label", "pred_label"], "left").fillna(0, ["n"])  # classes squared


def normalised(matrix: DataFrame, by: str = "true", digits: int = 6) -> DataFrame:
    """Shares of rows (``true``), columns (``pred``) or all; sums of 0 count as 1."""
    keys = {"true": ["true_label"], "pred": ["pred_label"], "all": []}[by]
    total = F.sum("n").over(Window.partitionBy(*keys))
    return matrix.withColumn("share", F.round(F.col("n") / F.greatest(total, F.lit(1)), digits))


def outcome(background: int = BACKGROUND) -> Column:
    """Kind of a pair."""
    t, p = F.col("true_label"), F.col("pred_label")
    return (
        F.when((t == background) & (p == background), "TN").when(t == p, "TP")
        .when(p == background, "FN").when(t == background, "FP").otherwise("misclassified")
    )


def outcome_counts(pairs: DataFrame, background: int = BACKGROUND) -> DataFrame:
    return pairs.groupBy(outcome(background).alias("outcome")).agg(F.count("*").alias("n"))


def class_counts(pairs: DataFrame, classes: list[int]) -> DataFrame:
    """TP, FP, FN and TN of each class from one count of pairs; TN are pairs with the class on neither side."""
    counts = pairs.groupBy("true_label", "pred_label").agg(F.count("*").alias("n"))
    listed = counts.select("*", F.explode(F.array(*map(F.lit, classes))).alias("class_id"))
    t, p, c, n = F.col("true_label") == F.col("class_id"), F.col("pred_label") == F.col("class_id"), F.col("class_id"), F.col("n")
    none = F.lit(0)
    return listed.groupBy(c).agg(
        F.sum(F.when(t & p, n).otherwise(none)).alias("tp"), F.sum(F.when(~t & p, n).otherwise(none)).alias("fp"),
        F.sum(F.when(t & ~p, n).otherwise(none)).alias("fn"), F.sum(F.when(~t & ~p, n).otherwise(none)).alias("tn"),
    )


def _measures(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r), "accuracy": ratio(tp + tn, tp + fp + fn + tn)}


def class_metrics(pairs: DataFrame, classes: list[int], digits: int | None = 3) -> DataFrame:
    out = class_counts(pairs, classes)
    m = _measures(*(F.col(c) for c in ("tp", "fp", "fn", "tn")))
    return out.withColumns({k: v if digits is None else F.round(v, digits) for k, v in m.items()})


def averages(pairs: DataFrame, classes: list[int], digits: int = 3) -> DataFrame:
    """``kind`` macro: means of the classes' measures; micro: measures of their sums. TN is the sum over the classes'
    number in both."""
    m = class_metrics(pairs, classes, None)
    sums = [F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.floor(F.sum("tn") / len(classes)).cast("long").alias("tn")]
    names = ("precision", "recall", "f1", "accuracy")
    macro = m.agg(*sums, *[F.avg(x).alias(x) for x in names]).withColumn("kind", F.lit("macro"))
    micro = m.agg(*sums)
    micro = micro.withColumns(_measures(*(F.col(c) for c in ("tp", "fp", "fn", "tn")))).withColumn("kind", F.lit("micro"))
    both = macro.unionByName(micro)
    return both.select("kind", "tp", "fp", "fn", "tn", *[F.round(x, digits).alias(x) for x in names])


def matrix_rates(matrix: DataFrame, ignore: list[int] = (), digits: int = 6) -> DataFrame:
    """Mean rates of a matrix whose rows are predictions: TPR, FNR, FPR, TNR, precision, recall, F1."""
    n = F.col("n")
    rows = matrix.groupBy(F.col("true_label").alias("label")).agg(F.sum("n").alias("row"), F.sum(F.when(F.col("true_label") == F.col("pred_label"), n).otherwise(0)).alias("d"))
    cols = matrix.groupBy(F.col("pred_label").alias("label")).agg(F.sum("n").alias("col"))
    total = F.sum("row").over(Window.partitionBy())  # one row a class
    m = rows.join(cols, "label").withColumn("s", total)
    tp, fp, fn = F.col("d"), F.col("row") - F.col("d"), F.col("col") - F.col("d")
    tn = F.col("s") - F.col("row") - F.col("col") + F.col("d")
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    each = m.where(~F.col("label").isin(list(ignore))) if ignore else m
    each = each.select(
        r.alias("tpr"), ratio(fn, tp + fn).alias("fnr"), ratio(fp, fp + tn).alias("fpr"), ratio(tn, fp + tn).alias("tnr"),
        p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"),
    )
    return each.agg(*[F.round(F.avg(c), digits).alias(c) for c in each.columns])


def class_distribution(pairs: DataFrame, classes: list[int], background: int = BACKGROUND) -> DataFrame:
    """How often each class is true and predicted, zeros included."""
    counts = pairs.groupBy("true_label", "pred_label").agg(F.count("*").alias("n"))
    listed = counts.select("*", F.explode(F.array(*map(F.lit, [*classes, background]))).alias("label"))
    return listed.groupBy("label").agg(
        F.sum(F.when(F.col("true_label") == F.col("label"), F.col("n")).otherwise(0)).alias("n_true"),
        F.sum(F.when(F.col("pred_label") == F.col("label"), F.col("n")).otherwise(0)).alias("n_pred"),
    )


def run_summary(images: DataFrame, counts: DataFrame) -> DataFrame:
    """Images with labels, without any, and all labels. ``counts``: image_id, n."""
    rows = images.select("image_id").join(counts, "image_id", "left").fillna(0, ["n"])
    return rows.agg(
        F.count("*").alias("n_images"), F.count_if(F.col("n") > 0).alias("processed"), F.count_if(F.col("n") == 0).alias("skipped"),
        F.sum("n").alias("n_labels"),
    )
