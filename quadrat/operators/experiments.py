"""Training logs, experiment results and matrices written as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def curve(results: DataFrame, metric: str, by: list[str], origin: bool = False, digits: int = 6) -> DataFrame:
    """Mean, least and largest of a metric; ``origin`` adds the point (0, 0) of each confidence."""
    out = results.groupBy(*by).agg(
        F.round(F.avg(metric), digits).alias("mean"), F.round(F.min(metric), digits).alias("least"),
        F.round(F.max(metric), digits).alias("largest"),
    )
    if not origin:
        return out
    zero = results.select(*[c for c in by if c != "train_size"]).distinct().withColumn("train_size", F.lit(0).cast(results.schema["train_size"].dataType))
    return out.unionByName(zero.withColumns({c: F.lit(0.0) for c in ("mean", "least", "largest")}))


def in_unit(seconds: Column, unit: str) -> Column:
    return seconds / {"seconds": 1.0, "minutes": 60.0, "hours": 3600.0}[unit]


def best_epoch(log: DataFrame, run: list[str], epoch: str, value: str, patience: int) -> DataFrame:
    """Of each run's log: rows, the epoch that ``patience`` stops at, the value there and the last one."""
    ordered = F.sort_array(F.collect_list(F.struct(epoch, value)))
    g = log.groupBy(*run).agg(ordered.alias("_r"))
    n = F.size("_r")
    at = F.greatest(F.lit(0), n - patience - 1)
    return g.select(
        *run, n.cast("long").alias("n_rows"), at.cast("long").alias("best_epoch"), F.get("_r", at)[value].alias("value_at_best"),
        F.get("_r", n - 1)[value].alias("last_value"),
    )


def matrix_from_text(text: Column) -> Column:
    """``array<array<double>>`` of the first ``[[...]]`` in a text; null if there is none."""
    found = F.regexp_extract(text, r"(?s)(\[\s*\[.*?\]\s*\])", 1)
    rows = F.regexp_replace(F.regexp_replace(found, r"\]\s*\[", "],["), r"(?<=[\d.])\s+(?=[\d.-])", ",")
    return F.from_json(F.when(found != "", F.regexp_replace(rows, r"\s+|(?<=\d)\.(?=[,\]\s])", "")), "array<array<double>>")


# Fixed value: a row of a validation report: name, images, instances, then P R mAP50 mAP50-95 of boxes and of masks.
REPORT_ROW = r"([a-zA-Z0-9_\- ]+)\s+(\d+)\s+(\d+)" + r"\s+([\d.]+)" * 8
#: Class rows of a report that are read at most, after the row of all classes.
CLASS_ROWS = 11


def class_rows(text: Column) -> Column:
    """Rows of a validation report as an array of structs: the mask's measures."""
    parts = [F.regexp_extract_all(text, F.lit(REPORT_ROW), F.lit(i)) for i in (1, 8, 9, 10, 11)]
    return F.transform(
        F.arrays_zip(*parts),
        lambda r: F.struct(
            F.trim(r["0"]).alias("name"), r["1"].cast("double").alias("precision"), r["2"].cast("double").alias("recall"),
            r["3"].cast("double").alias("map50"), r["4"].cast("double").alias("map50_95"),
        ),
    )


def report_precision(text: Column, ignore: list[int] | None = None) -> Column:
    """``map50, map50_95`` of the first row; with a list of classes to ignore, the means over the class rows after it, 0
    if there is none."""
    rows = class_rows(text)
    if ignore is None:
        return F.get(F.transform(rows, lambda r: F.struct(r["map50"], r["map50_95"])), F.lit(0))
    kept = F.filter(F.slice(rows, 2, CLASS_ROWS), lambda r, i: ~i.isin(ignore) if ignore else F.lit(True))
    mean = lambda c: F.aggregate(kept, F.lit(0.0), lambda a, r: a + r[c]) / F.greatest(F.size(kept), F.lit(1))
    return F.struct(mean("map50").alias("map50"), mean("map50_95").alias("map50_95"))


def mean_average_precision(text: Column, ignore: list[int] | None = None) -> Column:
    """mAP50 of ``report_precision``."""
    return report_precision(text, ignore)["map50"]


def position_means(df: DataFrame, values: str, digits: int = 6) -> DataFrame:
    """``at, n, mean`` over arrays that hold a value for each class."""
    rows = df.select(F.posexplode(values).alias("at", "v"))
    return rows.groupBy("at").agg(F.count("*").alias("n"), F.round(F.avg(F.col("v").cast("double")), digits).alias("mean"))


def grid(results: DataFrame, given: dict[str, list], seen: list[str]) -> DataFrame:
    """Every combination of ``given`` values and of the values of the columns ``seen``, with the number ``n`` of results of
    it. Settings are counted first, so that combinations are made of a few values only."""
    keys = [*given, *seen]
    counts = results.groupBy(*keys).agg(F.count("*").alias("n"))
    sets = results.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in seen])
    for name, values in given.items():
        sets = sets.withColumn(name, F.array(*map(F.lit, values)))
    for c in keys:
        sets = sets.withColumn(c, F.explode(c))
    return sets.join(counts, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
