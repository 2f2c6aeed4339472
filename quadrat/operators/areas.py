"""Label areas: statistics, histograms, bounds, extremes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.session import ranked_by_key, running, stored

PERCENTILES = (1, 5, 10, 25, 50)


def percentiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """``by, q0, q1, ...``: linear percentiles from counts of distinct values and their running sums, so that no task
    holds all values of a group."""
    groups = by or []
    counts = stored(df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n")))
    upto = running(counts, {"_upto": "_n"}, value, groups, once=True)
    sizes = counts.groupBy(*groups).agg(F.sum("_n").alias("_all"))
    joined = upto.join(sizes, [upto[g].eqNullSafe(sizes[g]) for g in groups]).drop(*[sizes[g] for g in groups]) if groups else upto.crossJoin(F.broadcast(sizes))  # one row
    place = [(F.col("_all") - 1) * F.lit(float(s)) for s in shares]
    first = lambda at: F.min(F.when(F.col("_upto") > at, F.col(value)))
    ends = [c for i, p in enumerate(place) for c in (first(F.floor(p)).alias(f"_l{i}"), first(F.ceil(p)).alias(f"_h{i}"), F.max(p - F.floor(p)).alias(f"_w{i}"))]
    found = joined.groupBy(*groups).agg(*ends)
    line = lambda i: F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_w{i}")
    return found.select(*groups, *[line(i).alias(f"q{i}") for i in range(len(shares))])


def area_statistics(df: DataFrame, area: str, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Count, least, largest, mean, median and linear percentiles; for all rows or by group."""
    groups = by or []
    out = df.groupBy(*groups).agg(
        F.count("*").alias("n"), F.min(area).alias("least"), F.max(area).alias("largest"), F.round(F.avg(area), digits).alias("mean")
    )
    q = percentiles(df, area, [p / 100 for p in PERCENTILES], groups)
    joined = out.join(q, [out[g].eqNullSafe(q[g]) for g in groups], "left").drop(*[q[g] for g in groups]) if groups else out.crossJoin(F.broadcast(q))  # one row
    return joined.select(
        *groups, "n", "least", "largest", "mean", *[F.round(f"q{i}", digits).alias(f"p{p}") for i, p in enumerate(PERCENTILES)]
    )


def select_labels(
    df: DataFrame, area: str, class_ids: list[int] | int | None = None, max_area: float | None = None,
    percentile: float | None = None, positive: bool = False,
) -> DataFrame:
    """Class filter, upper bound, percentile bound of what is left, and positive areas, in that order. A percentile
    outside (0, 1) counts as 0.05."""
    if class_ids is not None:
        df = df.where(F.col("class_id").isin([class_ids] if isinstance(class_ids, int) else list(class_ids)))
    if max_area is not None:
        df = df.where(F.col(area) <= max_area)
    if percentile is not None:
        p = percentile if 0 < percentile < 1 else 0.05
        bound = percentiles(df, area, [p]).withColumnRenamed("q0", "_bound")
        df = df.crossJoin(F.broadcast(bound)).where(F.col(area) <= F.col("_bound")).drop("_bound")  # one row
    return df.where(F.col(area) > 0) if positive else df


def histogram(df: DataFrame, area: str, bins: int = 50) -> DataFrame:
    """Bins of equal width from least to largest, the last one closed; empty bins are there with 0."""
    span = df.agg(F.min(area).alias("low"), F.max(area).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(area) - F.col("low")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = df.crossJoin(F.broadcast(span)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = span.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "low", width.alias("width"))
    return grid.join(F.broadcast(counts), "bin", "left").select(  # at most one row a bin
        "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("from_area"), F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def smallest(df: DataFrame, area: str, n: int, ties: list[str]) -> DataFrame:
    return df.orderBy(area, *ties).limit(n)


def closest(df: DataFrame, area: str, target: float, ties: list[str]) -> DataFrame:
    """The label whose area is nearest to the target, first by ``ties`` among equals."""
    return df.orderBy(F.abs(F.col(area) - target), *ties).limit(1)


def closest_to_each(df: DataFrame, area: str, targets: DataFrame, ties: list[str]) -> DataFrame:
    """The nearest label of each of a small table of targets (``target``): one aggregation, no sort of all labels."""
    key = F.struct(F.abs(F.col(area) - F.col("target")).alias("gap"), *ties)
    rest = [c for c in df.columns]
    joined = df.crossJoin(targets)  # a parameter list
    return joined.groupBy("target").agg(F.min_by(F.struct(*rest), key).alias("_one")).select("target", "_one.*")


def filter_small(labels: DataFrame, thresholds: DataFrame, area: str, tokens: Column | None = None, min_tokens: int = 9) -> DataFrame:
    """``labels`` with ``counted`` and ``kept``. A line is kept if it is too short to be a polygon (not counted), if its
    class has no threshold, or if its area reaches the threshold."""
    long_enough = F.lit(True) if tokens is None else tokens >= min_tokens
    joined = labels.join(thresholds, "class_id", "left")
    known = F.col("min_area").isNotNull()
    return joined.withColumns(
        {"counted": long_enough & known, "kept": ~long_enough | ~known | (F.col(area) >= F.col("min_area"))}
    )


def filter_statistics(judged: DataFrame, by: list[str]) -> DataFrame:
    """Processed, kept, removed and the share removed, of each group."""
    kept, counted = F.col("kept").cast("int"), F.col("counted").cast("int")
    return judged.groupBy(*by).agg(
        F.sum(counted).alias("processed"), F.sum(kept * counted).alias("kept"),
        F.sum((1 - kept) * counted).alias("removed"),
        F.round(100.0 * F.sum((1 - kept) * counted) / F.greatest(F.sum(counted), F.lit(1)), 4).alias("removed_pct"),
    )


def reset_groups(df: DataFrame, size: str, order: str, limit: int, by: list[str]) -> DataFrame:
    """``df`` with the number of the output ``folder`` that each row goes to, by the counter that starts at 0 in each
    folder: the next folder begins with the row that would bring the files so far to ``limit`` (a row of ``limit`` files
    or more always does, the first one too). ``order`` is different in all rows of a data set; sizes aren't negative.

    A row that begins a folder knows by prefix sums which row begins the next one: a search in sorted sums, for all rows
    at once. From the first row of each data set, jumps of doubled length find all that do begin one.
    """
    keys = [*by, order]
    rows = ranked_by_key(df.select(*keys, F.col(size).cast("long").alias("_s")), order, "_at", within=by)
    rows = stored(running(rows, {"_sum": "_s"}, order, by))
    places = rows.select(*by, F.col("_sum").alias("_v"), F.lit(1).alias("_row"), F.col("_at").alias("_next"), F.lit(None).cast("int").alias("_at"))
    start = F.col("_sum") - F.col("_s") + limit
    asked = rows.where(F.col("_s") < limit).select(*by, start.alias("_v"), F.lit(0).alias("_row"), F.lit(None).cast("int").alias("_next"), "_at")
    found = running(places.unionByName(asked), {"_to": "_next"}, "_v", by, ["_row", "_next"], kind="min", backwards=True).where("_row = 0 AND _to IS NOT NULL")
    alone = rows.where(F.col("_s") >= limit).select(*by, "_at", (F.col("_at") + 1).alias("_to"))
    jump = stored(found.select(*by, "_at", "_to").unionByName(alone))
    begun = stored(rows.where("_at = 1").select(*by, "_at"))
    n = -1
    while (many := begun.count()) != n:  # after k rounds the first 2^k folders are known
        n = many
        onward = begun.join(jump, [*by, "_at"]).select(*by, F.col("_to").alias("_at"))
        last = rows.select(*by, "_at")
        begun = stored(begun.unionByName(onward.join(last, [*by, "_at"], "left_semi")).distinct())
        there = jump.select(*by, F.col("_at").alias("_to"), F.col("_to").alias("_far"))
        jump = stored(jump.join(there, [*by, "_to"]).select(*by, "_at", F.col("_far").alias("_to")))
    marks = rows.join(begun.withColumn("_new", F.lit(1)), [*by, "_at"], "left")
    # the folder in which a data set begins is 0, or 1 if its first row alone fills one
    marks = marks.withColumn("_new", F.when((F.col("_at") == 1) & (F.col("_s") < limit), 0).otherwise(F.coalesce("_new", F.lit(0))))
    numbered = running(marks.select(*keys, "_new"), {"folder": "_new"}, order, by).drop("_new")
    return df.join(numbered, keys)
