"""Counts, balance and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrat.session import md5_order, ranked_by_key, ranked_randomly, stored


def count_by_field(df: DataFrame, field: str) -> DataFrame:
    if field not in df.columns:
        raise ValueError(f"no such field: {field}")
    return df.groupBy(field).agg(F.count("*").alias("n"))


def count_by_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """``field, value, n`` of several fields at once: one pass with grouping sets."""
    fields = [f for f in fields if f in df.columns]
    columns = [F.col(f).cast("string").alias(f) for f in fields]
    grouped = df.select(*columns).groupingSets([[f] for f in fields], *fields).agg(F.count("*").alias("n"), F.grouping_id().alias("_g"))
    bits = {f: (1 << len(fields)) - 1 - (1 << (len(fields) - 1 - i)) for i, f in enumerate(fields)}
    name = F.coalesce(*[F.when(F.col("_g") == g, f) for f, g in bits.items()])
    value = F.coalesce(*[F.when(F.col("_g") == g, F.col(f)) for f, g in bits.items()])
    return grouped.select(name.alias("field"), value.alias("value"), "n")


def balance(df: DataFrame) -> DataFrame:
    """Label states per data set, per split and overall, in one pass; ``balanced`` is the size after balancing."""
    n, e = F.count_if(F.col("state") == "non_empty"), F.count_if(F.col("state") == "empty")
    out = df.groupingSets([["dataset"], ["split"], []], "dataset", "split").agg(
        F.count("*").alias("total"), n.alias("non_empty"), e.alias("empty"), F.grouping_id().alias("_g")
    )
    both = (F.col("non_empty") > 0) & (F.col("empty") > 0)
    return out.select(
        F.when(F.col("_g") == 1, "dataset").when(F.col("_g") == 2, "split").otherwise("all").alias("level"),
        F.coalesce("dataset", "split", F.lit("all")).alias("name"), "total", "non_empty", "empty",
        F.when(both, 2 * F.least("non_empty", "empty")).otherwise(F.greatest("non_empty", "empty")).alias("balanced"),
    )


#: Hex digits of a random order by which rows are counted before any is ranked.
_DIGITS = 3


def balance_sample(df: DataFrame, key: str, seed: int = 42, preserve_all_non_empty: bool = False, by: str = "split") -> DataFrame:
    """Images so that states are even in each split: a random part of the larger side goes. Splits without a non-empty
    image are left out; without an empty one, all stay.

    The rows are counted by the first digits of their random order. Those counts tell in which of these buckets the last
    row of a side lies that stays; what lies before it stays unranked, and that bucket alone is ranked. The input is
    computed once."""
    order = md5_order(seed, key)
    rows = stored(df.where(F.col("state").isin("non_empty", "empty")).withColumn("_bucket", F.substring(order, 1, _DIGITS)))
    counts = stored(rows.groupBy(by, "state", "_bucket").agg(F.count("*").alias("_n")))
    total = lambda state: F.sum(F.when(F.col("state") == state, F.col("_n")).otherwise(0))
    sizes = counts.groupBy(by).agg(total("non_empty").alias("_ne"), total("empty").alias("_em"))
    low = F.least("_ne", "_em")
    quota = F.when(F.col("_em") == 0, F.col("_ne")).when(
        F.lit(preserve_all_non_empty), F.when(F.col("state") == "non_empty", F.col("_ne")).otherwise(low)
    ).otherwise(low)
    upto = F.sum("_n").over(Window.partitionBy(by, "state").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_upto", upto).join(sizes, counts[by].eqNullSafe(sizes[by])).drop(sizes[by])
    placed = placed.where("_ne > 0").withColumn("_quota", quota).where(F.col("_upto") - F.col("_n") < F.col("_quota"))
    # of each side, the bucket that the quota ends in, and how many of its rows stay
    last = F.max_by(F.struct("_bucket", (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("room"), "_n"), "_bucket")
    ends = stored(placed.groupBy(by, "state").agg(last.alias("_e")).select(by, "state", F.col("_e._bucket").alias("_last"), "_e.room", F.col("_e._n").alias("_all")))
    few = F.broadcast(ends) if ends.count() <= 10_000 else ends
    joined = rows.join(few, rows[by].eqNullSafe(few[by]) & (rows["state"] == few["state"])).drop(few[by], few["state"])
    before = joined.where((F.col("_bucket") < F.col("_last")) | (F.col("_bucket") == F.col("_last")) & (F.col("room") >= F.col("_all")))
    edge = joined.where((F.col("_bucket") == F.col("_last")) & (F.col("room") < F.col("_all")))
    edge = edge.withColumn("_rn", F.row_number().over(Window.partitionBy(by, "state").orderBy(order, key))).where("_rn <= room")
    return before.select(*df.columns).unionByName(edge.select(*df.columns))


def every_nth(df: DataFrame, key: str, n: int, start: int = 0) -> DataFrame:
    """Rows start, start + n, ... in the order of a numeric key."""
    at = F.col("_rn") - 1 - start
    return ranked_by_key(df, key, "_rn").where((at >= 0) & (at % n == 0)).drop("_rn")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    return ranked_randomly(df, seed, key, "_rn").where(F.col("_rn") <= n).drop("_rn")


def first_negatives(df: DataFrame, key: str) -> DataFrame:
    """All non-empty images and as many of the first empty ones."""
    quota = df.agg(F.count_if(F.col("state") == "non_empty").alias("_n"))
    ranks = ranked_by_key(df.where("state = 'empty'"), key, "_rn").crossJoin(F.broadcast(quota))  # one row
    return df.where("state = 'non_empty'").unionByName(ranks.where("_rn <= _n").drop("_rn", "_n"))


def fraction_head(df: DataFrame, key: str, share: float) -> DataFrame:
    total = df.agg(F.floor(F.count("*") * share).alias("_n"))
    return ranked_by_key(df, key, "_rn").crossJoin(F.broadcast(total)).where("_rn <= _n").drop("_rn", "_n")  # one row


def nested_buckets(df: DataFrame, key: str, seed: int, n_val: int = 15, n_test: int = 15, size: int = 10, most: int = 100) -> DataFrame:
    """``bucket`` of each row after a shuffle: val, test, then train_10, train_20, ... (train_k holds ranks up to k)."""
    at = F.col("_rn") - n_val - n_test
    name = (
        F.when(F.col("_rn") <= n_val, "val")
        .when(F.col("_rn") <= n_val + n_test, "test")
        .otherwise(F.concat(F.lit("train_"), (F.floor((at - 1) / size) * size + size).cast("string")))
    )
    ranks = ranked_randomly(df, seed, key, "_rn")
    return ranks.where(at <= most).withColumn("bucket", name).drop("_rn")


def state_of(images: DataFrame, files: DataFrame, key: str = "stem") -> DataFrame:
    """``images`` with the state of their label files (key, length)."""
    return images.join(files.select(key, F.col("length").alias("_length")), key, "left").withColumn(
        "state", F.when(F.col("_length") > 0, "non_empty").when(F.col("_length") == 0, "empty").otherwise("missing")
    ).drop("_length")


def only_in_one(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side only."""
    left = a.select(key).join(b.select(key), key, "left_anti").withColumn("missing_in", F.lit("b"))
    return left.unionByName(b.select(key).join(a.select(key), key, "left_anti").withColumn("missing_in", F.lit("a")))


def by_suffix(df: DataFrame, name: str, then: str, into: str = "rn") -> DataFrame:
    """Rank by the number that a name ends in."""
    rows = df.withColumn("_suffix", F.regexp_extract(name, r"(\d+)$", 1).cast("long"))
    return ranked_by_key(rows, "_suffix", into, [then]).drop("_suffix")


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def cumulative_folders(df: DataFrame, bucket: str, folders: list[str]) -> DataFrame:
    """``folder, n``: nested folders that hold all rows whose bucket is below the number in their name; buckets are
    counted before they are dealt to folders."""
    counts = df.groupBy(F.col(bucket).alias("_b")).agg(F.count("*").alias("_n"))
    dealt = counts.select("_n", "_b", F.explode(F.array(*map(F.lit, folders))).alias("folder"))
    inside = dealt.where(F.col("_b") < F.regexp_extract("folder", r"_(\d+)", 1).cast("int"))
    return inside.groupBy("folder").agg(F.sum("_n").alias("n"))
