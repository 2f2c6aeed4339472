"""Session settings, intermediate tables and global ranks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def session(app: str = "quadrat", **conf: str) -> SparkSession:
    """A session as the library wants it: UTC, adaptive execution with skew joins."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, deleted when the session ends. ``spark.checkpoint.dir``
    names that folder; without it, a folder of this machine serves a local session only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    path = f"{named.rstrip('/')}/{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def md5_order(seed: int | str, *keys: Column | str) -> Column:
    """A reproducible random order: the md5 of seed and key. The same in any SQL engine."""
    texts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *texts).cast("binary"))


def ranked(df: DataFrame, order: list[Column], bucket: Column, into: str = "rn", within: list[str] | None = None) -> DataFrame:
    """``df`` with its global rank from 1 in ``order`` (per group of ``within``), without sorting all rows in one task.

    ``bucket`` must not fall along ``order``. Rows are ranked inside their bucket, and the numbers of rows in the
    buckets before are added. The table of counts has one row per bucket and group.
    """
    groups = within or []
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy(*order))
    keys = [*groups, "_bucket"]
    joined = rows.withColumn("_inside", inside)
    same = [joined[k].eqNullSafe(counts[k]) for k in keys]
    out = joined.join(counts, same)
    return out.select(*[joined[c] for c in df.columns], (F.col("_before") + F.col("_inside")).alias(into))


def ranked_randomly(df: DataFrame, seed: int | str, key: str, into: str = "rn", within: list[str] | None = None) -> DataFrame:
    """Rank in ``md5_order``; buckets are the first hex digits, hence even, and as many as the rows need."""
    order, digits = md5_order(seed, key), 1
    rows = df.count()
    while 16**digits * BUCKET_ROWS < rows:
        digits += 1
    return ranked(df, [order, F.col(key)], F.substring(order, 1, digits), into, within)


#: Rows that one task ranks or sums; of more, ranges are made.
BUCKET_ROWS = 250_000


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: it is computed once, however often it is used."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranges(df: DataFrame, keys: list[str], into: str = "_bucket") -> DataFrame | None:
    """A stored table with the number of the range that each row lies in, along the order of ``keys`` (nulls first), as
    many ranges as the rows need. None if one is enough. Equal rows of ``keys`` are in one range."""
    n = -(-df.count() // BUCKET_ROWS)
    return stored(df.repartitionByRange(n, *keys).withColumn(into, F.spark_partition_id())) if n > 1 else None


def ranked_by_key(df: DataFrame, key: str, into: str = "rn", then: list[str] = (), within: list[str] | None = None) -> DataFrame:
    """Rank by a column (nulls first), then by others. The input is computed once."""
    once, order = stored(df), [key, *then]
    dealt = ranges(once, order)
    if dealt is None:
        return once.withColumn(into, F.row_number().over(Window.partitionBy(*within or []).orderBy(*order)))
    return ranked(dealt, [F.col(c) for c in order], F.col("_bucket"), into, within).drop("_bucket").select(*df.columns, into)


def running(
    df: DataFrame, values: dict[str, str], key: str, within: list[str] | None = None, then: list[str] = (), kind: str = "sum",
    backwards: bool = False, once: bool = False,
) -> DataFrame:
    """``df`` with sums (or the largest or the least, by ``kind``) from the first row to this one in the order of ``key``,
    in each group of ``within``; ``backwards`` from the last row. ``values``: new column to column; all are taken in one
    pass. Inside ranges of the key by windows; a table with a row for each range and group adds what the others bring.
    The input is computed once (``once``: it is a stored table already)."""
    groups, total = within or [], {"sum": F.sum, "max": F.max, "min": F.min}[kind]
    rows = df if once else stored(df)
    dealt = ranges(rows, [key, *then])
    turn = (lambda c: F.col(c).desc()) if backwards else F.col
    upto = lambda keys: Window.partitionBy(*keys).orderBy(*map(turn, [key, *then])).rowsBetween(Window.unboundedPreceding, 0)
    if dealt is None:
        return rows.withColumns({into: total(v).over(upto(groups)) for into, v in values.items()})
    parts = dealt.groupBy(*groups, "_bucket").agg(*(total(v).alias(f"_p_{into}") for into, v in values.items()))
    others = Window.partitionBy(*groups).orderBy(turn("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*groups, "_bucket", *(total(f"_p_{into}").over(others).alias(f"_b_{into}") for into in values))
    inside = dealt.withColumns({f"_i_{into}": total(v).over(upto([*groups, "_bucket"])) for into, v in values.items()})
    out = inside.join(parts, [inside[k].eqNullSafe(parts[k]) for k in [*groups, "_bucket"]])
    both = {
        "sum": lambda into: F.col(f"_i_{into}") + F.coalesce(f"_b_{into}", F.lit(0)),
        "max": lambda into: F.greatest(f"_i_{into}", f"_b_{into}"),
        "min": lambda into: F.least(f"_i_{into}", f"_b_{into}"),
    }[kind]
    return out.select(*[inside[c] for c in df.columns], *(both(into).alias(into) for into in values))
