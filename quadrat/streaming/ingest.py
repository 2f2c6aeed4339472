"""Incremental label ingest and windows over events. The batch functions of the library work on these frames too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def label_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines of new label files."""
    return spark.readStream.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw")
    )


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events of a folder of Parquet files; its schema is taken from what is there."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and values of each window and type; state older than the watermark is dropped."""
    w = F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there, then stop; a later call goes on from the checkpoint."""
    return df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def run_resumable(source: DataFrame, work: Callable[[DataFrame], DataFrame], by: str, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there batch by batch, then stop. A run that breaks off goes on with the batch it broke off in: a
    batch's rows and its counters per ``by`` overwrite what an earlier attempt left, so nothing is lost or there twice."""

    def one(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        seen = batch.groupBy(by).agg(F.count("*").alias("processed"))
        seen.write.mode("overwrite").parquet(f"{path}/done/batch={number}")  # after the rows: what is counted is written

    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(spark: SparkSession, path: str, by: str) -> DataFrame:
    """``by, processed``: what finished batches have counted."""
    return spark.read.parquet(f"{path}/done").groupBy(by).agg(F.sum("processed").alias("processed"))
