"""The event stream's windows against the same windows in one batch, row by row."""

from pyspark.sql import functions as F

from quadrat.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_stream_rows_equal_batch_rows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source = str(tmp_path / "in")
    events.orderBy("ts").repartitionByRange(3, "ts").write.parquet(source)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = ingest.windowed_counts(ingest.event_stream(spark, source), "1 hour", "1 hour")
    ingest.run_available(stream, out, state).awaitTermination()
    got = {(r.start, r.event_type): (r.n, round(r.value, 4)) for r in spark.read.parquet(out).collect()}
    want = {
        (r.start, r.event_type): (r.n, round(r.value, 4))
        for r in events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "value").collect()
    }
    # windows that end after the watermark, at most an hour under the latest event, are still open
    last = events.agg(F.max("ts")).first()[0]
    closed = {k: v for k, v in want.items() if (last - k[0]).total_seconds() >= 2 * 3600}
    assert closed and set(closed) <= set(got) <= set(want)
    assert all(got[k] == want[k] for k in got)
    # nothing new: a second run adds no row
    again = ingest.windowed_counts(ingest.event_stream(spark, source), "1 hour", "1 hour")
    ingest.run_available(again, out, state).awaitTermination()
    assert spark.read.parquet(out).count() == len(got)
