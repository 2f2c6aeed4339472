"""Operator 1: a content-addressed WARC archive.

``write_archive`` keeps two tables: ``payloads`` holds the bytes of each distinct payload once, under its SHA-256;
``headers`` holds the exact header block of every record with the digest of the payload that belongs to it.
``read_archive`` gives the record table back from those two tables through a join on the digest, after it has
checked the stored bytes against both digests; ``reconstruct`` gives the records' own bytes.

Everything is built-in expressions. The only wide steps are one aggregation by digest (copies meet map-side, so a
payload that a third of all rows share is sent once per task) and joins of narrow rows on the digest, which adaptive
execution splits where one digest is frequent.

Defined cases: a null payload is empty; a null URL leaves its header out; a null id takes part as the smallest id
and is written as an empty id; repeated rows (same id, same payload) have the same role; an empty table gives empty
archives. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm.common import tune

#: Payloads shorter than this are stored as responses even if they repeat.
MIN_REVISIT_BYTES = 1000
_EOL = "\r\n"


def _line(name: str, value: Column) -> Column:
    """A header line, or null if the value is null (then concat_ws leaves it out)."""
    return F.concat(F.lit(f"{name}: "), value)


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _identified(pages: DataFrame, id_col: str, url_col: str, body_col: str) -> DataFrame:
    payload = F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8")
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.regexp_replace(F.col(url_col), r"[\r\n]+", "").alias("url"),
        payload.alias("payload"),
    ).select(
        "*",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("sha256"),
        F.sha1("payload").alias("sha1"),
    )


def write_archive(
    pages: DataFrame,
    path: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    warc_date: str = "1970-01-01T00:00:00Z",
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
) -> None:
    """Write ``{path}/payloads`` and ``{path}/headers``."""
    tune(pages.sparkSession)
    rows = _identified(pages, id_col, url_col, body_col)
    (
        rows.groupBy("sha256")
        .agg(F.any_value("payload").alias("payload"), F.max("page_id").alias("keeper"))
        .write.option("compression", "zstd")
        .parquet(f"{path}/payloads")
    )
    keepers = pages.sparkSession.read.parquet(f"{path}/payloads").select("sha256", "keeper")
    revisit = (F.col("payload_bytes") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    header = F.concat_ws(
        _EOL,
        F.lit("WARC/1.1"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Date", F.lit(warc_date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(revisit, _urn(F.col("keeper")))),
        _line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit(_EOL),
    )
    (
        rows.drop("payload")
        .join(keepers, "sha256")
        .select(F.encode(header, "UTF-8").alias("header"), "sha256")
        .write.option("compression", "zstd")
        .parquet(f"{path}/headers")
    )


def _field(name: str) -> Column:
    """The value of a header line; null if there is none."""
    found = F.regexp_extract(F.decode(F.col("header"), "UTF-8"), rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The record table of an archive, every value taken from what is stored.

    A stored payload whose bytes do not give its SHA-256 again, or a record whose SHA-1 header differs from that of
    its payload, ends the read with an error.
    """
    stored = spark.read.parquet(f"{path}/payloads").select(
        "sha256",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        F.when(F.sha2("payload", 256) == F.col("sha256"), True)
        .otherwise(F.raise_error(F.lit("a stored payload does not have its digest")).cast("boolean"))
        .alias("sound"),
    )
    heads = spark.read.parquet(f"{path}/headers").select(
        "sha256",
        F.regexp_extract(_field("WARC-Record-ID"), r"<urn:page:(-?\d*)>", 1).alias("rid"),
        F.regexp_extract(_field("WARC-Refers-To"), r"<urn:page:(-?\d*)>", 1).alias("ref"),
        _field("WARC-Type").alias("record_type"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("said"),
    )
    return (
        heads.join(stored, "sha256")
        .where(F.col("sound"))
        .select(
            F.when(F.col("rid") != "", F.col("rid")).cast("long").alias("page_id"),
            "payload_bytes",
            F.when(F.col("said") == F.col("payload_digest"), F.col("payload_digest"))
            .otherwise(F.raise_error(F.lit("a record does not match its payload")).cast("string"))
            .alias("payload_digest"),
            "record_type",
            F.when(F.col("ref") != "", F.col("ref")).cast("long").alias("refers_to"),
        )
    )


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """``(header, record)``: the bytes of every record as a WARC file has them; revisits have no block."""
    heads = spark.read.parquet(f"{path}/headers").withColumn("record_type", _field("WARC-Type"))
    body = spark.read.parquet(f"{path}/payloads").select("sha256", "payload")
    end = F.encode(F.lit(_EOL * 2), "UTF-8")
    full = heads.where("record_type = 'response'").join(body, "sha256")
    bare = heads.where("record_type <> 'response'")
    return full.select("header", F.concat("header", "payload", end).alias("record")).unionByName(
        bare.select("header", F.concat("header", end).alias("record"))
    )
