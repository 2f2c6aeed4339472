"""A training corpus from raw documents: five stages, each on all that the one before kept.

Defined cases, by stage:

* language: a null, empty or blank text, or one without a letter, goes, as its language can't be told; repeated rows are
  judged one by one; a score equal to the bar stays.
* near_dedup: equal rows and texts of equal shingle sets are copies; the one with the least id stays, of rows with one id
  one; a null id counts as no id.
* decontamination: repeated rows go or stay together; null and blank items of the benchmark match nothing.
* pii: no row goes; a text without personal data stays as it is.
* packing: repeated rows and null ids are packed one by one; a long text is cut into pieces, an empty one is its end id.

Very long texts are read whole by every stage. All stages but the last return the columns of their input, extra ones
with their values, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import decontaminate, langid, nearcopies, packing, pii
from quadrat.llm.common import stored, table
from quadrat.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard 0.8 or more, by operator 5's fingerprints
    and by least hashes."""
    return nearcopies.deduplicate(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; ``n_chars`` follows the text."""
    redacted = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return redacted
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the training sequences."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("pii", redact_pii),
    ("packing", pack),
]

#: The stages hash, align and tokenise; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
