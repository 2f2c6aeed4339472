"""Every stage on nulls, empty and very long texts, ties, repeated rows, clashing columns and an empty table."""

import pytest

import corpus_pipeline as P
from quadrat.llm import langid
from quadrat.llm.common import stored

LONG = "the river runs through the old town and over the hills " * 4000
TEXT = "the children went down to the harbour early in the morning to see the boats come in from the sea"
ROWS = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t", None), (4, TEXT, "en"), (4, TEXT, "en"), (5, TEXT, "en"), (None, TEXT + " again", "en"),
    (6, LONG, "en"), (7, "Write to jane.doe@example.org or call +44 20 7946 0958 about the boats in the harbour", "en"),
    (8, "der Fluss und die alte Stadt am Meer sind im Winter sehr still und kalt", "de"), (9, "12345 67890", "en"),
]
#: Names that stages use for their own columns.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, fp long, node long, root long, key long, score double, spans string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("bench")
    rows = [(1, "what is the name of the tallest mountain on the northern island of the country", "a"), (2, None, "b"), (3, "", "c")]
    spark.createDataFrame(rows, "item_id long, text string, suite string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def docs_of(spark, rows):
    full = [(i, t, lang, "s", None if t is None else len(t), 1, 2, 3, 4, 0.5, "x") for i, t, lang in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def test_stages_on_odd_rows(spark, folder):
    docs = docs_of(spark, ROWS)
    seen = [docs]
    for _, stage in P.STAGES:
        seen.append(stored(stage(spark, seen[-1], folder)))
    language, near, clean, redacted, packed = ([r.asDict() for r in d.collect()] for d in seen[1:])
    assert all(d.columns == docs.columns for d in seen[:-1])
    # no letter, no language: null, empty, blank and numbers go; repeated rows, ties and the long text stay
    assert sorted(r["doc_id"] or 0 for r in language) == [0, 4, 4, 5, 6, 7, 8]
    # one of each group of copies: the least id, and of equal rows one
    assert sorted(r["doc_id"] or 0 for r in near) in ([4, 6, 7, 8], [0, 4, 6, 7, 8])
    assert len(clean) == len(near) == len(redacted)
    told = {r["doc_id"]: r["text"] for r in redacted}
    assert "[EMAIL]" in told[7] and "[PHONE]" in told[7] and told[6] == LONG
    assert all(r["n_chars"] == len(r["text"]) for r in redacted)
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in redacted}
    long = sorted((r["piece"], r["start"], r["length"]) for r in packed if r["doc_id"] == 6)
    assert len(long) > 1 and all(n == 4096 for _, _, n in long[:-1]) and [s for _, s, _ in long] == [4096 * i for i in range(len(long))]
    others = [r for r in docs.collect() if r.doc_id == 8]
    kept = [r for r in near if r["doc_id"] == 8]
    assert kept[0]["spans"] == others[0].spans and kept[0]["root"] == 3  # columns of the same name come through


def test_stages_on_no_rows(spark, folder):
    docs = docs_of(spark, ROWS).limit(0)
    for _, stage in P.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        docs = docs if out.columns != docs.columns else out


def test_language_bar(spark):
    """Documents under the least score go, those at it stay."""
    docs = docs_of(spark, [(i, TEXT, "en") for i in range(40)] + [(100 + i, "der Fluss und die alte Stadt am Meer sind still", "de") for i in range(40)])
    model = langid.train(docs.select("doc_id", "text", "lang"))
    tagged = langid.predict(docs.select("doc_id", "text"), model).collect()
    assert all(r.lang_pred in ("en", "de") and r.score >= 0.3 for r in tagged)
    assert langid.keep_identified(docs, 0.3).count() == 80
    least = min(r.score for r in tagged)
    assert langid.keep_identified(docs, min(1.0, least + 1e-3) if least < 1 else 1.1).count() < 80


def test_repeated_rows_are_dealt_to_all_groups(spark):
    from quadrat.llm import packing

    rows = spark.range(5000).selectExpr("cast(null as long) as doc_id", "0 as piece", "0L as start", "1L as length", "7L as ids_crc32")
    items = stored(rows.repartition(4))
    placed = packing._round(items, 10, 0, 4096).selectExpr("(sequence_id >> 28) & 1023 as g").groupBy("g").count().collect()
    assert len(placed) == 10 and max(r["count"] for r in placed) < 1000
