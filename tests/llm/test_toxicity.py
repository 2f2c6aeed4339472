"""Operator 12: held-out accuracy, inputs that must not count, odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from quadrat.llm import toxicity
from quadrat.llm.common import table

SF = "/root/testdata/sf0.01"
DOCS, LABELS = "doc_id long, text string, held_out int, toxic int, score string", "doc_id long, quality int, toxic int"


def made(n=600, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "er", "th", "ou", "st"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words, bad = [word() for _ in range(rng.randint(20, 200))], rng.random() < 0.3
        if bad:
            for _ in range(rng.randint(2, 6)):
                words.insert(rng.randint(0, len(words)), rng.choice(["Idiot", "clown!", "worthless,"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 0, int(bad)))
    return docs, labels


def scored(spark, docs, labels, **more):
    docs = spark.createDataFrame([(*d, 1, 2, "s") for d in docs], DOCS).repartition(3)
    return toxicity.toxicity(docs, spark.createDataFrame(labels, LABELS), **more).collect()


def test_held_out(spark):
    docs, labels = made()
    truth = {i: t for i, _, t in labels}
    held = [r for r in scored(spark, docs, labels) if r.held_out]
    assert len(held) > 60 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in held)


def test_held_out_of_supplied_documents(spark):
    labels = table(spark, SF, "labels")
    rows = toxicity.toxicity(table(spark, SF, "documents"), labels).where("held_out").join(labels, "doc_id")
    right, n = rows.agg(F.sum((F.col("predicted") == F.col("toxic")).cast("int")), F.count("*")).first()
    assert right >= 0.94 * n


def test_held_out_labels_do_not_count(spark):
    docs, labels = made(200)
    turned = [(i, q, 1 - t if toxicity_held(i) else t) for i, q, t in labels]
    a, b = (sorted((r.doc_id, r.score) for r in scored(spark, docs, x)) for x in (labels, turned))
    assert a == b


def toxicity_held(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 == 0


def test_odd_rows(spark):
    docs, labels = made(150)
    odd = [(900, None), (901, ""), (902, " 12 .\n"), (None, "idiot clown"), (903, docs[0][1]), (904, docs[0][1]), (905, "x" * 300_000), (906, "an idiot " * 40_000)]
    rows = scored(spark, docs + odd, [*labels, (3, None, None), (3, 0, 0), (None, 0, 1)])
    score = {r.doc_id: r.score for r in rows}
    assert len(rows) == len(docs) + len(odd) and score[900] == score[901] == score[902] and score[903] == score[904] == score[0]
    assert next(r for r in rows if r.doc_id is None).held_out is False
    assert {r.score for r in scored(spark, odd, [])} == {scored(spark, odd, [])[0].score}
    assert scored(spark, [], labels) == []


def test_words_of_any_length():
    text = "Ab" * toxicity.SLICE + " c1d"
    assert [w for part in toxicity.windows(text) for w in part] == [b"ab" * toxicity.SLICE, b"c", b"d"]
    distance = toxicity.Distance(b" idiot  clown ", b" the  and ")
    assert distance.of(b"idiot") > distance.of(b"garden") >= distance.of(b"the")
    with pytest.raises(StopIteration):
        next(toxicity.windows(""))
