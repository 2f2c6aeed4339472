"""Operator 10 reports passages of over 50 words that another row has, also those of under 400 bytes."""

import random

import numpy as np
import pytest

from quadrat.llm import passages, rolling, suffix

DOCS = "doc_id long, text string"


def slow_shared(rows, n):
    """Words in strings of ``n`` words that another row has, and their runs, row by row."""
    texts = [(t or "").encode().split() for _, t in rows]
    where = {}
    for row, x in enumerate(texts):
        for i in range(len(x) - n + 1):
            where.setdefault(tuple(x[i : i + n]), set()).add(row)
    out = []
    for (doc, _), x in zip(rows, texts):
        own = [False] * len(x)
        for i in range(len(x) - n + 1):
            if len(where[tuple(x[i : i + n])]) > 1:
                own[i : i + n] = [True] * n
        out.append((str(doc), sum(own), sum(g and not (i and own[i - 1]) for i, g in enumerate(own))))
    return sorted(out)


def shared(spark, rows, **options):
    got = suffix.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(3), **options).collect()
    return sorted((str(r.doc_id), r.n_shared_words, r.n_passages) for r in got)


def text_of(rng, n, alphabet="abcdé"):
    return "".join(rng.choice(["", " "]) + "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4))) + rng.choice(" \n\t") for _ in range(n))


def test_short_passages_of_over_50_words(spark):
    """51 words of under 400 bytes, parted by other white space in the second document; 50 words are too few."""
    rng = random.Random(51)
    passage, few = [text_of(rng, n).split() for n in (51, 50)]
    own = lambda: text_of(rng, 30, "fghij")
    rows = [
        (1, own() + " " + " ".join(passage) + " " + own()), (2, own() + "\n" + "\n ".join(passage) + "\n" + own()),
        (3, own() + " " + " ".join(few) + " " + own()), (4, own() + " " + " ".join(few) + " " + own()),
        (5, own() * 2), (6, " ".join([" ".join(passage[:50]), own(), " ".join(passage[1:])])), (7, None), (8, ""),
    ]
    got = suffix.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: (r.n_shared_words, r.n_passages) for r in got} == {i: (51, 1) if i < 3 else (0, 0) for i in range(1, 9)}
    assert not any(r.n_removed for r in got if r.doc_id < 5)


@pytest.mark.parametrize("n", [6, 20, 51])
def test_shared_passages(spark, n):
    rng = random.Random(n)
    common, rows = [text_of(rng, rng.randint(n // 2, 4 * n)) for _ in range(8)], []
    for doc in range(80):
        parts = []
        for _ in range(rng.randint(0, 4)):
            words = rng.choice(common).split()
            if rng.random() < 0.4:
                words[rng.randrange(len(words))] = "x"
            if rng.random() < 0.4:
                words = words[rng.randrange(len(words)) :]
            parts += [" ".join(words), text_of(rng, rng.randint(0, 2 * n))]
        rows.append((doc if doc % 10 else None, " ".join(parts) if doc % 13 else None))
    twice = text_of(rng, 2 * n, "klm")
    rows += [rows[5], rows[5], (900, "a " * 5 * n), (901, twice + " " + twice), (None, text_of(rng, n, "nop"))]
    rows += [rows[-1], (902, " a" * (2 * n) + " b"), (903, " é " * 3 * n)]
    assert shared(spark, rows, words=n) == slow_shared(rows, n)


def test_shared_passages_of_small_lots(spark, monkeypatch):
    """Texts and words longer than a lot; the passages are the same."""
    rng = random.Random(3)
    for module in (passages, rolling):
        monkeypatch.setattr(module, "CHUNK", 64)
    monkeypatch.setattr(passages, "MOST", 96)
    long, common = "y" * 97, text_of(rng, 60)
    texts = [
        t.encode()
        for t in (common + " " + long + " " + common, "", "z" * 500, text_of(rng, 90) + common, " " + "w" * 96 + " " + long, long + " w", common[:40])
    ]
    words = passages.words_of(texts)
    assert [len(w) for w in words] == [len(t.split()) for t in texts]
    names = {}
    for got, text in zip(words, texts):
        for h, w in zip(got.tolist(), text.split()):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    found = {}
    for lot in passages.find_anchors(words, 12, 1):
        for text, lo, hi in zip(lot.text.tolist(), lot.lo.tolist(), lot.hi.tolist()):
            found.setdefault(text, []).extend(range(lo, hi + 1))
        whole = np.split(lot.places, lot.begins[1:])
        assert [len(p) for p in whole] == (lot.hi - lot.lo + 1).tolist()
    assert found == {i: list(range(len(w) - 11)) for i, w in enumerate(words) if len(w) > 11}


def test_no_passages(spark):
    assert shared(spark, [(1, None), (2, ""), (2, " \n"), (3, "a b")]) == [("1", 0, 0), ("2", 0, 0), ("2", 0, 0), ("3", 0, 0)]
