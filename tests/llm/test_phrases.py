"""Operator 13 against a plain count, over borders of slices and with odd rows."""

import random
import re
from collections import Counter

import pytest

from quadrat.llm import phrases

DOCS = "doc_id long, lang string, text string, name long, n long, seen int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow(rows, least, top):
    f, n = Counter(), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = set()
    for (lang, w), a in found.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                part = (lang, w[i : i + size])
                if 100 * a >= 100 * f[part]:
                    covered.add(part)
    out = {}
    for (lang, w), a in found.items():
        if (lang, w) in covered:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, l, r = min(cuts)  # noqa: E741
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1))


def fast(spark, rows, least, top):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOCS).repartition(3)
    return sorted(tuple(r) for r in phrases.collocations(df, least, top).collect())


def made(seed=2, docs=60):
    rng = random.Random(seed)
    words = [*"abcdefgh", "Ä", "straße", "日本", "\x00", "it's", "x" * 30]
    rows = []
    for i in range(docs):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "?!"]) for _ in range(rng.randint(0, 120)))
        rows.append((i, rng.choice(["en", "de", None, "und"]), text + " New York City is big" * rng.randint(0, 3)))
    return [*rows, *rows[:9], (None, "en", None), (7, "fr", ""), (8, None, " ... ")]


@pytest.mark.parametrize("size", [1 << 20, 64])
def test_equals_slow_version(spark, size, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", size)  # of this process only: workers keep theirs, see test_slices
    rows = made()
    for least, top in ((10, 2000), (5, 12)):
        want = slow(rows, least, top)
        assert want and fast(spark, rows, least, top) == want


def test_slices_lose_nothing(monkeypatch):
    """Phrases of all slices together are those of the text, whatever the slices' size."""
    rng = random.Random(4)
    text = "".join(rng.choice(["aa", "b", "ccc", "d" * 200]) + rng.choice([" ", "  ", ". ", "\n"]) for _ in range(400)).encode()
    places, names, _, _ = phrases.words(text, 1)

    def counted(parts):
        out = Counter()
        for p, w, first in parts:
            here, there = phrases._merge_join(p[:first], p, 1)
            out.update(phrases._extended(w[:first][here], w[there]).tolist())
            for k in (2, 3, 4):
                hit, _ = phrases._merge_join(p[:first], p, k)
                out[k] += len(hit)
        return out

    whole = counted([(places, names, len(places))])
    for size in (1, 10, 100, 1000):
        monkeypatch.setattr(phrases, "SLICE", size)
        cut = list(phrases.slices(text))
        monkeypatch.setattr(phrases, "SLICE", 1 << 20)
        assert b"".join(d[:b] for d, b in cut) == text
        parts = []
        for data, border in cut:
            p, w, starts, _ = phrases.words(data, 1)
            parts.append((p, w, int((starts < border).sum())))
        assert counted(parts) == whole


def test_long_words_and_texts(spark):
    giant = "Y" * 3_000_000
    rows = [(i, "en", f"{giant} z {giant} z" if i < 2 else "p q " * 60_000) for i in range(4)]
    want = slow(rows, 4, 2000)
    assert fast(spark, rows, 4, 2000) == want and len(want) > 1


def test_exact_arithmetic(spark):
    """Products beyond 64 bits, by counts that are made instead of counted."""
    row = spark.sql("SELECT 3000000000000 AS a, 4000000000000 AS l, 5000000000000 AS r, 9000000000000 AS n")
    exact = "(cast(1000 * a as decimal(19)) * cast(n as decimal(19))) div (cast(l as decimal(19)) * cast(r as decimal(19)))"
    assert row.selectExpr(f"{exact} AS s").first().s == 1000 * 3 * 9 // 20


def test_empty(spark):
    assert fast(spark, [], 1, 10) == [] and fast(spark, [(1, None, None)], 1, 10) == []
