"""Operator 4's probabilities come from every pre-token of every text."""

import math
import random
from collections import Counter

import pytest

from quadrat.llm import tokencount
from quadrat.llm.queries import vocabulary

PATH = vocabulary("piece_bpe_32k.model")
DOCS = "doc_id long, text string"


def slow_fit(texts, pieces, rounds=2):
    """Two rounds of best segmentations by slices, word by word."""
    words = Counter(w for t in texts for w in (t or "").split())
    longest = max(map(len, pieces))
    scores = [-math.log(r + 1) - math.log(sum(1 / (r + 1) for r in range(len(pieces)))) for r in range(len(pieces))]
    for _ in range(rounds):
        known, byte = dict(zip(pieces, scores)), -math.log(256) + min(scores)
        counts = Counter()
        for word, n in words.items():
            w = "▁" + word
            best = [(0.0, 0)]
            for end in range(1, len(w) + 1):
                ways = [(best[s][0] + known[w[s:end]], end - s) for s in range(max(0, end - longest), end) if w[s:end] in known]
                if w[end - 1] not in known:
                    ways.append((best[end - 1][0] + len(w[end - 1].encode()) * byte, 1))
                best.append(max(ways))
            end = len(w)
            while end:
                start = end - best[end][1]
                counts[w[start:end]] += n
                end = start
        total = sum(counts[p] for p in pieces) + len(pieces)
        scores = [math.log(counts[p] + 1) - math.log(total) for p in pieces]
    return scores


def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéü漢.,9") for _ in range(rng.randint(1, 12)))
    made = [" ".join(word() for _ in range(400)) for _ in range(12)]  # four times as long as a window of the sample
    odd = [None, "", " \n\t", "a", "a b\x1cc d", "quick" * 200 + " quick", "\U0001f600 " * 3, "the the the"]
    return [*made, *odd, made[0]]


def test_fit_reads_every_pretoken(spark):
    rows = [(i % 5, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, DOCS)
    want = slow_fit([t for _, t in rows], tokencount.vocabulary_of(PATH))
    for parts in (1, 4):
        model = tokencount.fitted(docs.repartition(parts), PATH)
        assert model.scores == pytest.approx(want, rel=1e-12)
    assert tokencount.fit([t or "" for _, t in rows], tokencount.vocabulary_of(PATH)).scores == model.scores
    key = lambda r: (r.doc_id, r.n_tokens, r.forward_logprob)
    given = sorted(tokencount.token_counts(docs, PATH, tokencount.Unigram(want)).collect(), key=key)
    own = sorted(tokencount.token_counts(docs.repartition(3), PATH).collect(), key=key)
    assert [r[:3] for r in own] == [r[:3] for r in given]
    assert [r.forward_logprob for r in own] == pytest.approx([r.forward_logprob for r in given], rel=1e-9)


def test_last_words_of_long_texts_count(spark):
    """A word that stands once in each long text, in other places, changes the probabilities wherever it stands."""
    docs = [(i, " ".join(["a"] * (500 * i) + ["zebra"] + ["b"] * (3000 - 500 * i))) for i in range(6)]
    words = {r.word: r.n for r in tokencount.pretokens(spark.createDataFrame(docs, DOCS).repartition(3)).collect()}
    assert words == {"a": 7500, "b": 10500, "zebra": 6}


def test_empty_table_fits(spark):
    docs = spark.createDataFrame([(1, None), (2, " ")], DOCS)
    flat = tokencount.fitted(docs, PATH).scores
    assert len(set(flat)) == 1 and math.fsum(map(math.exp, flat)) == pytest.approx(1.0)
    assert tokencount.token_counts(docs.limit(0), PATH).count() == 0


def test_words_are_split_as_python_splits_them(spark):
    blanks = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    text = "a".join(blanks) + "z" + "".join(blanks)
    rows = tokencount.token_counts(spark.createDataFrame([(1, text), (2, "b")], DOCS), PATH).collect()
    assert {r.doc_id: r.n_pretokens for r in rows} == {1: len(text.split()), 2: 1}


def test_pieces_of_long_words(monkeypatch):
    pieces = tokencount.vocabulary_of(PATH)
    trie = tokencount.Trie(dict(zip(pieces, tokencount.zipf(len(pieces)))), -30.0)
    word = "quickly漢the" * 60
    whole = Counter(p for p in tokencount.segments(word, trie) if p in trie.pieces)
    assert "".join(reversed(list(tokencount.segments(word, trie)))) == tokencount.MARK + word
    assert len(word) > tokencount.LONG and tokencount.tally([(word, 3)], trie) == Counter({p: 3 * n for p, n in whole.items()})
    monkeypatch.setattr(tokencount, "LONG", 10_000)
    assert tokencount.tally([(word, 3)], trie) == Counter({p: 3 * n for p, n in whole.items()})
