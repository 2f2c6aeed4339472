"""Operator 11 against a plain trie, on odd rows and with chunks that cut conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quadrat.llm import prefixes

TURNS = "conv_id long, turn long, role string, text string, x1 long, c long, part int"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def slow_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [t[3:] for t in sorted(x)] for c, x in own.items()}
    nodes = defaultdict(list)
    ends = defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole = turns.get(base, [])[:h] + turns[c][h:]
        for d in range(len(whole) + 1):
            nodes[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    children = defaultdict(list)
    for path in nodes:
        if path:
            children[path[:-1]].append(path)
    below = {}
    for path in sorted(nodes, key=len, reverse=True):
        saved = (len(nodes[path]) - 1) * len(path[-1][1].encode()) if path else 0
        kids = [below[k] for k in children[path]]
        below[path] = (sum(k[0] for k in kids) if kids else 1, saved + sum(k[1] for k in kids))
    return sorted(
        (min(cs), len(p), min(nodes[p[:-1]]) if p else None, len(cs), len(children[p]), *below[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, cs in nodes.items()
    )


def trie(spark, rows, chunk=prefixes.CHUNK):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], TURNS).repartition(3)
    return sorted(tuple(r[n] for n in NAMES) for r in prefixes.prefix_trie(df, chunk).collect())


def made():
    rng = random.Random(8)
    rows = []
    for c in [*range(-7, 40), 10**12]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9, 14])):
            rows.append((c, turn if rng.random() < 0.9 else None, rng.choice(["user", None, ""]), rng.choice(["a", "é", "", None, "long " * 30])))
    rows += [(200 + k, t, "user", f"turn {t}") for k in range(6) for t in range(37)]  # copies, longer than a chunk
    rows += [(300, t, "user", f"turn {t}" if t < 30 else "x") for t in range(33)]
    return [*rows, *rows[:5], (None, 1, "user", "nobody")]


@pytest.mark.parametrize("chunk", [4, 1024])
def test_trie_equals_slow_version(spark, chunk):
    assert trie(spark, made(), chunk) == slow_trie(made())


def test_turnless_and_empty(spark):
    rows = [(6, 0, "user", "a"), (7, 0, "user", "b" * 100_000)]  # conversation 5 is absent
    assert trie(spark, rows) == slow_trie(rows)
    assert trie(spark, [(1, None, None, None)]) == slow_trie([(1, None, None, None)])
    assert trie(spark, []) == []


def test_hot_first_turn(spark, monkeypatch):
    """A third of all conversations are equal: their ids meet in blocks."""
    monkeypatch.setattr(prefixes, "BLOCK", 7)
    rows = [(c, t, "user", f"same {t}" if c % 3 == 0 else f"{c} {t}") for c in range(0, 300) for t in range(3)]
    assert trie(spark, rows) == slow_trie(rows)
