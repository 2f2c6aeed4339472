"""Operator 3: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

1. The words of the benchmark are counted in the whole corpus. A seed begins at each word of an item and is the shortest
   n-gram from there whose expected rate under independent words is at most ``RARE``. Being rare is thus a matter of its
   words, not of how often it was copied: a leak in every document still has its seeds.
2. Documents are scanned for seeds. Hits of an item near one diagonal, or a single one, make a candidate passage.
3. A candidate is aligned with the whole item by words (match 2, mismatch -1, gap -1). The score is the best local
   alignment's over that of the item with itself; a pair counts from ``MIN_SCORE`` on.

The benchmark goes to the workers in blocks of at most ``BLOCK_WORDS`` words, found by its measured size; every block is
held against all documents. There is no shuffle of documents and nothing grows with pairs.

Defined cases: a null or blank text or item matches nothing; items under ``SHORT`` words need every word; an item of
one word is no passage and is skipped, as it would take every document with that word; a null id is kept; repeated rows
give repeated rows; empty tables give no pairs. Extra columns are not read by ``leaks``; ``decontaminate`` keeps them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import tune

RARE = 1e-8
SHORT = 8
MIN_SCORE = 0.4
LONGEST_SEED = 12
BLOCK_WORDS = 500_000
MATCH, MISMATCH, GAP = 2, -1, -1
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(score, begin, end) of the best local alignment in the passage; the least end among equals."""
    n = len(passage)
    ramp = np.arange(n + 1) * -GAP
    row, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, begin, end = 0, 0, 0
    for word in item.tolist():
        score = np.zeros(n + 1, np.int64)
        score[1:] = row[:-1] + np.where(passage == word, MATCH, MISMATCH)
        origin = np.concatenate(([0], start[:-1]))
        up = row + GAP
        origin = np.where(up > score, start, origin)
        score = np.maximum(score, up)
        fresh = score <= 0
        score[fresh] = 0
        origin = np.where(fresh, np.arange(n + 1), origin)
        reach = np.maximum.accumulate(score + ramp)  # a gap along the passage
        came = np.maximum.accumulate(np.where(score + ramp == reach, np.arange(n + 1), 0))
        row, start = reach - ramp, origin[came]
        at = int(row.argmax())
        if row[at] > best:
            best, begin, end = int(row[at]), int(start[at]), at
    return best, begin, end


class Index:
    """A block of the benchmark with its seeds."""

    def __init__(self, items: list[tuple[int, list[str]]], vocabulary: dict[str, int], rates: np.ndarray):
        self.items = [(i, np.array([vocabulary[w] for w in ws], np.int64)) for i, ws in items]
        self.vocabulary, self.size = vocabulary, len(vocabulary)
        self.seeds: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        logs = np.log(rates)
        for k, (_, ids) in enumerate(self.items):
            values = ids.tolist()
            for at in range(len(values)):
                rate, n = 0.0, 0
                while at + n < len(values) and n < LONGEST_SEED and (n < 2 or rate > np.log(RARE)):
                    rate += logs[values[at + n]]
                    n += 1
                if n >= 2 and (rate <= np.log(RARE) or n == LONGEST_SEED or len(values) < SHORT):
                    self.seeds[tuple(values[at : at + n])].append((k, at))
        self.lengths = defaultdict(set)
        for s in self.seeds:
            self.lengths[s[0] * self.size + s[1]].add(len(s))
        self.pairs = np.array(sorted(self.lengths), np.int64)
        self.lengths = {k: sorted(v) for k, v in self.lengths.items()}

    def matches(self, text: str | None) -> Iterator[tuple[int, float, int, int]]:
        """(item id, score, first word, word after the last) of each item that the text has."""
        words = words_of(text)
        if len(words) < 2 or not len(self.pairs):
            return
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        two = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * self.size + ids[1:], -1)
        found = np.flatnonzero(two >= 0)
        place = np.searchsorted(self.pairs, two[found])
        found = found[(place < len(self.pairs)) & (self.pairs[np.minimum(place, len(self.pairs) - 1)] == two[found])]
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i in found.tolist():
            for n in self.lengths[int(two[i])]:
                for k, at in self.seeds.get(tuple(ids[i : i + n].tolist()), ()):
                    hits[k].append((i, at))
        for k, own in sorted(hits.items()):
            item_id, item = self.items[k]
            m = len(item)
            slack = m // 2 + 1
            passages: list[list[int]] = []
            for lo in sorted(i - at - slack for i, at in own):
                if passages and lo <= passages[-1][1]:
                    passages[-1][1] = lo + m + 2 * slack
                else:
                    passages.append([lo, lo + m + 2 * slack])
            best = (0, 0, 0)
            for lo, hi in passages:
                lo = max(0, lo)
                for a in range(lo, min(hi, len(ids)), 8 * m + 4096):  # pieces overlap by more than an alignment is long
                    score, begin, end = align(item, ids[a : min(hi, a + 12 * m + 4096)])
                    if score > best[0]:
                        best = (score, a + begin, a + end)
                if best[0] == MATCH * m:
                    break
            score = best[0] / (MATCH * m)
            if score >= (MIN_SCORE if m >= SHORT else 1.0):
                yield item_id, score, best[1], best[2]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    """The benchmark's items in blocks of bounded size."""
    rows = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null")
    size = rows.agg(F.sum(F.length("text") / 4)).first()[0] or 0
    n = max(1, int(-(-size // BLOCK_WORDS)))
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b)
        items = sorted((r[0], words_of(r[1])) for r in part.collect())
        yield [(i, ws) for i, ws in items if ws]


def _rates(docs: DataFrame, vocabulary: dict[str, int]) -> np.ndarray:
    """The rate of each word of the vocabulary in the corpus."""
    size = len(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                ids = np.fromiter(map(vocabulary.get, words, repeat(size)), np.int64, len(words))
                total += np.bincount(ids, minlength=size + 1) if len(ids) > size // 8 else 0
                if len(ids) <= size // 8:
                    np.add.at(total, ids, 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n")).collect()
    counts = np.zeros(size + 1)
    for word, n in rows:
        counts[word] = n
    return (counts[:size] + 1) / (counts.sum() + size + 1)


def _indexes(docs: DataFrame, benchmark: DataFrame):
    spark = docs.sparkSession
    tune(spark)
    for items in _blocks(benchmark):
        if items:
            vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
            yield spark.sparkContext.broadcast(Index(items, vocabulary, _rates(docs, vocabulary)))


PAIRS = "doc_id long, item_id long, score double, first_word long, end_word long"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``PAIRS``: the documents with a passage of the benchmark, the item and the aligned words."""
    out = docs.sparkSession.createDataFrame([], PAIRS)
    for index in _indexes(docs, benchmark):

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [
                    (d, *m)
                    for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for m in index.value.matches(t)
                ]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in PAIRS.split(", ")]
                )

        out = out.unionByName(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, PAIRS))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` without the documents that have a passage of the benchmark."""
    out = docs
    for index in _indexes(docs.select(F.col(column).alias("text")), benchmark):

        def keep(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
                yield batch.filter(pa.array([next(index.value.matches(t), None) is None for t in texts], pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
    return out
