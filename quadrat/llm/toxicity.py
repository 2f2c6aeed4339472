"""Operator 12: toxicity by compression distance.

1. Training text of each class gives a zstandard dictionary of its own: the ordinary one holds the words that most ordinary
   documents have, the toxic one those that more toxic documents have than chance explains. A difference should show the
   toxic words alone, so the toxic compressor knows the ordinary words as well, at the same offsets.
2. A window is a word between blanks, between a fixed head and tail that both know by heart: the head keeps zstandard from
   storing a short window raw, and no match begins in the last eight bytes. Its distance is what the toxic compressor
   saves in bytes against the ordinary one. (Windows of several words of 24 to 64 bytes were tried on sf0.1: 0.95 to 0.97
   of the held-out labels were right, 0.99 with one word.)
3. A document's windows over each of ``THRESHOLDS`` are counted. The counts and their shares are calibrated to a score by
   logistic regression, on documents whose own half of the sample did not make the dictionaries that judge them.

Bound: dictionaries and calibration are fitted on about ``SAMPLE`` different texts of each class, dealt by a hash of
the text; their words are counted on the cluster, and only the dictionaries and the counts of windows reach the driver.
Scoring reads every text whole, in slices; distances of known words are remembered up to ``KNOWN`` words a worker.

Defined cases: labels of rows whose crc32(doc_id as text) mod 5 is 0 are never read; of several labels of an id the
largest counts, a null one not at all; null text is empty and is scored as a text without windows, like one without
letters; a null id is not held out and has no label; without labelled rows of both classes every score is the share of
toxic ones (0 without any); repeated rows and equal texts have equal scores; an empty table gives no rows. Extra columns
are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import for_stage, rows_of, stored, tune

#: Documents of a class that the model is fitted on, about.
SAMPLE = 4000
#: Words of a dictionary at most; how far beyond chance, in standard deviations, and in how many documents a word of the
#: toxic one must be.
TOXIC_WORDS, ORDINARY_WORDS, BEYOND, LEAST_DOCS = 600, 1200, 4.0, 3
#: Bytes saved from which a window counts, each with its own count.
THRESHOLDS = (2, 3, 4, 5, 6)
#: Distances that a worker remembers, and the longest word among them.
KNOWN, LONG = 200_000, 48
#: Characters of a text that are worked on at once.
SLICE = 1 << 20

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_HEAD, _TAIL = (b"#".join(b"%02d" % i for i in part) for part in (range(24), range(30, 38)))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def windows(text: str) -> Iterator[list[bytes]]:
    """The words of a text in lower case, slice by slice."""
    at, n = 0, len(text)
    while at < n:
        end = at + SLICE
        while end < n and text[end].isalpha():
            end += 1
        yield _NOT_LETTERS.sub(" ", text[at:end].lower()).encode().split()
        at = end


class Distance:
    """What the toxic dictionary saves on a word, in bytes."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        # bytes that no window has keep the ordinary words as far away as in the other
        self.toxic, self.ordinary = self._compressor(ordinary + toxic), self._compressor(ordinary + b"\x01" * len(toxic))
        self.known: dict[bytes, int] = {}

    @staticmethod
    def _compressor(words: bytes) -> zstandard.ZstdCompressor:
        params = zstandard.ZstdCompressionParameters(
            window_log=17, hash_log=17, chain_log=17, search_log=8, min_match=4, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2,
            write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        content = zstandard.ZstdCompressionDict(words + _TAIL + _HEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=content, compression_params=params)

    def of(self, word: bytes) -> int:
        window = b"%b %b %b" % (_HEAD, word, _TAIL)
        return len(self.ordinary.compress(window)) - len(self.toxic.compress(window))

    def histogram(self, words: list[bytes]) -> Counter:
        """Windows by their distance."""
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > KNOWN:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = self.of(w)
        out = Counter(map(known.__getitem__, words))
        for w in new:
            if len(w) > LONG:
                del known[w]
        return out


def features(text: str, distance: Distance) -> list[float]:
    seen: Counter = Counter()
    for words in windows(text):
        seen.update(distance.histogram(words))
    n = sum(seen.values())
    out = [math.log1p(n)]
    for t in THRESHOLDS:
        k = sum(c for d, c in seen.items() if d >= t)
        out += [math.log1p(k), math.log((0.3 + k) / (n + 20))]
    return out


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on columns as they are: the constant first."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    rows = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w, pull = np.zeros(rows.shape[1]), np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve((rows * (p * (1 - p) + 1e-6)[:, None]).T @ rows + pull, rows.T @ (p - y) + pull @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[0] - (w[1:] * mean / scale).sum(), w[1:] / scale)


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(h, toxic, id) of the different texts (by hash) of each class that may be learned from."""
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out())
    marks = usable.groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max("toxic") > 0).alias("toxic"))
    return docs.select("id", "h").join(marks, "id").groupBy("h", "toxic").agg(F.min("id").alias("id"))


def _dictionary(words: list[str]) -> bytes:
    """Words with blanks, the weightiest last, where offsets are short."""
    return b"".join(b" %b " % w.encode() for w in reversed(words))


def _dictionaries(counts: DataFrame, toxic: list[int], ordinary: list[int], halves: tuple[int, ...]) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary of the given halves. ``counts``: (word, k0, k1, c0, c1)."""
    p, n = sum(toxic[h] for h in halves), sum(ordinary[h] for h in halves)
    both = counts.select("word", F.expr("+".join(f"k{h}" for h in halves)).alias("k"), F.expr("+".join(f"c{h}" for h in halves)).alias("c"))
    chance = (F.col("k") + F.col("c")) * (p / max(1, p + n))
    beyond = both.where(f"k >= {LEAST_DOCS}").withColumn("z", (F.col("k") - chance) / F.sqrt(chance)).where(f"z >= {BEYOND}")
    found = beyond.orderBy(F.col("z").desc(), "word").limit(TOXIC_WORDS).select("word").collect()
    usual = both.where("c > 0").orderBy(F.col("c").desc(), "word").limit(ORDINARY_WORDS).select("word").collect()
    return _dictionary([r[0] for r in found]), _dictionary([r[0] for r in usual])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[bytes, bytes, list[float]]:
    """Toxic dictionary, ordinary dictionary, weights; two empty dictionaries and a constant without both classes."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    rows = stored(_labelled(own, labels))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    p, n = sizes.get(True, 0), sizes.get(False, 0)
    if not p or not n:
        share = min(max(p / max(1, p + n), 1e-9), 1 - 1e-9)
        return b"", b"", [math.log(share / (1 - share))] + [0.0] * (1 + 2 * len(THRESHOLDS))
    most = F.when(F.col("toxic"), int((1 << 20) * min(1, sample / p))).otherwise(int((1 << 20) * min(1, sample / n)))
    dealt = rows.where(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < most).withColumn("half", F.pmod("h", F.lit(2)).cast("int"))
    # about two samples of narrow rows: bounded, so texts stay where they are
    few = own.join(F.broadcast(dealt), ["id", "h"]).dropDuplicates(["h", "toxic"]).select("text", "toxic", "half")
    few = stored(few)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, marks, halves in rows_of(batches, "text", "toxic", "half"):
            out = []
            for text, mark, half in zip(texts, marks, halves):
                words = {w for part in windows(text) for w in part if len(w) <= LONG}
                out += [(w.decode(), mark, half) for w in words]
            columns = list(zip(*out)) or [()] * 3
            kinds = (pa.string(), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "toxic", "half"])

    of = lambda half, mark: F.count(F.when((F.col("half") == half) & (F.col("toxic") == mark), 1))
    words = few.mapInArrow(distinct, "word string, toxic boolean, half int").groupBy("word")
    counts = stored(words.agg(of(0, True).alias("k0"), of(1, True).alias("k1"), of(0, False).alias("c0"), of(1, False).alias("c1")))
    found = few.groupBy().agg(of(0, True), of(1, True), of(0, False), of(1, False)).first()
    toxic, ordinary = list(found[:2]), list(found[2:])
    judges = [_dictionaries(counts, toxic, ordinary, (1 - h,)) for h in (0, 1)]  # of the other half
    whole = _dictionaries(counts, toxic, ordinary, (0, 1))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = [for_stage(_two, *judges[0], *judges[1])[h] for h in (0, 1)]
        for texts, marks, halves in rows_of(batches, "text", "toxic", "half"):
            rows = [features(t, distances[h]) for t, h in zip(texts, halves)]
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.bool_()), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"])

    data = few.mapInArrow(measured, "toxic boolean, x array<double>").toArrow()
    x, y = np.array(data.column("x").to_pylist(), float), np.array(data.column("toxic").to_pylist(), float)
    order = np.lexsort((*x.T, y))  # sums don't depend on the order of tasks
    return *whole, fitted(x[order], y[order]).tolist()


def _two(*words: bytes) -> tuple[Distance, Distance]:
    return Distance(*words[:2]), Distance(*words[2:])


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``SCHEMA`` of every document."""
    tune(docs.sparkSession)
    toxic, ordinary, weights = fit(docs, labels, sample)
    constant, slopes = weights[0], weights[1:]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = for_stage(Distance, toxic, ordinary)
        for ids, texts, held in rows_of(batches, "doc_id", "text", "held_out"):
            scores = []
            for text in texts:
                at = constant + sum(w * x for w, x in zip(slopes, features(text, distance)))
                scores.append(1 / (1 + math.exp(-min(max(at, -30.0), 30.0))))
            columns = [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(scores, pa.float64())]
            columns.append(pa.array([int(s >= 0.5) for s in scores], pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out().alias("held_out"))
    return rows.mapInArrow(score, SCHEMA)
