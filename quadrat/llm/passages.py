"""Passages of many words that another document has too; operator 10 reports them beside the bytes that it removes.

Words are what white space (`\\x20\\x09-\\x0D`) parts, compared as bytes; a passage is a string of ``WORDS`` words or more
that occurs in another row too (equal rows are others), whatever white space parts its words. It is found as repeated
bytes are: each window of ``WORDS`` words picks the least of its k-grams of words as its anchor, and equal windows pick
the same one at the same distance.

1. ``marks``: for each anchor the range of window starts that picked it, the hash of its k-gram and that of its context
   (all words of those windows).
2. K-grams of one row repeat nothing in another; a bit table of the others drops most of these. A context of two rows is
   shared as a whole.
3. Where a k-gram has a context of one row and other contexts too, windows become rows, of two occurrences of each
   context (in two rows, if it has them) and the few others that bit tables let pass. Those of two rows are shared, and
   so are the ones at their distance in every occurrence of the context.

Words, k-grams, contexts and windows are named by 64-bit hashes.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import rows_of, stored
from quadrat.llm.phrases import Frequent
from quadrat.llm.rolling import BYTES, CHUNK, PLACE, least, mixed, pieces, rolled, row_key

#: A passage has over 50 words.
WORDS = 51
_WHITE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


#: Codes that are hashed at once; a longer word is hashed by XXH64.
MOST = CHUNK + (1 << 16)


def _powers(base: int) -> np.ndarray:
    out = np.full(MOST, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def strings(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the codes from each start to its end, by sums over a prefix."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * _UP[: len(codes)])))
    return mixed((sums[ends] - sums[starts]) * _DOWN[starts])


def _parts(data: bytes) -> Iterator[tuple[int, bytes]]:
    """``data`` and where it goes on, in order, cut at white space; only a lone word has over ``MOST`` bytes."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + CHUNK)
        end = gap.start() if gap else len(data)
        if end - at > MOST:
            word = 1 + max(data.rfind(bytes([c]), at, at + CHUNK) for c in np.flatnonzero(_WHITE).tolist())
            if word > at:
                yield at, data[at:word]
                at = word
        yield at, data[at:end]
        at = end


def words_of(texts: list[bytes]) -> list[np.ndarray]:
    """The hashes of the words of each text."""
    out: list[np.ndarray] = []
    while len(out) < len(texts):
        first, upto, size = len(out), len(out), 0
        while upto < len(texts) and (upto == first or size + len(texts[upto]) < CHUNK):
            size += len(texts[upto]) + 1
            upto += 1
        names, begins = [], []
        for at, part in _parts(b"\n".join(texts[first:upto])):
            if len(part) > MOST:
                names.append(np.array([xxhash.xxh64_intdigest(part)], np.uint64))
                begins.append(np.array([at]))
                continue
            data = np.frombuffer(part, np.uint8)
            edges = np.flatnonzero(np.diff(np.concatenate(([True], _WHITE[data], [True])).view(np.int8)))
            names.append(strings(BYTES[data], edges[::2], edges[1::2]))
            begins.append(edges[::2] + at)
        if not names:
            out += [np.zeros(0, np.uint64)] * (upto - first)
            continue
        lengths = np.array([len(t) + 1 for t in texts[first:upto]])
        cuts = np.searchsorted(np.concatenate(begins), np.cumsum(lengths)[:-1])
        out += np.split(np.concatenate(names), cuts)
    return out


class Anchors(NamedTuple):
    """Of a lot of windows: each anchor's text, first and last window start in it, k-gram and context; and the codes of
    the lot with each window's place in them, ``begins`` with the first window of each anchor."""

    text: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    kgram: np.ndarray
    context: np.ndarray
    codes: np.ndarray
    places: np.ndarray
    begins: np.ndarray


def find_anchors(texts: list[np.ndarray], words: int, kgram: int) -> Iterator[Anchors]:
    for lot in pieces(texts, words):
        codes = np.concatenate([texts[i][at : at + n + words - 1] for i, at, n in lot])
        hashes = rolled(codes, kgram)
        key = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
        picked = (least(key, words - kgram + 1) & PLACE).astype(np.int64)
        text, start, n = (np.array(x) for x in zip(*lot))
        offset = np.concatenate(([0], np.cumsum(n + words - 1)[:-1]))
        own = np.repeat(np.arange(len(lot)), n)
        places = np.arange(len(own)) + (offset - (np.cumsum(n) - n))[own]
        chosen = picked[places]
        begins = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (own[1:] != own[:-1]))))
        lasts = np.append(begins[1:], len(own)) - 1
        piece, shift = own[begins], start - offset
        yield Anchors(
            text[piece],
            places[begins] + shift[piece],
            places[lasts] + shift[piece],
            mixed(hashes[chosen[begins]]),  # the least ones share their first bits, which name a place in a bit table
            strings(codes, places[begins], places[lasts] + words),
            codes,
            places,
            begins,
        )


_MARK = "d long, r1 long, r2 long, lo int, hi int, kh long, ch long"
_WINDOW = "x long, r long, kh long, ch long, t int"
_RUN = "r1 long, r2 long, run long"
_COUNTS = "r1 long, r2 long, n_shared_words long, n_passages long"
#: Occurrences of a context in a row are told apart by so many bits.
_LOW = 12


def _table(columns: list[np.ndarray], schema: str) -> pa.RecordBatch:
    kinds = {"long": np.int64, "int": np.int32}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(kinds[k])) for c, (_, k) in zip(columns, fields)],
        [n for n, _ in fields],
    )


def _lots(batches: Iterator[pa.RecordBatch], words: int, kgram: int) -> Iterator[tuple[np.ndarray, Anchors]]:
    """Anchors of each lot, with (d, r1, r2) of the texts."""
    for ids, texts in rows_of(batches, "doc_id", "body"):
        keys = np.zeros((len(texts), 3), np.int64)
        long = words_of(texts)
        for i in np.flatnonzero([len(w) >= words for w in long]).tolist():
            keys[i] = (int.from_bytes(os.urandom(8), "little", signed=True), *row_key(ids[i], texts[i]))
        for found in find_anchors(long, words, kgram):
            yield keys, found


def marks(docs: DataFrame, words: int, kgram: int) -> DataFrame:
    """``docs``: (doc_id, body). ``d`` is a number drawn for each row; it tells equal rows apart and must be stored."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, x in _lots(batches, words, kgram):
            yield _table([*keys[x.text].T, x.lo, x.hi, x.kgram, x.context], _MARK)

    return docs.mapInArrow(find, _MARK)


def _among(df: DataFrame, column: str, table) -> DataFrame:
    """The rows whose name the bit table has."""

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(Frequent.has(table.value, batch.column(column).to_numpy().view(np.uint64))))

    return df.mapInArrow(known, df.schema)


def _windows(docs: DataFrame, words: int, kgram: int, kgrams, places) -> DataFrame:
    """Every window of the anchors whose k-gram and place the bit tables have."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, x in _lots(batches, words, kgram):
            row = keys[x.text, 1]
            place = (row ^ (x.lo & (1 << _LOW) - 1)).view(np.uint64)
            place = (place << np.uint64(64 - _LOW)) | (place >> np.uint64(_LOW))
            anchor = np.repeat(np.arange(len(x.begins)), x.hi - x.lo + 1)
            wanted = (Frequent.has(kgrams.value, x.kgram) & Frequent.has(places.value, place))[anchor]
            anchor, at = anchor[wanted], x.places[wanted]
            names = strings(x.codes, at, at + words)
            yield _table([names, row[anchor], x.kgram[anchor], x.context[anchor], at - x.places[x.begins[anchor]]], _WINDOW)

    return docs.mapInArrow(find, _WINDOW)


def _runs(words: int):
    """Intervals of words of the windows at distances ``ts`` from ``lo``, or of all up to ``hi`` where it is null, as
    2^32 times the start, and the end."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column("ts")
            row = {n: batch.column(n).to_numpy() for n in ("r1", "r2", "lo", "hi")}
            part = np.repeat(np.arange(len(some)), some.value_lengths().fill_null(0).to_numpy())
            t = some.flatten().to_numpy()
            first = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1] + 1) | (part[1:] != part[:-1])))[: len(t)])
            last = np.append(first[1:], len(t))[: len(first)] - 1
            whole = np.flatnonzero(some.is_null().to_numpy(zero_copy_only=False))
            at = np.concatenate((part[first], whole))
            begin = np.concatenate((row["lo"][part[first]] + t[first], row["lo"][whole]))
            end = np.concatenate((row["lo"][part[first]] + t[last], row["hi"][whole])) + words
            yield _table([row["r1"][at], row["r2"][at], (begin.astype(np.int64) << 32) | end], _RUN)

    return join


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words in the intervals of each row, and the maximal runs of these words."""
    for batch in batches:
        lists = batch.column("runs")
        part = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        runs = lists.flatten().to_numpy()
        order = np.lexsort((runs, part))
        part, runs = part[order], runs[order]
        shift = part << 32  # rows follow each other, so that one running maximum does for all
        begin, end = (runs >> 32) + shift, np.maximum.accumulate((runs & (1 << 32) - 1) + shift)
        first = np.flatnonzero(np.concatenate(([True], (begin[1:] > end[:-1]) | (part[1:] != part[:-1])))[: len(runs)])
        last = np.append(first[1:], len(runs))[: len(first)] - 1
        words = np.bincount(part[first], weights=end[last] - begin[first], minlength=len(lists)).astype(np.int64)
        many = np.bincount(part[first], minlength=len(lists))
        yield _table([batch.column(n).to_numpy() for n in ("r1", "r2")] + [words, many], _COUNTS)


def shared_passages(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``(r1, r2, n_shared_words, n_passages)`` of the rows of ``docs`` (doc_id, body) that share any."""
    kgram = 1
    while 8 * kgram <= words:
        kgram *= 2
    own = stored(marks(docs, words, kgram))
    several = own.groupBy("kh").agg(F.min("d").alias("d0"), F.max("d").alias("d1")).where("d0 <> d1")
    own = stored(_among(own, "kh", _names(several)))
    place = F.col("r1").bitwiseXOR(F.col("lo").bitwiseAND((1 << _LOW) - 1)).alias("place")
    contexts = stored(
        own.select("kh", "ch", "d", place)
        .groupBy("kh", "ch")
        .agg((F.min("d") != F.max("d")).alias("shared"), F.min("place").alias("p0"), F.max("place").alias("p1"))
    )
    open_ = contexts.groupBy("kh").agg(F.count("*").alias("n"), F.every("shared").alias("closed")).where("n > 1 and not closed")
    kgrams = _names(open_)
    two = _among(contexts, "kh", kgrams).select(F.explode(F.array("p0", "p1")).alias("p"))
    places = _names(two.select(F.shiftleft("p", 64 - _LOW).bitwiseOR(F.shiftrightunsigned("p", _LOW)).alias("kh")))
    windows = stored(_windows(docs, words, kgram, kgrams, places))
    # equal rows have one key, but all their contexts are shared as a whole
    twice = stored(windows.groupBy("x").agg(F.min("r").alias("r0"), F.max("r").alias("r1")).where("r0 <> r1").select("x"))
    part = windows.join(twice, "x").groupBy("kh", "ch").agg(F.array_sort(F.collect_set("t")).alias("ts"))
    found = contexts.join(part, ["kh", "ch"], "left").where("shared or ts is not null")
    found = stored(found.select("kh", "ch", F.when(~F.col("shared"), F.col("ts")).alias("ts")))
    runs = own.join(found, ["kh", "ch"]).select("r1", "r2", "lo", "hi", "ts").mapInArrow(_runs(words), _RUN)
    return runs.groupBy("r1", "r2").agg(F.collect_list("run").alias("runs")).mapInArrow(_counts, _COUNTS)


def _names(df: DataFrame):
    """The bit table of ``kh``."""
    return Frequent(stored(df.select(F.col("kh").alias("name")))).table
