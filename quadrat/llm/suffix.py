"""Operator 10: removal of long repeated byte strings by a sampled, range-partitioned suffix order.

A byte goes if some string of ``LENGTH`` bytes that covers it starts anywhere else too. Sorting every suffix of a corpus
would move each byte many times over, so suffixes are sampled by content: the window of ``LENGTH`` bytes that starts at
a position picks the least of its k-grams (by a fixed hash, leftmost among equals) as its anchor. Equal windows pick the
same k-gram at the same distance, so two equal windows are always found at suffixes that begin with the same k-gram, and
about one suffix in 170 is an anchor. No window is lost by this: it is exact.

1. ``anchors``: for each anchor the range of window starts that picked it, the hash of its k-gram, and a hash of its
   context (all bytes of those windows). One pass, narrow rows.
2. Contexts that occur twice are repeated as a whole; a k-gram with one context that occurs once repeats nothing.
3. What is left are k-grams with different contexts. One copy of each such context is fetched and range-partitioned by
   leading bytes at splitters sampled from the data; a k-gram with many contexts is dealt by window distance, and beyond
   that by window hash, so no bucket is unbounded. Buckets sort their windows locally by multikey quicksort, 128 bytes
   (named by a 64-bit fingerprint) to a character, and compare neighbours. A bucket holds all windows that could equal
   one of its own, so no comparison crosses a border.
4. Repeated windows go back to their documents as byte intervals, which are merged and cut out.

Passages of over 50 words that another row has too are reported beside this, whatever their bytes (see ``passages``).

Defined cases: null texts are empty; texts under ``LENGTH`` bytes keep all; equal rows repeat each other; a null id is
kept; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import rows_of, stored, tune, utf8
from quadrat.llm.passages import WORDS, shared_passages
from quadrat.llm.rolling import BYTES, CHUNK, PLACE, least, pieces, rolled, row_key

LENGTH = 400
KGRAM = 64
#: Contexts of one k-gram that one bucket takes.
BUCKET = 500
#: With more than so many times ``BUCKET``, each window goes to a bucket by itself, by distance and hash.
WIDE = 50


def find_anchors(texts: list[bytes], length: int = LENGTH, kgram: int = KGRAM) -> Iterator[tuple[int, ...]]:
    """(text, anchor, first start, last start, k-gram hash, context hash) of every anchor."""
    for lot in pieces(texts, length):
        data = np.frombuffer(b"".join(texts[i][at : at + n + length - 1] for i, at, n in lot), np.uint8)
        if len(data) < length:
            continue
        hashes = rolled(BYTES[data], kgram)
        key = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
        picked = (least(key, length - kgram + 1) & PLACE).astype(np.int64)
        offset = 0
        for i, at, n in lot:
            own = picked[offset : offset + n]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            last = np.append(first[1:], n) - 1
            text, shift = texts[i], at - offset
            marks = hashes[own[first]].view(np.int64).tolist()
            for a, lo, hi, mark in zip((own[first] + shift).tolist(), (first + at).tolist(), (last + at).tolist(), marks):
                context = xxhash.xxh64_intdigest(text[lo : hi + length])
                yield i, a, lo, hi, mark, context - (1 << 64) if context >> 63 else context
            offset += n + length - 1


_ANCHOR = "r1 long, r2 long, a int, lo int, hi int, kh long, ch long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def anchors(docs: DataFrame, length: int, kgram: int) -> DataFrame:
    """``docs``: (doc_id, body)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches, "doc_id", "body"):
            keys, out = {}, []
            for i, *rest in find_anchors(texts, length, kgram):
                if i not in keys:
                    keys[i] = row_key(ids[i], texts[i])
                out.append((*keys[i], *rest))
                if len(out) >= 50_000:
                    yield _batch(out, _ANCHOR)
                    out = []
            yield _batch(out, _ANCHOR)

    return docs.mapInArrow(find, _ANCHOR)


_CONTEXT = "lead binary, salt long, kh long, ch long, n long, t int, body binary"


def _contexts(length: int, kgram: int, bucket: int):
    """Contexts of the wanted anchors of each document, dealt to salts where their k-gram has many."""
    spans, wide = length - kgram + 1, WIDE * bucket

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for texts, wanted in rows_of(batches, "body", "wanted"):
            for text, marks in zip(texts, wanted):
                for m in marks:
                    a, lo, hi, many = m["a"], m["lo"], m["hi"], m["contexts"]
                    lead = text[a : a + kgram]
                    salts = spans if many > wide else min(spans, -(-many // bucket))
                    fine = -(-many // wide)
                    step = -(-spans // salts)
                    for s in range((lo - a + spans - 1) // step, (hi - a + spans - 1) // step + 1):
                        first, last = max(lo, a - spans + 1 + s * step), min(hi, a - spans + s * step + step)
                        body = text[first : last + length]
                        salt = s * fine + (xxhash.xxh64_intdigest(body) % fine if fine > 1 and first == last else 0)
                        out.append((lead, salt, m["kh"], m["ch"], m["n"], first - a, body))
                        size += len(body)
                if size > 4 << 20:
                    yield _batch(out, _CONTEXT)
                    out, size = [], 0
        yield _batch(out, _CONTEXT)

    return cut


def repeated_windows(groups: np.ndarray, shifts: np.ndarray, bodies: list[bytes], length: int) -> list[np.ndarray]:
    """For each body, which of its windows equals a window of another body in its group at the same shift.

    Multikey quicksort on (group, shift), then on 128 bytes at a time: only windows that still tie with another go on.
    """
    width = 128
    while width > length:
        width //= 2
    counts = np.array([len(b) - length + 1 for b in bodies])
    total = int(counts.sum())
    inside = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    offsets = [*range(0, length - width, width), length - width]
    chars = [np.empty(total, np.uint64) for _ in offsets]  # of each window; a lot of bodies is hashed at a time
    done = lot = 0
    while lot < len(bodies):
        upto, size = lot, 0
        while upto < len(bodies) and (upto == lot or size < CHUNK):
            size += len(bodies[upto])
            upto += 1
        hashes = rolled(BYTES[np.frombuffer(b"".join(bodies[lot:upto]), np.uint8)], width)
        n = counts[lot:upto]
        sizes = np.array([len(b) for b in bodies[lot:upto]])
        at = np.repeat(np.cumsum(sizes) - sizes, n) + inside[done : done + int(n.sum())]
        for char, offset in zip(chars, offsets):
            char[done : done + len(at)] = hashes[at + offset]
        done, lot = done + len(at), upto
    tie = np.repeat(groups, counts) * 4096 + np.repeat(shifts, counts) + inside + 2048
    rows = np.arange(total)
    for column in chars:
        char = column[rows]
        order = np.lexsort((char, tie))
        rows, tie, char = rows[order], tie[order], char[order]
        new = np.concatenate(([True], (tie[1:] != tie[:-1]) | (char[1:] != char[:-1])))
        tied = ~(new & np.append(new[1:], True))
        tie = np.cumsum(new)[tied]
        rows = rows[tied]
        if not len(rows):
            break
    found = np.zeros(total, bool)
    found[rows] = True
    return np.split(found, np.cumsum(counts)[:-1])


_VERDICT = "kh long, ch long, t0 int, t1 int"


def _compare(length: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def judge(rows: list[tuple]) -> Iterator[tuple]:
            keys = [(r[1], r[2]) for r in rows]
            groups = np.cumsum([0] + [int(a != b) for a, b in zip(keys, keys[1:])])
            many = np.bincount(groups)[groups] > 1
            rows, groups = [r for r, m in zip(rows, many) if m], groups[many]
            if not rows:
                return
            found = repeated_windows(groups, np.array([r[5] for r in rows]), [r[6] for r in rows], length)
            for r, dup in zip(rows, found):
                if r[4] == 1 and dup.any():
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], dup.view(np.int8), [0]))))
                    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                        yield r[2], r[3], r[5] + a, r[5] + b - 1

        for batch in rows_of(batches, *(c.split()[0] for c in _CONTEXT.split(", "))):
            for row in zip(*batch):
                if size > 1 << 20 and (row[1], row[2]) != (held[-1][1], held[-1][2]):
                    yield _batch(list(judge(held)), _VERDICT)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        yield _batch(list(judge(held)) if held else [], _VERDICT)

    return compare


def verdicts(marks: DataFrame, docs: DataFrame, length: int, kgram: int, bucket: int) -> DataFrame:
    """Repeated window starts of each (k-gram, context), as distances from the anchor."""
    seen = stored(
        marks.groupBy("kh", "ch").agg(F.count("*").alias("n"), F.min(F.struct("r1", "r2", "a", "lo", "hi")).alias("one"))
    )
    # stored, so that both sides of the join below are plain exchanges, which adaptive execution splits at a hot k-gram
    mixed = stored(seen.groupBy("kh").agg(F.count("*").alias("contexts")).where("contexts > 1"))
    wanted = (
        seen.join(mixed, "kh")
        .groupBy("one.r1", "one.r2")
        .agg(F.collect_list(F.struct("one.a", "one.lo", "one.hi", "kh", "ch", "n", "contexts")).alias("wanted"))
    )
    bodies = docs.mapInArrow(_keyed, "r1 long, r2 long, body binary").join(wanted, ["r1", "r2"]).select("body", "wanted")
    contexts = stored(bodies.mapInArrow(_contexts(length, kgram, bucket), _CONTEXT))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = contexts.repartitionByRange(n, "lead", "salt").sortWithinPartitions("lead", "salt", "kh")
    part = dealt.mapInArrow(_compare(length), _VERDICT)
    whole = seen.where("n > 1").select("kh", "ch", F.lit(-length).alias("t0"), F.lit(length).alias("t1"))
    return part.unionByName(whole)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keys = [row_key(d, t) for d, t in zip(ids, texts)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), batch.column(1)],
            ["r1", "r2", "body"],
        )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, kgram: int = KGRAM, bucket: int = BUCKET) -> DataFrame:
    """``(r1, r2, spans)`` of the rows of ``docs`` (doc_id, body) that have repeated strings."""
    marks = stored(anchors(docs, length, kgram))
    found = stored(verdicts(marks, docs, length, kgram, bucket))
    return (
        marks.join(found, ["kh", "ch"])
        .select(
            "r1",
            "r2",
            F.greatest("lo", F.col("a") + F.col("t0")).alias("s"),
            (F.least("hi", F.col("a") + F.col("t1")) + length).alias("e"),
        )
        .groupBy("r1", "r2")
        .agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    )


SCHEMA = (
    "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, has_repeats boolean, removed_share double, "
    "n_shared_words long, n_passages long"
)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, kgram: int = KGRAM, bucket: int = BUCKET, words: int = WORDS
) -> DataFrame:
    """``SCHEMA`` of every document; ``has_repeats`` says whether anything goes, ``removed_share`` how much of it.

    A passage of ``words`` words can have under ``length`` bytes, and then stays. ``n_shared_words`` counts the words in
    passages that another row has too, of any length in bytes, ``n_passages`` the maximal runs of these words.
    """
    tune(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("body"))
    spans = stored(repeated_spans(own, length, kgram, bucket))
    counts = ["n_shared_words", "n_passages"]
    both = stored(spans.join(shared_passages(own, words), ["r1", "r2"], "full"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _keyed(iter([batch])):
                yield pa.RecordBatch.from_arrays([batch.column(0), *part.columns], ["doc_id", "r1", "r2", "body"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, found, shared, passages in rows_of(batches, "doc_id", "body", "spans", *counts):
            out = []
            for doc, text, spans, words, many in zip(ids, texts, found, shared, passages):
                gone = merged([(x["s"], x["e"]) for x in spans or ()])
                digest, at = hashlib.sha256(), 0
                for a, b in gone:
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                removed = sum(b - a for a, b in gone)
                contract = doc, len(text), removed, len(gone), digest.hexdigest()
                out.append((*contract, removed > 0, removed / max(1, len(text)), words or 0, many or 0))
            yield _batch(out, SCHEMA)

    rows = own.mapInArrow(keyed, "doc_id long, r1 long, r2 long, body binary")
    return rows.join(both, ["r1", "r2"], "left").select("doc_id", "body", "spans", *counts).mapInArrow(cut, SCHEMA)
