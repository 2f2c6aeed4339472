"""Operator 5: SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: whole texts, ASCII lower case, word shingles, XXH64, majority per bit.

Links: a random-like but fixed map gives each of the 64 bits a vector of GF(2)^4, each of the 16 vectors to four bits.
For each of the 15 non-zero vectors v, mask v keeps the bits whose vector has an odd product with v. The vectors of at
most three differing bits span at most three dimensions, so some v is orthogonal to all of them: that mask keeps none of
those bits, and the pair agrees in that table for certain. Each mask keeps 32 bits.

A table's bucket is searched for spanning links only (each fingerprint to the least one that it reaches inside), so
rows never grow with the square of a bucket. Buckets of over ``HOT`` fingerprints are dealt again by a second covering
family over the 32 free bits; that leaves 16 free bits, hence at most 65,536 fingerprints a bucket, searched by looking
up all 696 neighbours within three bits. So no bucket is unbounded and none is capped.

Equal texts meet as one fingerprint before any of this.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; a null id counts as no
id in the minimum; repeated rows are both returned; a bit set in exactly half the shingles is 0; very long texts are
read whole; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quadrat.llm.common import rows_of, spread, stored, tune
from quadrat.llm.components import components

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Fingerprints that a first-level bucket may hold before it is dealt again.
HOT = 2000


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    return majority([xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(width))))])


def majority(hashes: Sequence[int]) -> int:
    """The bits that are set in over half of 64-bit hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 50_000):
        part = np.array(hashes[at : at + 50_000], ">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)``, the fingerprint as a signed long."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches, "doc_id", "text"):
            found = [signed(fingerprint(t, width)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(compute, "doc_id long, fp long")


def covering(bits: list[int]) -> list[int]:
    """15 masks over the given bit positions; any three positions are all outside some mask."""
    order = sorted(bits, key=lambda b: xxhash.xxh64_intdigest(b"bit%d" % b, len(bits)))
    vector = {b: i % 16 for i, b in enumerate(order)}
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() & 1) for v in range(1, 16)]


MASKS = covering(list(range(64)))
#: For each first mask, the second-level masks over the bits that it leaves free.
SUBMASKS = [covering([b for b in range(64) if not m >> b & 1]) for m in MASKS]


def _near_pairs(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, least member that it reaches) inside one bucket, by comparing with all that isn't reached yet."""
    rest = np.sort(fps)
    nodes, roots = [], []
    while len(rest):
        root, frontier, rest = rest[0], [rest[0]], rest[1:]
        while frontier and len(rest):
            near = np.bitwise_count((rest ^ frontier.pop()).view(np.uint64)) <= RADIUS
            if near.any():
                found = rest[near]
                nodes.append(found)
                roots.append(np.full(len(found), root))
                frontier += list(found)
                rest = rest[~near]
    return _flat(nodes), _flat(roots)


_STEPS = np.array(
    sorted({(1 << a) | (1 << b) | (1 << c) for a in range(16) for b in range(16) for c in range(16)}), np.int64
)


def _near_indexed(fps: np.ndarray, free: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The same for fingerprints that differ in at most 16 known bits, by looking up neighbours in a table."""
    fps = np.sort(fps)
    place = np.zeros(len(fps), np.int64)
    for i, b in enumerate(free):
        place |= ((fps >> b) & 1) << i
    at = np.full(1 << 16, -1, np.int64)
    at[place] = np.arange(len(fps))
    open_ = np.ones(len(fps), bool)
    nodes, roots = [], []
    for i in range(len(fps)):
        if not open_[i]:
            continue
        open_[i] = False
        frontier = np.array([i])
        while len(frontier):
            found = at[(place[frontier[:512], None] ^ _STEPS).ravel()]
            frontier = frontier[512:]
            found = np.unique(found[found >= 0])
            found = found[open_[found]]
            if len(found):
                open_[found] = False
                nodes.append(fps[found])
                roots.append(np.full(len(found), fps[i]))
                frontier = np.concatenate((frontier, found))
    return _flat(nodes), _flat(roots)


def _flat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(table, fingerprints) of each bucket of two or more; rows come sorted by table and key."""
    kept: list[np.ndarray] = []  # the rows of a bucket that may go on in the next batch
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        if kept:
            rows = np.concatenate((*kept, rows), axis=1)
        if not rows.shape[1]:
            continue
        starts = np.flatnonzero(np.concatenate(([True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0))))
        sizes = np.diff(np.append(starts, rows.shape[1]))
        for s, n in zip(starts[:-1][sizes[:-1] > 1], sizes[:-1][sizes[:-1] > 1]):
            yield int(rows[0, s]), rows[2, s : s + n]
        kept = [rows[:, starts[-1] :]]
    if kept and kept[0].shape[1] > 1:
        yield int(kept[0][0, 0]), kept[0][2]


def _search(second: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, n = [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(_flat(us), pa.int64()), pa.array(_flat(vs), pa.int64())], ["u", "v"])

        for t, fps in _groups(batches):
            if second:
                used = MASKS[t // 15] | SUBMASKS[t // 15][t % 15]
                u, v = _near_indexed(fps, [b for b in range(64) if not used >> b & 1])
            else:
                u, v = _near_pairs(fps)
            if len(u):
                us.append(u)
                vs.append(v)
                n += len(u)
            if n > 100_000:
                yield flush()
                us, vs, n = [], [], 0
        yield flush()

    return search


def _table(t: int, mask: int) -> F.Column:
    return F.struct(F.lit(t).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("key"))


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """``(u, v)``: links that span the same components as all pairs within the radius. ``fps``: distinct ``fp``."""
    rows = fps.select(F.explode(F.array(*[_table(t, m) for t, m in enumerate(MASKS)])).alias("x"), "fp").select("x.*", "fp")
    large = stored(rows.groupBy("t", "key").count().where(F.col("count") > hot).select("t", "key"))
    first = rows.join(large, ["t", "key"], "left_anti")
    found = spread(first, "t", "key").sortWithinPartitions("t", "key").mapInArrow(_search(False), "u long, v long")
    if large.isEmpty():
        return found
    again = None
    for t, m in enumerate(MASKS):
        if large.where(F.col("t") == t).isEmpty():
            continue
        part = rows.where(F.col("t") == t).join(large, ["t", "key"], "left_semi").select(
            F.explode(F.array(*[_table(t * 15 + i, m | s) for i, s in enumerate(SUBMASKS[t])])).alias("x"), "fp"
        )
        again = part if again is None else again.unionByName(part)
    deep = spread(again.select("x.*", "fp"), "t", "key").sortWithinPartitions("t", "key")
    return found.unionByName(deep.mapInArrow(_search(True), "u long, v long"))


def classes(docs: DataFrame, width: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """``doc_id, fp, root, component_id`` of every document; ``root`` names the component by a fingerprint."""
    tune(docs.sparkSession)
    own = stored(fingerprints(docs, width))
    nodes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp"), hot))
    named = nodes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # stored, so that both sides of the join are plain exchanges, which adaptive execution splits at a large component
    ids = stored(named.groupBy("root").agg(F.min("least").alias("component_id")))
    return own.join(named.join(ids, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    return classes(docs, width, hot).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame, width: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """``docs`` with one document of each component: the one with the least id, and the least fingerprint among rows
    of that id; of equal rows, one. All columns are kept."""
    least = (
        classes(docs, width, hot)
        .groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("one"))
        .select(F.coalesce("one.doc_id", F.lit(-(1 << 62))).alias("_sh_id"), F.col("one.fp").alias("_sh_fp"))
    )
    columns = docs.columns
    schema = StructType([*docs.schema.fields]).add("_sh_fp", "long")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            found = pa.array([signed(fingerprint(t, width)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "_sh_fp"])

    keyed = docs.mapInArrow(add, schema).withColumn("_sh_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))))
    return keyed.join(least, ["_sh_id", "_sh_fp"]).dropDuplicates(["_sh_id", "_sh_fp"]).select(*columns)
