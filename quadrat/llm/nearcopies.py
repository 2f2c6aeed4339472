"""Near copies by the similarity of word shingles: pairs whose sets of five-word shingles have Jaccard 0.8 or more.

1. Each text's shingles (whole text, ASCII lower case) are hashed by XXH64; texts with one set are one node. A node has a
   SimHash fingerprint, and operator 5's covering search finds those within its radius for certain.
2. SimHash alone doesn't reach down to 0.8: such pairs differ in about 10 of 64 bits, and masks that cover that radius
   are too many. So there are other candidates besides: ``BANDS`` keys of ``ROWS`` least hashes each. A pair of similarity
   s shares a key with probability 1 - (1 - s^6)^40: at 0.8 all but 5 in a million pairs, at 0.9 all but 1 in 10^13.
3. Both kinds are checked exactly, by the two sets: fingerprints' spanning links, and each node with the least of each of
   its buckets. What that links becomes
   components; buckets inside one component are done. In the others the nodes outside the bucket's commonest component
   are compared with all nodes of other components, in blocks of bounded size: a task holds two blocks and gives links
   only, so neither pairs nor whole groups are ever rows of a table. A large group of near copies thus costs rows in
   proportion to it, but for the copies that no bucket's least node is near to.

Sets are kept for nodes in buckets of two or more only; they are computed anew from the texts of those.

Defined cases: null, empty and blank texts have no shingle and are one node; texts of fewer words than a shingle are one
shingle; very long texts are compared like others, one to a block; texts of equal sets are copies, repeated rows among
them; an empty table gives no rows. All columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm import simhash
from quadrat.llm.common import rows_of, stored, tune
from quadrat.llm.components import components

SEED = 42
SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 40, 6
#: Shingles in a block of nodes that are compared together, on average.
BLOCK = 64_000
#: Odd factors: each gives the hashes another order.
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    parts = zip(*(words[i:] for i in range(min(width, len(words)))))
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(p), SEED) for p in parts], np.uint64))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def node_of(hashes: np.ndarray) -> int:
    """The name of a set of hashes."""
    return _signed(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)) if len(hashes) else 0


def keys_of(hashes: np.ndarray) -> list[int]:
    """A key per band; none for the empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2000):
        least = np.minimum(least, (hashes[at : at + 2000, None] * _FACTORS).min(axis=0))
    return [_signed(xxhash.xxh64_intdigest(row.tobytes(), b)) for b, row in enumerate(least.reshape(BANDS, ROWS))]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


_KEYED = "doc_id long, tx long, node long, n long, fp long, keys array<long>"
_SETS = "node long, hashes binary"
_NO_ID = -(1 << 62)


def _named(docs: DataFrame) -> DataFrame:
    """``doc_id``, a hash of the text, by which a row is found again, and the text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64("text").alias("tx"), "text")


def _keys(docs: DataFrame, width: int) -> DataFrame:
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, marks, texts in rows_of(batches, "doc_id", "tx", "text"):
            columns: list[list] = [ids, marks, [], [], [], []]
            for text in texts:
                hashes = shingles(text, width)
                for column, value in zip(columns[2:], (node_of(hashes), len(hashes), simhash.signed(simhash.majority(hashes)), keys_of(hashes))):
                    column.append(value)
            kinds = (*[pa.int64()] * 5, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in _KEYED.split(", ")])

    return _named(docs).mapInArrow(compute, _KEYED)


def _sets(docs: DataFrame, own: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """The sets of ``nodes``, from the text of one row of each."""
    one = own.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "tx")).alias("one"))
    rows = _named(docs).join(one.select("one.doc_id", "one.tx").distinct(), ["doc_id", "tx"]).select("text")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in rows_of(batches, "text"):
            sets = [shingles(t, width) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(node_of, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "hashes"]
            )

    return rows.mapInArrow(compute, _SETS).dropDuplicates(["node"])


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) that are similar enough."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for us, vs, a, b in rows_of(batches, "u", "v", "a", "b"):
            good = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in zip(a, b)]
            yield _links([(u, v) for u, v, g in zip(us, vs, good) if g])

    of = lambda node, name: sets.select(F.col("node").alias(node), F.col("hashes").alias(name))
    return pairs.join(of("u", "a"), "u").join(of("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(check, "u long, v long")


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])


def _fits(n: str, m: str, least: float) -> F.Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(n, m) >= F.greatest(n, m) * F.lit(least - 1e-9)


def links_between(
    odd: list[tuple[int, int, np.ndarray]], all_: list[tuple[int, int, np.ndarray]], least: float
) -> list[tuple[int, int]]:
    """For each of ``odd`` (node, root, hashes), one similar node of each other root among ``all_``."""
    sizes = np.array([len(h) for _, _, h in all_])
    order = np.argsort(np.concatenate([h for _, _, h in all_]), kind="stable")
    values = np.concatenate([h for _, _, h in all_])[order]
    owner = np.repeat(np.arange(len(all_)), sizes)[order]
    out = []
    for node, root, hashes in odd:
        low, high = np.searchsorted(values, hashes, "left"), np.searchsorted(values, hashes, "right")
        counts = high - low
        at = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        both = np.bincount(owner[at], minlength=len(all_))
        near = np.flatnonzero(both >= least * (len(hashes) + sizes - both) - 1e-12)
        out += {all_[i][1]: (node, all_[i][0]) for i in near.tolist() if all_[i][1] != root}.values()
    return out


def _across(placed: DataFrame, sets: DataFrame, least: float, block: int) -> DataFrame:
    """Links between the components that meet in a bucket. ``placed``: key, node, n, root."""
    parts = placed.groupBy("key", "root").agg(F.sum("n").alias("weight"))
    groups = parts.groupBy("key").agg(
        F.count("*").alias("roots"), F.sum("weight").alias("all"), F.max(F.struct("weight", "root")).alias("most")
    )
    blocks = lambda w: F.ceil(w / block).cast("int")
    groups = stored(groups.where("roots > 1").select(
        "key", F.col("most.root").alias("most"), blocks(F.col("all")).alias("ny"),
        F.greatest(F.lit(1), blocks(F.col("all") - F.col("most.weight"))).alias("nx"),
    ))
    rest = placed.join(groups, "key")
    mine = lambda n: F.pmod(F.xxhash64("node", "key"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    rows = rest.select("key", mine("ny").alias("y"), F.explode(upto("nx")).alias("x"), "node", "root", F.lit(False).alias("odd")).unionByName(
        rest.where(F.col("root") != F.col("most")).select(
            "key", F.explode(upto("ny")).alias("y"), mine("nx").alias("x"), "node", "root", F.lit(True).alias("odd")
        )
    )
    names = ("key", "y", "x", "odd", "node", "root", "hashes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        last = None
        for columns in rows_of(batches, *names):
            found = []
            for key, y, x, odd, node, root, hashes in zip(*columns):
                if (key, y, x) != last:
                    if all(held):
                        found += links_between(held[1], held[0], least)
                    held, last = ([], []), (key, y, x)
                held[odd].append((node, root, np.frombuffer(hashes, np.uint64)))
            yield _links(found)
        yield _links(links_between(held[1], held[0], least) if all(held) else [])

    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.join(sets, "node").select(*names).repartition(n, "key", "y", "x").sortWithinPartitions("key", "y", "x")
    return dealt.mapInArrow(compare, "u long, v long")


def _close(own: DataFrame) -> DataFrame:
    """``(u, v)``: nodes whose fingerprints are within operator 5's radius, spanning links only."""
    nodes = own.where("n > 0").select("node", "fp").distinct()
    one = stored(nodes.groupBy("fp").agg(F.min("node").alias("v")))
    same = nodes.join(one, "fp").where("node != v").select(F.col("node").alias("u"), "v")
    other = one.select(F.col("fp").alias("v"), F.col("v").alias("node_v"))
    linked = simhash.links(one.select("fp")).join(one.select(F.col("fp").alias("u"), F.col("v").alias("node_u")), "u").join(other, "v")
    return same.union(linked.select("node_u", "node_v"))


def components_of(docs: DataFrame, own: DataFrame, width: int = SHINGLE, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """``(u, root)`` of every node that isn't the least of its component; ``own``: stored rows of ``_KEYED``."""
    nodes = own.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    rows = stored(nodes.select(F.explode("keys").alias("key"), "node", "n"))
    # here and below, aggregates are stored before they are joined: both sides of the join are then plain exchanges, which
    # adaptive execution splits where a key is frequent
    buckets = stored(rows.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("first")).where("size > 1"))
    kept = stored(
        rows.join(buckets, "key").select("key", "node", "n", F.col("first.node").alias("v"), F.col("first.n").alias("m"))
    )
    close = stored(_close(own))
    some = stored(kept.select("node").union(close.select("u")).union(close.select("v")).distinct())
    sets = stored(_sets(docs, own, some, width))
    near = kept.where(F.col("node") != F.col("v")).where(_fits("n", "m", least))
    first = near.select(F.col("node").alias("u"), "v").union(close).distinct()
    links = stored(_alike(first, sets, least))
    roots = stored(components(links))
    placed = kept.join(roots.withColumnRenamed("u", "node"), "node", "left")
    placed = stored(placed.select("key", "node", "n", F.coalesce("root", "node").alias("root")))
    more = stored(_across(placed, sets, least, block))
    return components(links.unionByName(more))


def deduplicate(docs: DataFrame, width: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """``docs`` with one document of each component: the one with the least id, and the least node among rows of that
    id; of equal rows, one."""
    tune(docs.sparkSession)
    own = stored(_keys(docs, width))
    roots = components_of(docs, own, width, least).withColumnRenamed("u", "node")
    named = own.select("doc_id", "tx", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    none = (F.col("doc_id") == _NO_ID).alias("none")
    one = named.groupBy("root").agg(F.min(F.struct(none, "doc_id", "node", "tx")).alias("one"))
    one = one.select(F.col("one.doc_id").alias("_nc_id"), F.col("one.tx").alias("_nc_tx"))
    keyed = docs.withColumns({"_nc_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "_nc_tx": F.xxhash64("text")})
    return keyed.join(one, ["_nc_id", "_nc_tx"]).dropDuplicates(["_nc_id", "_nc_tx"]).select(*docs.columns)
