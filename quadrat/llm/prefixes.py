"""Operator 11: the trie of conversation prefixes by van Emde Boas recursion.

1. Turns get their place in the conversation by ranges (no conversation is sorted in one task), conversations are rebuilt
   from the first turns of another one, and cut into chunks of at most ``CHUNK`` turns.
2. Prefixes have names: the exclusive or of a 128-bit hash of (place, turn) over their turns, so a fragment is named from
   the name of its root and its own turns. The fragments' equal copies are one row with a count and the least id.
3. Every round cuts all fragments at half depth, in parallel: the first half is a fragment of the upper trie, the second
   one of the lower forest whose root is the cut prefix's name; then equal fragments are one row again. A whole upper
   fragment is a node with its count; after log2(longest) rounds all nodes are found. A node at depth d was cut at the
   level of d's lowest set bit.
4. Totals are grafted upward: first, level by level, the totals of each lower forest are added to those of the block
   that its cut node lies in; then, from the highest level down, what hangs beyond a block is added to the node at its
   root. Each round is one join and one sum of rows that halve from level to level.
5. The ids of the conversations that end at a node are joined in order in blocks of ``BLOCK`` ids, over range
   partitions, and only those blocks meet for the digest, one after the other.

Defined cases: null roles and texts are empty; turns are ordered by turn (null first), equal ones by the digest of role
and text, and repeated rows stay; rows with a null ``conv_id`` belong to no conversation; very long texts are hashed and
measured whole; an empty table gives no rows. Extra columns are not read. Texts never leave the first pass: a turn is 16
bytes and a length from there on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrat.llm.common import stored, tune
from quadrat.session import ranked

#: Turns of one chunk at most, a power of two.
CHUNK = 1024
#: First turns that a conversation takes from another one at most, and ids that are joined to one text.
SHARED, BLOCK = 8, 2000
NAME = ["x1", "x2"]


def _turns(conversations: DataFrame) -> DataFrame:
    """(c, turn, tok, b): a turn by the digest of its role and text, and the bytes of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(whole.cast("binary"))).alias("tok"),
        F.octet_length(text).cast("long").alias("b"),
    )


def _placed(turns: DataFrame) -> DataFrame:
    """(c, i, tok, b): the turn's place in its conversation, from 1."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the last key only deals repeated rows out
    ranged = stored(turns.repartitionByRange(n, "c", "turn", "tok", F.rand(11)).withColumn("part", F.spark_partition_id()))
    order = [F.col("turn").asc_nulls_first(), F.col("tok")]
    return ranked(ranged, order, F.col("part"), into="i", within=["c"]).select("c", "i", "tok", "b")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c) of every conversation, and (c, i, tok, b) of the rebuilt ones: the first h turns of conversation c - c % 5,
    then their own after their first h; h = crc32(c) % 9."""
    placed = stored(_placed(_turns(conversations)))
    h = F.crc32(F.col("c").cast("string").cast("binary")) % 9
    first = F.when(F.col("i") <= SHARED, F.struct("i", "tok", "b"))
    heads = stored(placed.groupBy("c").agg(F.array_sort(F.collect_list(first)).alias("head")))
    bases = heads.select(F.col("c").alias("base"), F.col("head").alias("taken"))
    whole = heads.withColumn("base", F.col("c") - F.col("c") % 5).join(bases, "base", "left").withColumn("h", h.cast("int"))
    plan = stored(whole.select("c", F.expr("if(taken IS NULL, filter(head, x -> false), slice(taken, 1, h))").alias("taken")))
    shared = plan.select("c", F.posexplode("taken").alias("at", "x")).select("c", (F.col("at") + 1).cast("long").alias("i"), "x.tok", "x.b")
    own = placed.where(F.col("i") > h).join(plan.select("c", F.size("taken").alias("m")), "c")
    own = own.select("c", (F.col("i") - h + F.col("m")).alias("i"), "tok", "b")
    return plan.select("c"), shared.unionByName(own)


def _xor(turns: Column, lane: str, start: Column) -> Column:
    return F.aggregate(turns, start, lambda a, x: a.bitwiseXOR(x[lane]))


def _fragments(turns: DataFrame, chunk: int) -> DataFrame:
    """(c, q, s, r1, r2, e1, e2, t): the chunks of each conversation, with the names of their root and of their end."""
    parts = turns.groupBy("c", F.expr(f"(i - 1) div {chunk}").alias("q")).agg(
        F.array_sort(F.collect_list(F.struct("i", "f1", "f2", "b"))).alias("t"),
        F.bit_xor("f1").alias("o1"),
        F.bit_xor("f2").alias("o2"),
    )
    before = Window.partitionBy("c").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    for r, o in (("r1", "o1"), ("r2", "o2")):
        parts = parts.withColumn(r, F.coalesce(F.bit_xor(o).over(before), F.lit(0)))
    return parts.select(
        "c", "q", (F.col("q") * chunk).alias("s"), "r1", "r2",
        F.col("r1").bitwiseXOR(F.col("o1")).alias("e1"), F.col("r2").bitwiseXOR(F.col("o2")).alias("e2"),
        F.transform("t", lambda x: F.struct(x["f1"].alias("f1"), x["f2"].alias("f2"), x["b"].alias("b"))).alias("t"),
    )


def _one_row(fragments: DataFrame) -> DataFrame:
    """Equal fragments as one row: conversations and the least of them."""
    return fragments.groupBy("s", "e1", "e2").agg(
        F.first("r1").alias("r1"), F.first("r2").alias("r2"), F.first("t").alias("t"), F.sum("n").alias("n"), F.min("c").alias("c")
    )


def _level(depth: Column, top: int) -> Column:
    """The place of a depth's lowest set bit, ``top`` for the root's."""
    bit = F.length(F.bin(depth.bitwiseAND(-depth))) - 1
    return F.when(depth == 0, top).otherwise(F.least(F.lit(top), bit)).cast("int")


def _nodes(whole: DataFrame, k: int, top: int) -> DataFrame:
    """The nodes at the end of fragments of 2^k turns, with the names of their ancestors 2^j turns above, up to the
    fragment's root."""
    size, last = 1 << k, F.element_at("t", -1)
    ups = [
        F.struct(
            F.lit(j).alias("j"),
            *(_xor(F.slice("t", -(1 << j), 1 << j), f, F.col(e)).alias(a) for f, e, a in (("f1", "e1", "a1"), ("f2", "e2", "a2"))),
        )
        for j in range(k)
    ]
    ups.append(F.struct(F.lit(k).alias("j"), F.col("r1").alias("a1"), F.col("r2").alias("a2")))
    return whole.where(F.size("t") == size).select(
        (F.col("s") + size).alias("d"), _level(F.col("s") + size, top).alias("k"),
        F.col("e1").alias("x1"), F.col("e2").alias("x2"),
        F.col("e1").bitwiseXOR(last["f1"]).alias("p1"), F.col("e2").bitwiseXOR(last["f2"]).alias("p2"),
        last["b"].alias("b"), "n", "c", F.array(*ups).alias("ups"),
    )


def _cut(fragments: DataFrame, half: int) -> tuple[DataFrame, DataFrame]:
    """Upper and lower fragments of fragments of at most two halves."""
    upper = F.slice("t", 1, half)
    kept = ["s", "r1", "r2", "e1", "e2", "t", "n", "c"]
    longer = F.size("t") > half
    named = fragments.withColumn("m1", F.when(longer, _xor(upper, "f1", F.col("r1"))).otherwise(F.col("e1")))
    named = named.withColumn("m2", F.when(longer, _xor(upper, "f2", F.col("r2"))).otherwise(F.col("e2")))
    first = named.withColumns({"e1": F.col("m1"), "e2": F.col("m2"), "t": upper}).select(*kept)
    rest = F.slice("t", half + 1, half)
    then = named.where(longer).withColumns({"s": F.col("s") + half, "r1": F.col("m1"), "r2": F.col("m2"), "t": rest}).select(*kept)
    return _one_row(first), _one_row(then)


def _decompose(chunks: DataFrame, longest: int, chunk: int, top: int) -> tuple[DataFrame, DataFrame]:
    """All nodes but the root, and (k, x1, x2, j, a1, a2): the ancestors of nodes of level k, 2^j turns above."""
    base = min(chunk.bit_length() - 1, top)
    now = stored(_one_row(chunks.withColumn("n", F.lit(1))))
    found = [_nodes(now, base, top)]
    for k in range(base - 1, -1, -1):
        upper, lower = _cut(now, 1 << k)
        now = stored(upper.withColumn("up", F.lit(True)).unionByName(lower.withColumn("up", F.lit(False))))
        found.append(_nodes(now.where("up"), k, top))
        now = now.drop("up")
    nodes = stored(reduce(DataFrame.unionByName, found))
    ups = nodes.select("k", *NAME, F.explode("ups").alias("u")).select("k", *NAME, "u.j", "u.a1", "u.a2")
    if longest > 1 << base:  # ancestors at the ends of earlier chunks
        far = nodes.where(F.col("k") > base).select("k", *NAME, "d", "c", F.explode(F.sequence(F.lit(base + 1), "k")).alias("j"))
        far = far.withColumn("q", F.expr(f"d div {chunk} - shiftleft(1L, j - {base})"))
        ends = chunks.select("c", "q", F.col("r1").alias("a1"), F.col("r2").alias("a2"))
        ups = ups.unionByName(far.join(ends, ["c", "q"]).select("k", *NAME, "j", "a1", "a2"))
    return nodes, stored(ups)


SUMS = ["leaf", "saved"]


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.sum(s).alias(s) for s in SUMS))


def _grafted(nodes: DataFrame, ups: DataFrame, top: int) -> DataFrame:
    """(x1, x2, leaf, saved): sums over all nodes below a node, for those that have some. ``nodes``: (d, x1, x2, p1, p2,
    leaf, saved)."""
    below = nodes.select(F.col("p1").alias("x1"), F.col("p2").alias("x2"), (F.col("d") - 1).alias("d"), *SUMS)
    block = stored(_summed(below, *NAME, "d").withColumn("k", _level(F.col("d"), top)))  # sums over blocks of one level
    own = []
    for k in range(top):  # lower forests to the block of their cut node
        mine = block.where(F.col("k") == k)
        own.append(mine.select(*NAME, *SUMS))
        cut = ups.where((F.col("k") == k) & (F.col("j") == k)).select(*NAME, "a1", "a2")
        moved = mine.join(cut, NAME).select(F.col("a1").alias("x1"), F.col("a2").alias("x2"), (F.col("d") - (1 << k)).alias("d"), *SUMS)
        rest = block.where(F.col("k") > k).select(*NAME, "d", *SUMS)
        block = stored(_summed(rest.unionByName(moved), *NAME, "d").withColumn("k", _level(F.col("d"), top)))
    whole = [block.select(*NAME, *SUMS)]
    for k in range(top - 1, -1, -1):  # what hangs beyond a block to the node at its root
        above = ups.where((F.col("k") > k) & (F.col("j") == k)).select(*NAME, "a1", "a2")
        beyond = reduce(DataFrame.unionByName, whole).join(above, NAME).select(F.col("a1").alias("x1"), F.col("a2").alias("x2"), *SUMS)
        whole.append(stored(_summed(own[k].unionByName(beyond), *NAME)))
    return reduce(DataFrame.unionByName, whole)


def _digests(ends: DataFrame) -> DataFrame:
    """(x1, x2, ends_sha256) of nodes at which conversations end. ``ends``: (c, x1, x2)."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in names))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, out = None, [], []
        for x1, x2, c in (*runs(batches, "x1", "x2", "c"), (None, None, None)):
            if ids and ((x1, x2) != node or len(ids) == BLOCK):
                out.append((*node, ids[0], ",".join(map(str, ids))))
                ids = []
            if len(out) == 500 or x1 is None:
                columns = list(zip(*out)) or [()] * 4
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(columns, kinds)], ["x1", "x2", "c", "ids"])
                out = []
            node = (x1, x2)
            if x1 is not None:
                ids.append(c)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for x1, x2, ids in (*runs(batches, "x1", "x2", "ids"), (None, None, "")):
            if (x1, x2) != node:
                if state:
                    out.append((*node, state.hexdigest()))
                if len(out) == 2000 or x1 is None:
                    columns = list(zip(*out)) or [()] * 3
                    kinds = (pa.int64(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(columns, kinds)], ["x1", "x2", "ends_sha256"])
                    out = []
                node, state = (x1, x2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())

    ranged = ends.repartitionByRange(n, *NAME, "c").sortWithinPartitions(*NAME, "c")
    blocks = ranged.mapInArrow(join, "x1 long, x2 long, c long, ids string")
    return blocks.repartition(n, *NAME).sortWithinPartitions(*NAME, "c").mapInArrow(digest, "x1 long, x2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Every node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (long), ends_sha256 (string)."""
    tune(conversations.sparkSession)
    ids, turns = rebuilt(conversations)
    lanes = {f"f{i}": F.xxhash64(F.lit(i), "i", "tok") for i in (1, 2)}
    turns = stored(turns.select("c", "i", "b", *(v.alias(k) for k, v in lanes.items())))
    ends = ids.select("c", F.lit(0).cast("long").alias("f1"), F.lit(0).cast("long").alias("f2")).unionByName(turns.select("c", "f1", "f2"))
    ends = ends.groupBy("c").agg(F.bit_xor("f1").alias("x1"), F.bit_xor("f2").alias("x2"))

    longest = turns.agg(F.max("i")).first()[0] or 0
    top = max(0, longest - 1).bit_length()
    nodes, ups = _decompose(stored(_fragments(turns, chunk)), longest, chunk, top)
    children = nodes.groupBy(F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("n_children"))
    valued = nodes.drop("ups").join(children, NAME, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    valued = valued.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n") - 1) * F.col("b"))
    valued = stored(valued.drop("b", "k"))
    totals = _grafted(valued, ups, top)

    # the root, one row; without any conversation none
    root = ids.agg(F.count("*").alias("n"), F.min("c").alias("c")).where("n > 0").crossJoin(valued.agg(F.count(F.when(F.col("d") == 1, 1)).alias("n_children")))
    zero = F.lit(0).cast("long")
    root = root.select(
        zero.alias("d"), zero.alias("x1"), zero.alias("x2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"),
        "n", "c", "n_children", (F.col("n_children") == 0).cast("long").alias("leaf"), zero.alias("saved"),
    )
    rows = valued.select(*root.columns).unionByName(root)
    parents = rows.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("c").alias("parent_conv_id"))
    below = totals.select(*NAME, *(F.col(s).alias(f"{s}_below") for s in SUMS))
    out = rows.join(below, NAME, "left").join(_digests(ends), NAME, "left").join(stored(parents), ["p1", "p2"], "left")
    return out.select(
        F.col("c").alias("conv_id"), F.col("d").cast("long").alias("depth"), "parent_conv_id",
        F.col("n").cast("long").alias("n_convs"), F.col("n_children").cast("long").alias("n_children"),
        (F.col("leaf") + F.coalesce("leaf_below", zero)).alias("n_leaves"),
        (F.col("saved") + F.coalesce("saved_below", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
