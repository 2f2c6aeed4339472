"""Operator 13: phrase collocations by SETM, set-oriented mining over occurrence relations.

1. Texts are split into pieces and words; a word's place counts on inside its piece and jumps by ``JUMP`` or more to the
   next piece, so that place + k is the k-th word on, or nothing. Words are counted for each language.
2. R1 holds the occurrences (place, word) of frequent words, sorted by place, and is stored.
3. For k = 1 to 4: the merge-join of Rk with R1 on place + k gives the occurrences of phrases of k + 1 words, these groups
   are counted, and the occurrences are joined again and kept (and stored, as R(k+1)) where their group is frequent.
4. Every cut of a frequent phrase is scored by exact decimal arithmetic; phrases that a longer one contains as often go.

A relation is stored in rows of about ``SLICE`` bytes of text (with the next four words of a longer text, so nothing is
lost between rows), sorted inside the row. Joins are therefore local and move nothing; counts are summed inside the task,
then shuffled by group, so a frequent phrase is one row a task. Words and phrases are named by 64-bit hashes that take
the language in (a billion different ones collide with a chance of 3 %). Which groups are frequent reaches the tasks as a
bit table of 8 MB at most, however many they are: it lets a few others pass, whose exact count then drops them.

Defined cases: null text is empty, null language ``und``; a word of any length is a word, a text of any length is read
whole, in slices; repeated rows count again; ties are ranked by count, then by the phrase's bytes; an empty table gives
no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrat.llm.common import rows_of, stored, tune, utf8

LEAST, LONGEST, TOP = 100, 5, 2000
#: Bytes of text that a row of a relation is made from, and that are worked on at once.
SLICE = 1 << 18
#: Places between two pieces, over LONGEST.
JUMP = 8
#: Bytes from which a word is hashed by itself.
LONG = 1 << 14
#: Groups that a task counts before it hands them over.
HELD = 3 << 18
#: Which tasks say how a phrase is made: one in so many, by its name; the others are asked for what these haven't met.
ASKED = 8

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_BREAK = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")
#: The words after a slice that its phrases may reach.
_AHEAD = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]*+(?:[^\x20\x09.,;:!?\x0A-\x0D]++[\x20\x09.,;:!?\x0A-\x0D]*+){0,%d}" % (LONGEST - 1))

_rng = np.random.default_rng(20240513)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = int(_rng.integers(2**62, 2**63)) | 1
_ODD = [np.uint64(int(x) | 1) for x in _rng.integers(2**62, 2**63, 3)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base % (1 << 64)))
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = (_powers(b, SLICE) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[0]
    h = (h ^ (h >> np.uint64(29))) * _ODD[1]
    return h ^ (h >> np.uint64(32))


def _extended(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The name of a phrase and one more word."""
    return _mix(phrase * _ODD[2] + word)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(ends - starts >= LONG)
    for i in long.tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    at = 0
    for stop in [*long.tolist(), len(starts)]:
        while at < stop:
            upto = int(np.searchsorted(ends[:stop], starts[at] + SLICE, side="right"))
            low, high = int(starts[at]), int(ends[upto - 1])
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(_BYTES[data[low:high]] * _UP[: high - low], out=sums[1:])
            s, e = starts[at:upto] - low, ends[at:upto] - low
            out[at:upto] = (sums[e] - sums[s]) * _DOWN[s] + (e - s).astype(np.uint64)
            at = upto
        at = stop + 1
    return out


def words(data: bytes, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, names, starts, ends) of the words."""
    raw = np.frombuffer(data, np.uint8)
    kind = _KIND[raw]
    inside = np.concatenate(([0], (kind == 0).view(np.int8), [0]))
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    breaks = np.flatnonzero(kind == 2)
    places = np.arange(len(starts)) + JUMP * np.searchsorted(breaks, starts)
    return places, _mix(_word_hashes(raw, starts, ends) ^ np.uint64(seed)), starts, ends


def slices(data: bytes) -> Iterator[tuple[bytes, int]]:
    """Slices of a text at word ends, each with the words after it that a phrase may reach, and where these begin."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + SLICE, n)
        if end < n:
            back = _BREAK.search(data[at:end][::-1])
            if back and back.start() < end - at - 1:
                end -= back.start()
            else:
                ahead = _BREAK.search(data, end)
                end = ahead.start() if ahead else n
        yield data[at : _AHEAD.match(data, end).end()], end - at
        at = end


def _lots(langs: list[str], texts: list[bytes]) -> Iterator[tuple[str, int, bytes, int]]:
    """(language, seed, slice, its own bytes): the texts of one language after each other, lower-cased, in slices."""
    by: dict[str, list[bytes]] = {}
    for lang, text in zip(langs, texts):
        by.setdefault(lang, []).append(text.lower())  # of bytes: A to Z only
    for lang, own in by.items():
        seed = xxhash.xxh64_intdigest(lang.encode())
        for data, border in slices(b"\n".join(own)):
            yield lang, seed, data, border


def _merge_join(places: np.ndarray, r1: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ``places`` + k is among the places of R1: (in the first, in R1). Both sorted."""
    at = np.searchsorted(r1, places + k)
    hit = np.flatnonzero(np.append(r1, -1)[at] == places + k)
    return hit, at[hit]


class Tally:
    """Counts of names, merged now and then, handed over when too many are held."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, names: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        part = np.unique(names, return_counts=True)
        self.parts.append(part)
        self.size += len(part[0])
        if self.size > 2 * HELD:
            self.merge()
            if self.size > HELD:
                yield from self.rest()

    def merge(self) -> None:
        if len(self.parts) > 1:
            names, counts = (np.concatenate(x) for x in zip(*self.parts))
            order = np.argsort(names)
            names, counts = names[order], counts[order]
            first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
            self.parts = [(names[first], np.add.reduceat(counts, first))]
        self.size = sum(len(p[0]) for p in self.parts)

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.merge()
        yield from self.parts
        self.parts, self.size = [], 0


_COUNTS = "name long, n long"


def _counted(found: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    names, counts = found
    for at in range(0, len(names), 100_000):
        columns = [pa.array(names[at : at + 100_000].view(np.int64)), pa.array(counts[at : at + 100_000].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["name", "n"])


_WORDS = "lang string, name long, word binary, n long"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts, and the number of all words of each language (without a name)."""
    kinds = pa.schema([("lang", pa.string()), ("name", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])
    held: list[pa.Table] = []
    totals: dict[str, int] = {}

    def merged() -> pa.Table:
        whole = pa.concat_tables(held).group_by("name", use_threads=False).aggregate([("lang", "one"), ("word", "one"), ("n", "sum")])
        return whole.rename_columns({"lang_one": "lang", "word_one": "word", "n_sum": "n"}).select(kinds.names).cast(kinds)

    for langs, texts in rows_of(batches, "lang", "body"):
        for lang, seed, data, border in _lots(langs, texts):
            _, names, starts, ends = words(data, seed)
            names = names[starts < border]
            totals[lang] = totals.get(lang, 0) + len(names)
            some, first, counts = np.unique(names, return_index=True, return_counts=True)
            text = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
            columns = [pa.array([lang] * len(some), pa.string()), some.view(np.int64), pa.array(text, pa.binary()), counts]
            held.append(pa.table(columns, schema=kinds))
            if sum(t.num_rows for t in held) > HELD:
                held = [merged()]
                if held[0].num_rows > HELD // 2:
                    yield from held.pop().to_batches(100_000)
    if held:
        yield from merged().to_batches(100_000)
    none = pa.nulls(len(totals), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(totals, pa.string()), none, pa.nulls(len(totals), pa.binary()), pa.array(totals.values(), pa.int64())], schema=kinds)


class Frequent:
    """The bit table of frequent names: 2^26 bits, of which one is set for each."""

    WORD, BIT = 44, 38

    def __init__(self, counts: DataFrame):
        word = F.shiftrightunsigned("name", self.WORD).cast("int").alias("word")
        bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(name, {self.BIT}) & 63 as int))").alias("bit")
        rows = counts.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        table = np.zeros(1 << 64 - self.WORD, np.uint64)
        table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
        self.table = counts.sparkSession.sparkContext.broadcast(table)

    @staticmethod
    def has(table: np.ndarray, names: np.ndarray) -> np.ndarray:
        bits = table[(names >> np.uint64(Frequent.WORD)).astype(np.int64)]
        return (bits >> ((names >> np.uint64(Frequent.BIT)) & np.uint64(63)) & np.uint64(1)).astype(bool)


#: ``first`` of the words of R1 begin in the slice. ``seen`` are phrases that the task hasn't met before, by name, and how
#: they are made: the phrase before the last word and that word.
_RELATION = (
    "lang string, first int, gap1 array<int>, item1 array<long>, gap array<int>, item array<long>, "
    "seen array<struct<name: long, prefix: long, last: long>>"
)
_SEEN = pa.list_(pa.struct([("name", pa.int64()), ("prefix", pa.int64()), ("last", pa.int64())]))
_TYPES = (pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), _SEEN)
_NAMES = ["lang", "first", "gap1", "item1", "gap", "item", "seen"]


def _gaps(places: np.ndarray) -> np.ndarray:
    return np.diff(places, prepend=0).astype(np.int32)


def _one(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _row(lang: str, first: int, p1: np.ndarray, i1: np.ndarray, p: np.ndarray, i: np.ndarray, seen: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    columns = [pa.array([lang]), pa.array([first], pa.int32())]
    for places, items in ((p1, i1), (p, i)):
        columns += [_one(_gaps(places), pa.int32()), _one(items.view(np.int64), pa.int64())]
    structs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in seen], fields=list(_SEEN.value_type))
    columns.append(pa.ListArray.from_arrays(pa.array([0, len(structs)], pa.int32()), structs))
    return pa.RecordBatch.from_arrays(columns, _NAMES)


class _Seen:
    """Which names a task has met, forgotten when they are many."""

    def __init__(self):
        self.names = np.zeros(0, np.int64)  # sorted

    def new(self, names: np.ndarray) -> np.ndarray:
        """Places in ``names`` of the first of each name that is new."""
        some, at = np.unique(names.view(np.int64), return_index=True)
        place = np.searchsorted(self.names, some)
        fresh = np.append(self.names, 0)[place] != some if len(self.names) else np.ones(len(some), bool)
        fresh |= place == len(self.names)
        kept = np.zeros(0, np.int64) if len(self.names) > HELD else self.names
        self.names = np.sort(np.concatenate((kept, some[fresh])))
        return at[fresh]


def _first_relation(table):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for langs, texts in rows_of(batches, "lang", "body"):
            for lang, seed, data, border in _lots(langs, texts):
                places, names, starts, _ = words(data, seed)
                kept = np.flatnonzero(Frequent.has(table.value, names))
                if len(kept):
                    places, names, starts = (x[kept] for x in (places, names, starts))
                    yield _row(lang, int((starts < border).sum()), places, names, none, none.view(np.uint64), (none, none, none))

    return build


def _relations(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple]:
    """(language, R1 places, R1 items, Rk places, Rk items) of each row."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = [batch.column(batch.schema.get_field_index(n))[at] for n in _NAMES[:6]]
            p1, p = (np.cumsum(row[j].values.to_numpy(zero_copy_only=False), dtype=np.int64) for j in (2, 4))
            i1, i = (row[j].values.to_numpy(zero_copy_only=False).view(np.uint64) for j in (3, 5))
            first = row[1].as_py()
            yield row[0].as_py(), p1, i1, *((p1[:first], i1[:first]) if k == 1 else (p, i))


def _count_longer(k: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for _, p1, i1, p, i in _relations(batches, k):
            here, there = _merge_join(p, p1, k)
            for part in tally.add(_extended(i[here], i1[there])):
                yield from _counted(part)
        for part in tally.rest():
            yield from _counted(part)

    return count


def _next_relation(k: int, table):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for lang, p1, i1, p, i in _relations(batches, k):
            here, there = _merge_join(p, p1, k)
            names = _extended(i[here], i1[there])
            kept = np.flatnonzero(Frequent.has(table.value, names))
            if not len(kept):
                continue
            here, there, names = here[kept], there[kept], names[kept]
            mine = _asked(names)
            prefix, last = i[here[mine]].view(np.int64), i1[there[mine]].view(np.int64)
            at = seen.new(names[mine])
            new = names[mine][at].view(np.int64), prefix[at], last[at]
            # of R1, only what a phrase may still reach
            reach = np.zeros(len(p1), bool)
            for more in range(k + 1, LONGEST):
                reach[_merge_join(p[here], p1, more)[1]] = True
            yield _row(lang, 0, p1[reach], i1[reach], p[here], names, new)

    return build


def _asked(names: np.ndarray) -> np.ndarray:
    task = TaskContext.get()
    own = task.partitionId() if task else 0
    return np.flatnonzero((names >> np.uint64(17)) % np.uint64(ASKED) == np.uint64(own % ASKED))


_MADE = "lang string, name long, prefix long, last long"


def _rest(k: int, table):
    """How the phrases in ``table`` are made, from Rk."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for lang, p1, i1, p, i in _relations(batches, k):
            here, there = _merge_join(p, p1, k)
            names = _extended(i[here], i1[there])
            kept = np.flatnonzero(Frequent.has(table.value, names))
            at = kept[seen.new(names[kept])]
            columns = [pa.array([lang] * len(at), pa.string()), *(pa.array(x.view(np.int64)) for x in (names[at], i[here[at]], i1[there[at]]))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "name", "prefix", "last"])

    return find


def _frequent(counts: DataFrame, least: int) -> DataFrame:
    return stored(counts.groupBy("name").agg(F.sum("n").alias("f")).where(F.col("f") >= least))


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, n) of all languages, and (lang, phrase, size, f) of the phrases of up to five words that are frequent."""
    with _few_rows_at_once(docs.sparkSession):
        return _frequent_phrases(docs, least)


#: Stored rows that a task decodes at once. A row of a relation may take 16 times the bytes of its slice.
_AT_ONCE = 32


@contextmanager
def _few_rows_at_once(spark: SparkSession) -> Iterator[None]:
    """Relations are read in actions inside this block: Spark would decode 4096 of their rows at once."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    former = spark.conf.get(name)
    spark.conf.set(name, str(_AT_ONCE))
    try:
        yield
    finally:
        spark.conf.set(name, former)


def _frequent_phrases(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), utf8("text").alias("body"))
    tally = own.mapInArrow(_count_words, _WORDS).groupBy("lang", "name").agg(F.sum("n").alias("n"), F.first("word").alias("word"))
    tally = stored(tally.where(F.col("name").isNull() | (F.col("n") >= least)))
    totals = tally.where("name IS NULL").select("lang", "n")
    single = tally.where("name IS NOT NULL").select("lang", "name", F.col("word").cast("string").alias("phrase"), F.col("n").alias("f"))
    counts = single.select("name", "f")
    relation = stored(own.mapInArrow(_first_relation(Frequent(counts).table), _RELATION))

    longest, found = single, [single.withColumn("size", F.lit(1))]
    last = single.select(F.col("name").alias("last"), F.col("phrase").alias("word"))
    for k in range(1, LONGEST):
        counts = _frequent(relation.drop("seen").mapInArrow(_count_longer(k), _COUNTS), least)
        former, relation = relation, stored(relation.drop("seen").mapInArrow(_next_relation(k, Frequent(counts).table), _RELATION))
        met = stored(relation.select("lang", F.inline("seen")).dropDuplicates(["name"]))
        missing = counts.join(met, "name", "left_anti").select("name")
        rest = former.drop("seen").mapInArrow(_rest(k, Frequent(missing).table), _MADE).join(missing, "name", "left_semi")
        met = met.unionByName(rest.dropDuplicates(["name"]))
        before = longest.select(F.col("name").alias("prefix"), F.col("phrase").alias("before"))
        made = met.join(counts, "name").join(before, "prefix").join(last, "last")
        longest = stored(made.select("lang", "name", F.concat_ws(" ", "before", "word").alias("phrase"), "f"))
        found.append(longest.withColumn("size", F.lit(k + 1)))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return totals, whole.drop("name")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    tune(docs.sparkSession)
    totals, phrases = frequent_phrases(docs, least)
    candidates = phrases.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    # a longer phrase that contains another as often contains one that is longer by a word and as frequent
    longer = candidates.where("size > 2").select("lang", "a", F.expr("explode(array(slice(w, 1, size - 1), slice(w, 2, size - 1)))").alias("w"))
    covered = longer.groupBy("lang", F.array_join("w", " ").alias("phrase")).agg(F.max("a").alias("inside"))
    kept = candidates.join(covered, ["lang", "phrase"], "left").where("inside IS NULL OR inside < a")

    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("left"), F.expr("array_join(slice(w, k + 1, size(w)), ' ')").alias("right")
    )
    part = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    exact = "(cast(1000 * a as decimal(19)) * cast(n as decimal(19))) div (cast(l as decimal(19)) * cast(r as decimal(19)))"
    scored = cuts.join(totals, "lang").withColumn("score", F.expr(exact).cast("long"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x"))
    rows = lowest.select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
