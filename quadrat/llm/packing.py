"""Operator 9: bound-certified repacking of tokenised documents into fixed-length sequences.

1. Each document becomes ids plus an end id; documents longer than the capacity are cut into full pieces and one rest.
   A piece's row is a few numbers, so everything that follows moves numbers only, never texts.
2. Pieces are dealt to groups of bounded size. A group is packed by best-fit decreasing, and dual-feasible functions
   give a lower bound of the sequences that its pieces need.
3. Exchange rounds. A group whose count equals its bound keeps its well-filled sequences; the sequences with a gap of
   every group are opened, and their pieces meet those of other groups, are dealt anew to fewer groups and packed
   again. Rounds end when one group has packed all that is left; each round leaves a small part of the one before.

Memory: one group's numbers (``GROUP_ITEMS`` pieces) in a task; where texts are tokenised, one lot of texts (a longer text
goes alone), and in a worker, as long as the stage runs, the tokenizer and the ids of known words, bounded in bytes.
Nothing is collected to the driver but counts. Rounds end after ``max_rounds`` at the latest; each leaves a few hundredths of the pieces.

Defined cases: a null text is empty and gives the end id alone; repeated rows are packed one by one; a null id is kept;
an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import Memory, for_stage, lots, rows_of, stored, tune

CAPACITY = 4096
END_ID = 1
#: Pieces that are packed together at most, on average; a group's cost is linear in it.
GROUP_ITEMS = 20_000
#: A sequence filled less than this is opened for the exchange, also in a certified group.
FULL_ENOUGH = 0.98
#: Bytes that a worker's memory of words takes while the stage runs, and characters of the texts encoded at once.
WORD_BYTES, LOT_CHARS = 64 << 20, 3 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Chunks with other characters than these, or with ``<|``, send their text through the tokenizer whole: its normaliser
#: may then work across chunks, its white space differ from Arrow's, or a special token start.
_ODD = r"[^!-~ß-öø-đĕ-įĺ-ňŋ-ž]|<\|"
_WORDS = re.compile(r" |'s|'t|'re|'ve|'m|'ll|'d|[a-zß-ž]+|\d|[^a-zß-ž0-9 ]+")
#: Stands after the ids of a chunk; every id has zeros in its upper bytes.
_BETWEEN = b"\xff" * 4
#: White space to Arrow, but not to the tokenizer.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


class Encoder:
    """Texts to little-endian 32-bit ids, with a memory of words.

    The tokenizer lower-cases, drops white space and merges within a word only, so a word's ids don't depend on its
    neighbours. Arrow splits a lot of texts into chunks at white space and tells the distinct ones; these are split into
    words, of which those unknown go to the tokenizer in one string and are told apart by the ids that end a word. The
    ids of all chunks are then gathered by numpy. A text with an ``_ODD`` chunk goes to the tokenizer as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.words = Memory(WORD_BYTES)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # of ids: whether they end a word
        self.last[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _direct(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _chunk_ids(self, chunks: list[str]) -> np.ndarray:
        """The ids of chunks, one after the other, ``_BETWEEN`` behind each."""
        parts = _WORDS.findall(" ".join([*chunks, ""]))
        self.words.turn()
        unknown = self.words.missing(set(parts) - {" "})
        if unknown:
            ids = self._ids(" ".join(unknown))
            data = ids.tobytes()
            ends = [0, *((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()]
            self.words.keep(unknown, [data[a:b] for a, b in zip(ends, ends[1:], strict=False)])
        known = self.words.young
        known[" "] = _BETWEEN
        return np.frombuffer(b"".join(map(known.__getitem__, parts)), "<u4")

    def _lot(self, texts: list[str]) -> Iterator[bytes]:
        split = pc.utf8_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
        coded = split.values.dictionary_encode()
        codes, chunks = coded.indices.to_numpy(), coded.dictionary
        odd = pc.match_substring_regex(chunks, _ODD)
        ids = self._chunk_ids(pc.if_else(odd, "", chunks).to_pylist())
        ends = np.flatnonzero(ids == 0xFFFFFFFF)
        starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        lengths = (ends - starts)[codes]
        to = np.concatenate(([0], np.cumsum(lengths)))  # the first of each chunk's ids among all
        ids = ids[np.repeat(starts[codes] - to[:-1], lengths) + np.arange(to[-1])]
        borders = split.offsets.to_numpy()
        whole = np.concatenate(([0], np.cumsum(odd.to_numpy(zero_copy_only=False)[codes])))[borders]
        at = to[borders].tolist()
        for text, a, b, direct in zip(texts, at, at[1:], np.diff(whole).tolist()):
            if direct or any(c in text for c in _SEPARATORS):
                yield self._direct(text)
            else:
                yield ids[a:b].tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        for part in lots(texts, len(texts), LOT_CHARS):
            yield from self._lot(part)

    def __call__(self, text: str) -> bytes:
        return next(self.encode([text]))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``PIECES`` of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = for_stage(Encoder, tokenizer_path).encode, np.asarray([end_id], "<u4").tobytes()
        for ids, texts in rows_of(batches, "doc_id", "text"):
            out: list[list] = [[], [], [], [], []]
            for doc, data in zip(ids, encode([t or "" for t in texts])):
                data += end
                for n, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    for column, value in zip(out, (doc, n, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size; sizes come in falling order. Open bins are stacks by free space, and a bit mask of the
    free spaces that occur finds the tightest one in a few machine steps."""
    bins = np.empty(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, opened = 0, 0
    for i, size in enumerate(sizes.tolist()):
        above = mask >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, b, opened = capacity, opened, opened + 1
        bins[i] = b
        if left := room - size:
            free[left].append(b)
            mask |= 1 << left
    return bins


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that the sizes need at least: the largest bound among dual-feasible functions.

    ``f_e`` lifts sizes over ``capacity - e`` to full and drops those under ``e``; ``u_k`` rounds ``(k + 1) x`` down to
    the grid of ``k``, and leaves sizes on the grid as they are. Both never let a bin's content exceed 1, so the sum of
    the images bounds the bins from below.
    """
    if not len(sizes):
        return 0
    counts = np.bincount(sizes, minlength=capacity + 1)[: capacity + 1]
    x = np.arange(capacity + 1)
    best = -(-int((counts * x).sum()) // capacity)
    for e in range(1, capacity // 2 + 1, max(1, capacity // 256)):
        image = np.where(x > capacity - e, capacity, np.where(x < e, 0, x))
        best = max(best, -(-int((counts * image).sum()) // capacity))
    for k in range(1, 33):
        on_grid = ((k + 1) * x) % capacity == 0
        image = np.where(on_grid, x * k, ((k + 1) * x // capacity) * capacity)  # in units of capacity * k
        best = max(best, -(-int((counts * image).sum()) // (capacity * k)))
    return best


_PLACED = f"{PIECES}, sequence_id long, offset long, opened boolean"


def _round(items: DataFrame, groups: int, turn: int, capacity: int) -> DataFrame:
    """One packing of ``items`` in ``groups`` groups. ``opened`` marks pieces of sequences with a gap."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="grp").sort_values(
            ["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable"
        )
        sizes = rows["length"].to_numpy()
        bins = best_fit_decreasing(sizes, capacity)
        filled = np.bincount(bins, weights=sizes).astype(np.int64)
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(sizes[order])
        starts = ends - sizes[order]
        offset = np.empty(len(sizes), np.int64)
        first = np.concatenate(([0], np.cumsum(filled)[:-1]))
        offset[order] = starts - first[bins[order]]
        gap = filled < FULL_ENOUGH * capacity
        if len(filled) > lower_bound(sizes, capacity):  # not certified: the emptiest fiftieth takes part too
            at = len(filled) // 50
            gap |= (filled < capacity) & (filled <= np.partition(filled, at)[at])
        return rows.assign(
            sequence_id=(np.int64(turn) << 56) | (np.int64(key[0]) << 28) | bins, offset=offset, opened=gap[bins]
        )

    # the row's place in the stored table tells repeated rows apart, so that no group takes them all
    mark = F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(turn), F.monotonically_increasing_id())
    dealt = items.withColumn("grp", F.pmod(mark, F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(pack, _PLACED)


def pack(items: DataFrame, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, max_rounds: int = 12) -> DataFrame:
    """``items`` (``PIECES``) with ``sequence_id`` and ``offset``."""
    done: list[DataFrame] = []
    for turn in range(max_rounds):
        n = items.count()
        groups = max(1, -(-n // group_items))
        placed = stored(_round(items, groups, turn, capacity))
        if groups == 1 or turn == max_rounds - 1:
            done.append(placed)
            break
        done.append(placed.where(~F.col("opened")))
        items = placed.where("opened").select("doc_id", "piece", "start", "length", "ids_crc32")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("opened")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its place; see the module's text."""
    tune(docs.sparkSession)
    return pack(stored(pieces(docs, tokenizer_path, capacity)), capacity)
