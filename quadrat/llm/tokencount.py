"""Operator 4: token counts by dynamic programming over a trie of pre-tokens.

A unigram model segments each pre-token (a run without white space, led by the vocabulary's word mark). The forward
score of a prefix sums over all its segmentations and depends on the prefix alone, so pre-tokens are inserted in a
trie and each node's scores are computed once, however many pre-tokens share it. Its terminal keeps the number of
tokens of the best segmentation and the forward score; a document's counts are sums over its pre-tokens.

The pieces are those of a public vocabulary (path given). Their probabilities are fitted here, on every pre-token of every
text: from Zipf's by rank, two rounds of counting the best segmentations, one added to each count. Pre-tokens are counted
and stored once, sorted, and each round segments each different one once; only the counts of pieces reach the driver.
Characters outside the vocabulary fall back to their bytes.

Then one pass without a shuffle: each worker keeps one trie for all its tasks of a stage, and begins it anew when
it has ``ROOM`` nodes; terminals are remembered longer, bounded in bytes; pre-tokens of over ``LONG`` characters are scored beside it, with as many prefixes in memory as
the longest piece has characters. What is remembered are results only, so counts don't depend on how rows are dealt to
tasks.

Defined cases: null and blank texts have no tokens and score 0; very long texts and pre-tokens are counted whole; of
segmentations that tie, the one whose last piece is longest counts; a null id is kept; repeated rows are counted one by
one; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import Memory, for_stage, lots, rows_of, spread, stored, tune

MARK = "▁"
#: Nodes of a worker's trie, and characters of a pre-token that is inserted in it.
ROOM, LONG = 500_000, 400
#: Bytes that a worker's terminals take.
TERMINAL_BYTES = 112 << 20
#: Bytes of pre-tokens that are counted at once, and rows that are handed over at once.
COUNTED_BYTES, HANDED = 48 << 20, 50_000
#: Windows of a ``sample``, and their words.
SAMPLED, WINDOW = 1000, 100
ROUNDS = 2
SCHEMA = "doc_id long, n_pretokens long, n_tokens long, forward_logprob double"

#: Of a prefix: forward score, score and number of tokens of the best segmentation.
Scores = tuple[float, float, int]
_START: Scores = (0.0, 0.0, 0)


def zipf(size: int) -> list[float]:
    """Log-probabilities by rank."""
    norm = math.log(sum(1 / (r + 1) for r in range(size)))
    return [-math.log(r + 1) - norm for r in range(size)]


def strings(words: pa.Array) -> list[str]:
    """Words without white space as a list; ten times as fast as one by one."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py().split("\n")


def shared(one: str, other: str) -> int:
    """Characters that two strings begin with alike."""
    n = 0
    for a, b in zip(one, other):
        if a != b:
            break
        n += 1
    return n


class Endings:
    """The pieces that end at a character, by a machine over their reversed-suffix links (Aho-Corasick), so that a
    node looks at pieces that match only."""

    def __init__(self, pieces: dict[str, float]):
        self.step: dict[tuple[int, str], int] = {}
        parent, found = [(0, "")], [None]
        for piece in pieces:
            state = 0
            for char in piece:
                nxt = self.step.get((state, char))
                if nxt is None:
                    nxt = self.step[state, char] = len(parent)
                    parent.append((state, char))
                    found.append(None)
                state = nxt
            found[state] = piece
        depth = [0] * len(parent)
        for s in range(1, len(parent)):
            depth[s] = depth[parent[s][0]] + 1
        self.longest = max(depth)
        self.link = [0] * len(parent)
        self.pieces: list[tuple[tuple[int, float], ...]] = [()] * len(parent)
        for s in sorted(range(1, len(parent)), key=depth.__getitem__):
            before, char = parent[s]
            self.link[s] = self.advance(self.link[before], char) if before else 0
            own = ((len(found[s]), pieces[found[s]]),) if found[s] is not None else ()
            self.pieces[s] = own + self.pieces[self.link[s]]

    def advance(self, state: int, char: str) -> int:
        step = self.step
        if (nxt := step.get((state, char))) is not None:
            return nxt
        while state:
            state = self.link[state]
            if (nxt := step.get((state, char))) is not None:
                return nxt
        return 0


class Trie:
    """Scores of pre-tokens. Insertion in sorted order walks from the path of the pre-token before; nodes stay, so that
    later lots of texts find the prefixes of earlier ones scored."""

    def __init__(self, pieces: dict[str, float], byte_score: float, room: int = ROOM):
        self.pieces, self.byte_score, self.room = pieces, byte_score, room
        self.endings = Endings(pieces)
        self.terminals = Memory(TERMINAL_BYTES)  # (tokens, forward score) of pre-tokens
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # of node and character
        self.state, self.scores = [0], [_START]

    def _score(self, state: int, char: str, path: Sequence[Scores]) -> Scores:
        """Scores of the prefix that ends in ``char``; ``path`` has those of the prefixes before, the nearest last."""
        top, tokens, into = -math.inf, 0, []
        for length, score in self.endings.pieces[state]:
            forward, best, count = path[-length]
            into.append(forward + score)
            best += score
            if best > top:
                top, tokens = best, count + 1
        if char not in self.pieces:
            n = len(char.encode("utf-8", "surrogatepass"))
            forward, best, count = path[-1]
            into.append(forward + n * self.byte_score)
            if best + n * self.byte_score > top:
                top, tokens = best + n * self.byte_score, count + n
        if len(into) == 1:
            return into[0], top, tokens
        if len(into) == 2:
            one, other = into
            return (one if one > other else other) + math.log(1.0 + math.exp(-abs(one - other))), top, tokens
        most = max(into)
        return most + math.log(sum([math.exp(x - most) for x in into])), top, tokens

    def best(self, state: int, char: str, before: Sequence[float]) -> tuple[float, int]:
        """Score of the best segmentation of the prefix that ends in ``char``, and characters of its last piece;
        ``before`` has the scores of the prefixes before, the nearest last."""
        top, length = -math.inf, 0
        for n, score in self.endings.pieces[state]:
            if before[-n] + score > top:
                top, length = before[-n] + score, n
        if char not in self.pieces:
            score = before[-1] + len(char.encode("utf-8", "surrogatepass")) * self.byte_score
            if score > top:
                top, length = score, 1
        return top, length

    def insert(self, pretokens: list[str]) -> list[tuple[int, float]]:
        """(tokens, forward score) of each of sorted pre-tokens."""
        child, state, scores, score = self.child, self.state, self.scores, self._score
        advance, step = self.endings.advance, self.endings.step
        nodes, path = [0], [_START]  # of the first characters, the mark among them
        previous, out = "", []
        for word in pretokens:
            if len(word) > LONG:
                out.append(self.alone(word))
                continue
            if len(scores) > self.room:  # within a lot too: one text may have any number of different pre-tokens
                self.clear()
                child, state, scores = self.child, self.state, self.scores
                nodes, path = [0], [_START]
            kept = shared(previous, word) + 2 if len(nodes) > 1 else 1
            del nodes[kept:], path[kept:]
            above = nodes[-1]
            for char in (MARK + word)[len(nodes) - 1 :]:
                key = above * 0x110000 + ord(char)
                node = child.get(key)
                if node is None:
                    node = child[key] = len(scores)
                    at = state[above]
                    if (nxt := step.get((at, char))) is None:
                        nxt = advance(at, char)
                    state.append(nxt)
                    scores.append(score(nxt, char, path))
                nodes.append(node)
                path.append(scores[node])
                above = node
            forward, _, count = path[-1]
            out.append((count, forward))
            previous = word
        return out

    def alone(self, word: str) -> tuple[int, float]:
        """The same of one pre-token, without nodes: only as many prefixes are held as a piece can reach back."""
        state, path, reach = 0, [_START], self.endings.longest
        for char in MARK + word:
            state = self.endings.advance(state, char)
            path.append(self._score(state, char, path))
            if len(path) > 4 * reach:
                del path[:-reach]
        return path[-1][2], path[-1][0]

    def measure(self, texts: list[str]) -> Iterator[tuple[int, int, float]]:
        """(pre-tokens, tokens, forward score) of each text."""
        for lot in lots(texts, 2000, 2 << 20):
            split = pc.utf8_split_whitespace(pa.array(lot, pa.string()))  # at least one word a text, blank at its edges
            coded = split.flatten().dictionary_encode()
            words, codes = strings(coded.dictionary), coded.indices.to_numpy()
            self.terminals.turn()
            new = sorted(self.terminals.missing({w for w in words if w}))
            self.terminals.keep(new, self.insert(new))
            known = self.terminals.young
            found = [known[w] if w else (0, 0.0) for w in words]
            edges = split.offsets.to_numpy()
            real = np.array([w != "" for w in words])[codes]
            tokens = np.array([x[0] for x in found], np.int64)[codes]
            scores = np.array([x[1] for x in found])[codes]
            sums = (np.add.reduceat(x, edges[:-1], dtype=np.int64).tolist() for x in (real, tokens))
            for n, count, first, last in zip(*sums, edges.tolist(), edges[1:].tolist()):
                yield n, count, math.fsum(scores[first:last].tolist())


def segments(word: str, trie: Trie) -> Iterator[str]:
    """The pieces of the best segmentation, the last first, characters outside the vocabulary among them. Of a prefix a
    length is held, and scores only as far as a piece can reach back."""
    path, state, reach = MARK + word, 0, trie.endings.longest
    best, back = [0.0], array("L")
    for char in path:
        state = trie.endings.advance(state, char)
        top, length = trie.best(state, char, best)
        best.append(top)
        back.append(length)
        if len(best) > 4 * reach:
            del best[:-reach]
    end = len(path)
    while end:
        start = end - back[end - 1]
        yield path[start:end]
        end = start


def tally(words: Iterable[tuple[str, int]], trie: Trie) -> Counter[str]:
    """How often each piece is in the best segmentations of pre-tokens that occur so many times. The best segmentation of
    a prefix is part of those that go on from it, so along the path of the pre-token before, a prefix holds the count of
    all that pass it and hands it on when it is left; sorted pre-tokens share most of their paths."""
    pieces, endings, byte = trie.pieces, trie.endings.pieces, trie.byte_score
    advance, step = trie.endings.advance, trie.endings.step
    counts: Counter[str] = Counter()
    path, state, best, back, passing = "", [0], [0.0], [0], [0]

    def leave(kept: int) -> None:
        for end in range(len(path), kept, -1):
            if n := passing.pop():
                start = end - back[end]
                passing[start] += n
                if (piece := path[start:end]) in pieces:
                    counts[piece] += n
        del state[kept + 1 :], best[kept + 1 :], back[kept + 1 :]

    for word, n in words:
        if len(word) > LONG:
            for piece in segments(word, trie):
                if piece in pieces:
                    counts[piece] += n
            continue
        marked = MARK + word
        kept = shared(path, marked)
        leave(kept)
        at = state[-1]
        for char in marked[kept:]:
            nxt = step.get((at, char))
            at = advance(at, char) if nxt is None else nxt
            top, length = -math.inf, 0
            for size, score in endings[at]:
                if (x := best[-size] + score) > top:
                    top, length = x, size
            if char not in pieces and (x := best[-1] + len(char.encode("utf-8", "surrogatepass")) * byte) > top:
                top, length = x, 1
            state.append(at)
            best.append(top)
            back.append(length)
            passing.append(0)
        passing[-1] += n
        path = marked
    leave(0)
    return counts


@dataclass(eq=False)
class Unigram:
    """Log-probabilities of pieces, in order of the vocabulary's ranks, and of a byte."""

    scores: list[float]

    @property
    def byte_score(self) -> float:
        return -math.log(256) + min(self.scores)


def vocabulary_of(path: str) -> list[str]:
    """The pieces of a vocabulary file, best rank first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [model.id_to_piece(i) for i in sorted(ids, key=lambda i: (-model.get_score(i), i))]


def _refit(counts: Counter[str], pieces: list[str]) -> Unigram:
    norm = math.log(sum(counts.values()) + len(pieces))
    return Unigram([math.log(counts[p] + 1) - norm for p in pieces])


def fit(texts: list[str], pieces: list[str], rounds: int = ROUNDS) -> Unigram:
    """Probabilities of ``pieces`` from texts at hand; ``fitted`` does the same with a table."""
    words = sorted(Counter(w for text in texts for w in text.split()).items())
    model = Unigram(zipf(len(pieces)))
    for _ in range(rounds):
        model = _refit(tally(words, Trie(dict(zip(pieces, model.scores)), model.byte_score)), pieces)
    return model


def pretokens(docs: DataFrame) -> DataFrame:
    """(word, n): every pre-token of the texts with its number of occurrences, sorted within partitions."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            words, n = pa.chunked_array(held, pa.string()).value_counts().flatten()
            real = pc.not_equal(words, "")  # what stands before a leading or after a trailing blank
            found = pa.RecordBatch.from_arrays([words.filter(real), n.filter(real)], ["word", "n"])
            for at in range(0, len(found), HANDED):
                yield found.slice(at, HANDED)

        for batch in batches:
            held.append(pc.utf8_split_whitespace(batch.column(0).cast(pa.string())).flatten())
            size += held[-1].nbytes
            if size > COUNTED_BYTES:
                yield from counted()
                held, size = [], 0
        yield from counted()

    found = spread(docs.select("text").mapInArrow(count, "word string, n long"), "word")
    return found.groupBy("word").agg(F.sum("n").alias("n")).sortWithinPartitions("word")


def fitted(docs: DataFrame, model_path: str, rounds: int = ROUNDS) -> Unigram:
    """Probabilities of the vocabulary's pieces from all texts."""
    spark, pieces = docs.sparkSession, vocabulary_of(model_path)
    words, model = stored(pretokens(docs)), Unigram(zipf(len(pieces)))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            trie = for_stage(_trie, model_path, shared.value)
            pairs = (pair for b in batches for pair in zip(strings(b.column(0)), b.column(1).to_numpy().tolist()))
            counts = tally(pairs, trie)
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], ["piece", "n"])

        found = words.mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n"))
        model = _refit(Counter({piece: n for piece, n in found.collect()}), pieces)  # a row a piece at most
    return model


def sample(docs: DataFrame, sampled: int = SAMPLED, window: int = WINDOW) -> list[str]:
    """About ``sampled`` different windows of the texts, by a hash of id and text; four times as many at most, by a hash of
    their own, so that the sample is the same in every run. For trials of ``fit`` only: ``token_counts`` reads all texts."""
    n = max(1, docs.count())
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches, "doc_id", "text"):
            out = []
            for doc, text in zip(ids, texts):
                words = (text or "").split()
                at = xxhash.xxh32_intdigest(str(doc)) % max(1, len(words) - window + 1)
                out.append(" ".join(w[:LONG] for w in words[at : at + window]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["words"])

    few = docs.where(chance * n < sampled).select("doc_id", "text").mapInArrow(cut, "words string").distinct()
    return sorted(r[0] for r in few.orderBy(F.xxhash64("words"), "words").limit(4 * sampled).collect())


def _trie(path: str, model: Unigram) -> Trie:
    return Trie(dict(zip(vocabulary_of(path), model.scores)), model.byte_score)


def token_counts(docs: DataFrame, model_path: str, model: Unigram | None = None) -> DataFrame:
    """``SCHEMA`` of every document; a model is fitted on all documents if none is given."""
    spark = docs.sparkSession
    tune(spark)
    own = docs.select(F.col("doc_id").cast("long"), "text")
    shared = spark.sparkContext.broadcast(model or fitted(own, model_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = for_stage(_trie, model_path, shared.value)
        for ids, texts in rows_of(batches, "doc_id", "text"):
            found = list(trie.measure([t or "" for t in texts]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([x[0] for x in found], pa.int64()),
                    pa.array([x[1] for x in found], pa.int64()),
                    pa.array([x[2] for x in found], pa.float64()),
                ],
                ["doc_id", "n_pretokens", "n_tokens", "forward_logprob"],
            )

    return own.mapInArrow(count, SCHEMA)
