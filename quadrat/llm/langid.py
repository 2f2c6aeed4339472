"""Operator 6: language identification of words in code-switched text by a linear-chain conditional random field.

Features of a word: itself (lexicon), affixes, character n-grams, hashed to ``BUCKETS`` weights per language. Transition
weights between the languages of neighbouring words are learned with them, by gradient ascent on the likelihood that
forward-backward gives. Training sequences are windows of labelled documents; some are joined in pairs of different
languages, which teaches the cost of a switch.

Prediction labels every word of a text by its marginals; the document's language has the largest share of them, and
that share is the score. Lots of texts of like length run forward-backward together, so that a step is one array
operation.

The model is fitted on a bounded sample: about ``PER_LANGUAGE`` windows of ``WINDOW`` words of each language, taken by
a hash of the id among the rows that may be learned from. Language, source and id are never inputs of a prediction.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without labelled rows every text is;
a null id is in no fold's sample but is predicted; repeated rows are treated one by one; very long texts are read whole;
of languages that tie, the first by name is predicted; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quadrat.llm.common import for_stage, lots, tune

#: Labelled windows that the model is fitted on, for each language.
PER_LANGUAGE = 400
WINDOW = 40
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
ROUNDS = 40
UND = "und"
#: Words whose scores a worker remembers while the stage runs.
REMEMBERED = 100_000
#: Language labels up to which their counts are broadcast.
MANY_LANGUAGES = 100_000
#: Words times languages that forward-backward holds at once.
AREA = 1 << 19
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text; characters that count as word characters but aren't letters don't make one."""
    if not text:
        return []
    words = _WORD.findall(text.lower())
    return words if text.isascii() else [w for w in words if any(map(str.isalpha, w))]


_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(1_000_003, i, 1 << 64) for i in range(256)], np.uint64)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of words, all words at once: (place of each word's first feature, features).

    Of ``<word>``: the whole (lexicon) and all runs of 2, 3 and 4 characters; those at its ends are the affixes.
    """
    data = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    data = data.astype(np.uint64) + np.uint64(1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    inside = np.arange(len(data)) - np.repeat(starts, sizes)
    whole = np.add.reduceat(data * _POWERS[inside & 255], starts) * _MIX
    kinds, owner = [whole], [np.arange(len(words))]
    of = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(data))  # characters from here to the word's end
    run = data
    for n in (2, 3, 4):
        run = run[:-1] * np.uint64(1_000_003) + data[n - 1 :]
        fits = left[: len(run)] >= n
        kinds.append((run[fits] + np.uint64(n)) * _MIX)
        owner.append(of[: len(run)][fits])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    buckets = (np.concatenate(kinds) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)[order]
    return np.searchsorted(owner[order], np.arange(len(words))), buckets


def _padded(sequences: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequences x width, lengths)."""
    out = np.zeros((len(sequences), width), np.int64)
    for i, s in enumerate(sequences):
        out[i, : len(s)] = s
    return out, np.array([len(s) for s in sequences])


def forward_backward(
    scores: np.ndarray, lengths: np.ndarray, move: np.ndarray, moves: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (B, T, L), 0 beyond a sequence's end, and, if asked for, expected transitions (L, L).

    ``scores``: (B, T, L) emission scores of sequences whose ``lengths`` don't rise; ``move``: transition scores.
    """
    b, t, k = scores.shape
    emit = np.exp(scores - scores.max(axis=2, keepdims=True))
    step = np.exp(move - move.max()).astype(emit.dtype)
    here = np.searchsorted(-lengths, -np.arange(t), side="left")  # sequences longer than i
    alpha = np.zeros_like(emit)
    now = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
    alpha[:, 0] = now
    for i in range(1, t):
        n = here[i]
        now = (now[:n] @ step) * emit[:n, i]
        now /= now.sum(axis=1, keepdims=True)
        alpha[:n, i] = now
    beta = np.ones((b, k), emit.dtype)
    moved = np.zeros((k, k))
    for i in range(t - 1, 0, -1):
        n = here[i]
        into = emit[:n, i] * beta[:n]
        if moves:
            joint = alpha[:n, i - 1, :, None] * step[None] * into[:, None, :]
            moved += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        alpha[:n, i] *= beta[:n]
        back = into @ step.T
        beta[:n] = back / back.sum(axis=1, keepdims=True)
    alpha[:, 0] *= beta
    total = alpha.sum(axis=2, keepdims=True)
    return np.divide(alpha, total, out=alpha, where=total > 0), moved


@dataclass(eq=False)
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS, L)
    move: np.ndarray  # (L, L)


def fit(rows: list[tuple[str, list[str]]], rounds: int = ROUNDS, seed: int = 7) -> Model | None:
    """A model of (language, words) sequences."""
    rows = [(lang, words) for lang, words in rows if words]
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    label = {lang: i for i, lang in enumerate(languages)}
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    sequences, targets = [], []
    order = rng.permutation(len(rows))
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in rows[i][1]]) for i in order]
    tags = [np.full(len(x), label[rows[i][0]]) for x, i in zip(ids, order)]
    for n in range(0, len(ids), 2):  # every other pair is joined to one sequence with a switch
        if n + 1 < len(ids) and n % 4 == 0:
            a, b = len(ids[n]) // 2 + 1, len(ids[n + 1]) // 2 + 1
            sequences.append(np.concatenate((ids[n][:a], ids[n + 1][:b])))
            targets.append(np.concatenate((tags[n][:a], tags[n + 1][:b])))
        else:
            sequences += ids[n : n + 2]
            targets += tags[n : n + 2]
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    sequences, targets = [sequences[i] for i in order], [targets[i] for i in order]
    width = len(sequences[0])
    x, lengths = _padded(sequences, width)
    y, _ = _padded(targets, width)
    mask = np.arange(width) < lengths[:, None]
    starts, bucket = features(list(vocabulary))
    word_of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(bucket))))
    k = len(languages)
    weights, move = np.zeros((BUCKETS, k)), np.zeros((k, k))
    observed = np.zeros((len(vocabulary), k))
    np.add.at(observed, (x[mask], y[mask]), 1.0)
    pairs = np.zeros((k, k))
    both = mask[:, 1:]
    np.add.at(pairs, (y[:, :-1][both], y[:, 1:][both]), 1.0)
    n = float(mask.sum())
    square_w, square_m = np.full_like(weights, 1e-8), np.full_like(move, 1e-8)

    def summed(where: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(where, values[:, j], size) for j in range(k)], axis=1)

    for _ in range(rounds):  # Adagrad on the whole sample
        emission = np.add.reduceat(weights[bucket], starts, axis=0)
        marginals, moved = forward_backward(emission[x], lengths, move)
        gradient = observed - summed(x[mask], marginals[mask], len(vocabulary))
        gradient = summed(bucket, gradient[word_of], BUCKETS) / n - 1e-7 * weights
        step = (pairs - moved) / n - 1e-5 * move
        square_w += gradient**2
        square_m += step**2
        weights += 0.3 * gradient / np.sqrt(square_w)
        move += 0.1 * step / np.sqrt(square_m)
    return Model(languages, weights.astype(np.float32), move.astype(np.float32))


class Tagger:
    """A model with a memory of words' emissions."""

    def __init__(self, model: Model):
        self.model = model
        self.place: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)), np.float32)

    def _places(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.place) > REMEMBERED:
            self.place, self.table = {}, self.table[:0]
        new = list(set().union(*texts).difference(self.place)) if texts else []
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            starts, buckets = features(new)
            found = np.add.reduceat(self.model.weights[buckets], starts, axis=0)
            if len(self.place) > len(self.table):
                room = np.zeros((max(2 * len(self.table), len(self.place)), found.shape[1]), np.float32)
                room[: len(self.table)] = self.table
                self.table = room
            self.table[len(self.place) - len(new) : len(self.place)] = found
        get = self.place.__getitem__
        return [np.fromiter(map(get, ws), np.int64, len(ws)) for ws in texts]

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """(words, L) of each text."""
        places = self._places(texts)
        out: list[np.ndarray] = [np.zeros((0, len(self.model.languages)))] * len(texts)
        order = sorted((i for i, p in enumerate(places) if len(p)), key=lambda i: -len(places[i]))
        at = 0
        while at < len(order):
            width = len(places[order[at]])
            lot = order[at : at + max(1, AREA // (width * len(self.model.languages)))]
            at += len(lot)
            x, lengths = _padded([places[i] for i in lot], width)
            found, _ = forward_backward(self.table[x], lengths, self.model.move, moves=False)
            for row, i in enumerate(lot):
                out[i] = found[row, : len(places[i])]
        return out

    def languages_of(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        for lot in lots([t or "" for t in texts], 512):
            for found in self.marginals([words_of(t) for t in lot]):
                if len(found):
                    share = found.sum(axis=0, dtype=np.float64) / len(found)
                    best = int(share.argmax())
                    yield self.model.languages[best], min(1.0, max(0.0, float(share[best])))
                else:
                    yield UND, 0.0


def sample(rows: DataFrame, per_language: int = PER_LANGUAGE, window: int = WINDOW) -> list[tuple[str, list[str]]]:
    """About ``per_language`` windows of each language of (doc_id, text, lang), by a hash of the id."""
    rows = rows.where("lang is not null and text is not null and doc_id is not null")
    counts = rows.groupBy("lang").count()
    if counts.count() <= MANY_LANGUAGES:  # else a plain join; texts must not be dealt by language, most may have one
        counts = F.broadcast(counts)
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    few = rows.join(counts, "lang").where(chance * F.col("count") < per_language).select("doc_id", "text", "lang")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, out = [], []
            for doc, text, lang in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = words_of(text)
                if words:
                    at = xxhash.xxh32_intdigest(str(doc)) % max(1, len(words) - window + 1)
                    out.append(" ".join(words[at : at + window]))
                    langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.string())], ["lang", "words"])

    found = few.mapInArrow(cut, "lang string, words string").collect()
    return sorted((r[0], r[1].split()) for r in found)


def train(rows: DataFrame) -> Model | None:
    tune(rows.sparkSession)
    return fit(sample(rows))


def predict(
    docs: DataFrame, model: Model | None, column: str = "text", into: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``docs`` with the language and its score in the columns ``into``; only ``column`` is looked at."""
    if model is None:
        return docs.withColumns({into[0]: F.lit(UND), into[1]: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = for_stage(Tagger, shared.value)
        for batch in batches:
            found = list(tagger.languages_of(batch.column(batch.schema.get_field_index(column)).to_pylist()))
            columns = [
                *batch.columns,
                pa.array([x[0] for x in found], pa.string()),
                pa.array([x[1] for x in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *into])

    schema = StructType([*docs.schema.fields]).add(into[0], "string").add(into[1], "double")
    return docs.mapInArrow(tag, schema)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a document is outside what may be learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document; learned from those that are not held out."""
    tune(docs.sparkSession)
    model = train(docs.where(~held_out()).select(F.col("doc_id").cast("long"), "text", "lang"))
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """``docs`` without those whose language can't be told."""
    model = train(docs.where(~held_out()).select(F.col("doc_id").cast("long"), "text", "lang"))
    tagged = predict(docs, model, "text", ("_lid_language", "_lid_score"))
    kept = tagged.where((F.col("_lid_language") != UND) & (F.col("_lid_score") >= min_score))
    return kept.select(*docs.columns)
