"""Operator 8: personal data, with offset-preserving deobfuscation.

``base`` finds the four kinds in the text as it stands. ``extra`` passes the text through a chain of transducers, each
of which gives its output with the source offset of every character: invisible characters go, look-alike characters
become ASCII, spelled digits become digits, and disguises of ``@`` and ``.`` become those. The same detectors run on
the result; spans are mapped back to code points of the source. A span that the base has, or that lies inside a base
span of its kind, is left out; all base spans stay.

One pass, no shuffle. The detectors are linear in the text: those whose pattern could rescan a long run start at
anchors (an ``@``, the first digit of a run) instead.

Defined cases: a null text is empty; a null id is kept; repeated rows are treated one by one; very long texts are read
whole, in linear time; an empty table gives no rows. Extra columns are not read by the query; ``redact`` keeps them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import rows_of, tune

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile("[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches around each @: the local part is the run before it, no further back than the last match's end."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, (end := found.end())
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    values = [ord(c) - 48 for c in digits]
    return (sum(values[-1::-2]) + sum(d * 2 - 9 * (d > 4) for d in values[-2::-2])) % 10 == 0


def base(text: str) -> list[Span]:
    """Base spans in order of kind, then start."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if "." in text:
        out += [
            ("ip", m.start(), m.end())
            for m in _IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))
        ]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m[0])) <= 15]
    return out


# Characters that look like ASCII ones, in the order of the ASCII characters.
_LOOKALIKES = {
    "A": "ΑА", "B": "ΒВ", "C": "СϹ", "E": "ΕЕ", "H": "ΗН", "I": "ΙІ", "J": "Ј", "K": "ΚК", "M": "ΜМ", "N": "Ν",
    "O": "ΟО", "P": "ΡР", "S": "Ѕ", "T": "ΤТ", "X": "ΧХ", "Y": "ΥҮ", "Z": "Ζ", "a": "аα", "c": "сϲ", "d": "ԁ",
    "e": "е", "g": "ɡ", "h": "һ", "i": "іι", "j": "ј", "k": "κ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ",
    "s": "ѕ", "u": "υս", "v": "ν", "w": "ԝ", "x": "хχ", "y": "уү", ".": "․。｡", "-": "‐‑‒–—−", "@": "﹫",
}
# Characters without width.
_INVISIBLE = "­​‌‍⁠﻿"
# Digits as they are spelled.
_SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}

_FOLD = {ord(c): k for k, cs in _LOOKALIKES.items() for c in cs}
_FOLD |= {0xFF01 + i: chr(0x21 + i) for i in range(94)}  # full-width forms
_FOLD |= {0x3000: " ", 0xA0: " ", 0x202F: " ", 0x2007: " "}
_FOLD |= {z + i: str(i) for z in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for i in range(10)}
_FOLD |= {ord(c): None for c in _INVISIBLE}
_ODD = re.compile("[" + "".join(map(re.escape, map(chr, _FOLD))) + "]")

_DIGIT_WORD = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + ")"
_DOTS, _PLUS = ("dot", "punkt", "point", "punto"), ("+", "plus")
_TOKEN = re.compile(
    rf"(?<![^\W_])(?:{_DIGIT_WORD}|plus|{'|'.join(_DOTS)})(?![^\W_])|[0-9]++|\+|(?<=[^\W_])\.(?=[^\W_])", re.I
)


def _spells(low: str) -> bool:
    """Whether a spelled digit has a digit, dot or plus word next to it, on either side. Every run that ``spelled``
    rewrites has one, whatever stands between; words are what it takes for words."""
    words = low.encode().translate(_ASCII_WORDS).decode().split() if low.isascii() else _WORDS.findall(low)
    for i in [i for i, w in enumerate(words) if w in _SPELLED]:
        for w in words[max(0, i - 1) : i] + words[i + 1 : i + 2]:
            if w in _BESIDE or w[0] in _ASCII_DIGITS or w[-1] in _ASCII_DIGITS:
                return True
    return False


_BESIDE = frozenset((*_SPELLED, *_DOTS, "plus"))
_ASCII_DIGITS = frozenset("0123456789")
_ASCII_WORDS = bytes(b if chr(b).isalnum() and b < 128 else 32 for b in range(256))
_WORDS = re.compile(r"[^\W_]+")
_SIGN = r" *+(at|dot|ät|arroba|punkt|punto|point|@|\.) *+"
_BRACKETED = re.compile(rf"(?<! ) *+(?:\[{_SIGN}\]|\({_SIGN}\)|\{{{_SIGN}\}}|<{_SIGN}>) *+", re.I)
_ENTITY = re.compile(r"&#0*64;|&#x0*40;|&commat;|%40|(&#0*46;|&#x0*2e;|&period;)", re.I)
_NAME = r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]++)"
#: Bare words count only where the whole shape is there: name at host dot suffix.
_BARE = re.compile(rf"{_NAME}( ++at ++)([A-Za-z0-9-]++)((?: ++dot ++[A-Za-z0-9-]++)+)", re.I)
#: ... or where the name looks like a mailbox and the host ends as hosts do.
_BARE_AT = re.compile(
    r"(?<![A-Za-z0-9._%+-])(?=[0-9._%+-]*+[A-Za-z])(?=[A-Za-z%+-]*+[0-9._])([A-Za-z0-9._%+-]*[A-Za-z0-9]) ++at ++"
    r"(?=(?:[A-Za-z0-9-]++\.)+(?:com|org|net|edu|gov|io|de|fr|es|uk|info|biz)(?![A-Za-z0-9-]))",
    re.I,
)
_HOST_AFTER_AT = re.compile(r" [aA][tT] ++[A-Za-z0-9-]++\.[A-Za-z]")
_HOST_DOTS = re.compile(r"@[A-Za-z0-9.-]++((?: ++dot ++[A-Za-z0-9-]++)+)", re.I)
_DOT_WORD = re.compile(r" ++dot ++", re.I)
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])(?: @ ?| ?@ )(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])")


class Tape:
    """A text with, for each character, where its source begins and ends."""

    def __init__(self, text: str):
        self.text = text
        self.begin: list[int] | None = None
        self.end: list[int] = []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace each [a, b) by its string; edits come in order and don't overlap. New characters stand for the
        whole piece that they replace."""
        if not edits:
            return
        if self.begin is None:
            self.begin, self.end = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        text, begin, end, at = [], [], [], 0
        for a, b, new in edits:
            text += (self.text[at:a], new)
            begin += self.begin[at:a] + [self.begin[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        self.text, self.begin, self.end = "".join(text), begin + self.begin[at:], end + self.end[at:]


def fold(tape: Tape) -> None:
    """Look-alikes to ASCII; characters without width go."""
    tape.rewrite([(m.start(), m.end(), _FOLD[ord(m[0])] or "") for m in _ODD.finditer(tape.text)])


def spelled(tape: Tape) -> None:
    """Runs of digit words to digits. A run is at least three digits, one of them spelled, with a blank, comma or
    hyphen or two between; "plus" may lead it, dot words and dots may stand inside."""
    edits, text = [], tape.text
    run: list[re.Match] = []

    def new(word: str) -> str:
        return _SPELLED.get(word) or ("+" if word in _PLUS else word if word[0].isdigit() else ".")

    def close() -> None:
        while run and new(run[-1][0].lower()) in "+.":
            run.pop()
        while run and new(run[0][0].lower()) == ".":
            run.pop(0)
        if len(run) >= 3 and any(m[0].lower() in _SPELLED for m in run):
            edits.append((run[0].start(), run[-1].end(), "".join(new(m[0].lower()) for m in run)))
        run.clear()

    for m in _TOKEN.finditer(text):
        if run:
            between = text[run[-1].end() : m.start()]
            if len(between) > 2 or between.strip(" ,-") or m[0].lower() in _PLUS:
                close()
        run.append(m)
    close()
    tape.rewrite(edits)


def undisguise(tape: Tape) -> None:
    """Bracketed signs and entities, then bare at and dot words."""

    def sign(m: re.Match) -> str:
        word = next(g for g in m.groups() if g).lower()
        return "@" if word in ("at", "ät", "arroba", "@") else "."

    if any(c in tape.text for c in "[({<"):
        tape.rewrite([(m.start(), m.end(), sign(m)) for m in _BRACKETED.finditer(tape.text)])
    if "&" in tape.text or "%" in tape.text:
        tape.rewrite([(m.start(), m.end(), "." if m[1] else "@") for m in _ENTITY.finditer(tape.text)])
    low = tape.text.lower()
    if " at " in low:
        edits = []
        if " dot " in low:
            for m in _BARE.finditer(tape.text):
                edits.append((m.start(2), m.end(2), "@"))
                edits += [(d.start(), d.end(), ".") for d in _DOT_WORD.finditer(tape.text, m.start(4), m.end(4))]
            tape.rewrite(edits)
        if _HOST_AFTER_AT.search(tape.text):
            tape.rewrite([(m.end(1), m.end(), "@") for m in _BARE_AT.finditer(tape.text)])
    if "@" in tape.text:
        tape.rewrite([(m.start(), m.end(), "@") for m in _SPACED_AT.finditer(tape.text)])
        if " dot " in low:
            edits = []
            for m in _HOST_DOTS.finditer(tape.text):
                edits += [(d.start(), d.end(), ".") for d in _DOT_WORD.finditer(tape.text, m.start(1), m.end(1))]
            tape.rewrite(edits)


def extra(text: str, known: list[Span]) -> list[Span]:
    """Spans that only the deobfuscated text shows, in source offsets."""
    tape = Tape(text)
    if not text.isascii() and _ODD.search(text):
        fold(tape)
    if _spells(tape.text.lower()):
        spelled(tape)
    undisguise(tape)
    if tape.begin is None:
        return []
    out = []
    for kind, a, b in base(tape.text):
        span = (kind, tape.begin[a], tape.end[b - 1])
        if not any(k == kind and s <= span[1] and span[2] <= e for k, s, e in known):
            out.append(span)
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(docs: DataFrame) -> DataFrame:
    """``SCHEMA`` of every document; the counts are those of base spans."""
    tune(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches, "doc_id", "text"):
            columns: list[list] = [ids, [], [], [], [], [], []]
            for text in texts:
                known = base(text or "")
                kinds = [k for k, _, _ in known]
                for i, k in enumerate(KINDS, 1):
                    columns[i].append(kinds.count(k))
                columns[5].append(hashlib.sha256(joined(known).encode()).hexdigest())
                columns[6].append(joined(known + extra(text or "", known)))
            types = [pa.int64()] * 5 + [pa.string()] * 2
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, SCHEMA)


def redacted(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    known = base(text)
    merged: list[list] = []
    for kind, a, b in sorted(known + extra(text, known), key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    out, at = [], 0
    for kind, a, b in merged:
        out += (text[at:a], f"[{kind.upper()}]")
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with its text redacted, all other columns and nulls as they are."""
    tune(docs.sparkSession)

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            texts = [None if t is None else redacted(t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(change, docs.schema)
