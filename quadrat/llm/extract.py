"""Operator 2: main text of pages, by page structure and nearest-URL page differencing.

1. Each page is parsed into blocks of text with their place: inside the article or not, inside furniture (menus, headers,
   footers, sidebars, notices, adverts, forms, comments, by element, role or whole class name) or not.
2. Pages are put in order of host, URL path, id, URL and text. A page is a copy of another if they share half the
   characters of its ``article`` or ``main`` element, or 80 % of the page's where it has none. A run is a row of pages of
   one host of which each is a copy of the one before or the other way round.
3. The neighbours of a page are the last page before its run and the first one after it, on its host. It is compared with
   the one of nearer path (longer common prefix; the one before if equal) that it isn't a copy of. Their lines are aligned
   by longest common subsequence, and shared lines are deleted, inside articles as well. Without such a neighbour nothing
   is deleted. Where an ``article`` or ``main`` exists, lines outside are dropped.

Runs may be of any length and cross partitions: a first pass over range partitions, with lines as 64-bit hashes, finds
where they begin and which page follows each. Of every partition four pages at most reach the driver (its first and last,
and the first and last beyond the runs at its borders), which says what stands before and after the runs at each border. A
second pass shuffles the text once by the same splitters, and each run begins with what the first pass found. Both hold
one page at a time; the result depends on neither partitions nor batches. Splitters take the id in, so a host or URL with a
third of all pages is spread over many partitions; repeated rows are merged before they are shuffled. The longest common
subsequence is bit-parallel: exact, a machine word of lines at a time; two pages of n common lines take n bits times twice
the root of n. Very long pages are aligned whole.

Defined cases: null html gives an empty text; a null URL counts as the empty one; a null id is kept and comes first;
repeated rows are copies and each keeps its text; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import html as entities
import json
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import rows_of, stored, tune

# Elements by what they do to text.
RAW = frozenset("script style noscript textarea title noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: (A ``header`` inside the article is its headline and stays.)
FURNITURE = frozenset("nav header footer aside form menu dialog button select label fieldset head figure-menu".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li legend main menu nav ol option p pre section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html head title option tbody td tfoot th thead tr caption".split())
#: Elements that hold text rather than other blocks.
TEXT = frozenset(
    "a abbr b blockquote br caption cite code dd dt em figcaption h1 h2 h3 h4 h5 h6 i li mark p pre q s small span strong sub "
    "sup td th time u".split()
)
# Class names and ids of furniture, of any element and of containers only, and names of the place or shape of
# a box that stand before or behind them. A name counts as a whole, so that a "share-price" is no sharing bar.
_ANYWHERE = (
    "ad ads advert adverts advertisement breadcrumb breadcrumbs commentlist cookie cookies consent gdpr login masthead newsletter "
    "pagination paywall popup promo sidebar signup sponsor sponsored subscribe"
).split()
_BOXES = "banner comments dialog footer hidden menu modal nav navbar navigation notice notices toolbar widget widgets".split()
_BEFORE = "bottom global left main page primary right secondary site top".split()
_BEHIND = "area banner bar block bottom box container form inner left links list message notice section slot top unit wrap wrapper".split()
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())


def _names(words: list[str]) -> frozenset[str]:
    pairs = [(a, b) for a in _BEFORE for b in words] + [(a, b) for a in words for b in _BEHIND]
    return frozenset([*words, *(a + mark + b for a, b in pairs for mark in ("-", "_", ""))])


_IN_TEXT, _IN_ARTICLE, _OUTSIDE = _names(_ANYWHERE), _names(_ANYWHERE + _BOXES), _names([*_ANYWHERE, *_BOXES, "header"])
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_QUOTE = re.compile("[\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]++)))?")
_SPACE = re.compile(r"\s+")

#: A block: 2 inside the article, 1 elsewhere; furniture is not kept at all.
Block = tuple[int, str]


def _marks(name: str, attributes: str, article: bool) -> bool:
    """Whether an element is furniture, inside an article or not."""
    if name in FURNITURE:
        return not (name == "header" and article)
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    names = _IN_TEXT if name in TEXT else _IN_ARTICLE if article else _OUTSIDE
    for m in _ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        if key not in ("class", "id", "role", "hidden", "aria-hidden"):
            continue
        value = m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "role" and not ROLES.isdisjoint(value.lower().split()):
            return True
        if key in ("class", "id") and not names.isdisjoint(value.lower().split()):
            return True
    return False


@lru_cache(maxsize=64)
def _close(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>?", re.I)


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(begin, end, closing, name, attributes) of each tag; comments and declarations have no name. A > inside a closed
    quotation doesn't end a tag. Linear in the page: no part is looked at again."""
    at = page.find("<")
    while at >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, False, "", ""
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            end = len(page) if end < 0 else end + 1
            yield at, end, False, "", ""
        elif m := _NAME.match(page, at):
            end, inside = page.find(">", m.end()), m.end()
            if end < 0:
                return
            while q := _QUOTE.search(page, inside, end):
                close = page.find(q[0], q.end())
                if close < 0:
                    break
                inside = close + 1
                if close > end:
                    later = page.find(">", inside)
                    if later < 0:
                        break
                    end = later
            yield at, end + 1, bool(m[1]), m[2].lower(), page[m.end() : end]
            end += 1
        else:
            end = at + 1
        at = page.find("<", end)


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page outside furniture."""
    out: list[Block] = []
    if not page:
        return out
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, furniture here or above, article here or above
    opened: Counter[str] = Counter()  # of the stack, so that what isn't open isn't looked for
    furniture = article = False

    def flush() -> None:
        if parts:
            if not furniture:
                text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
                if text:
                    out.append((2 if article else 1, text))
            parts.clear()

    def pop(n: int) -> None:
        nonlocal furniture, article
        flush()
        for x in stack[n:]:
            opened[x[0]] -= 1
        del stack[n:]
        furniture, article = stack[-1][1:] if stack else (False, False)

    def nearest(names: frozenset, stop: frozenset) -> int:
        """The place of the innermost open element among names, not looking past stop; -1 if there is none."""
        if not any(opened[x] for x in names):
            return -1
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in stop:
                return -1
        return -1

    at, end = 0, len(page)
    for begin, stop, closing, name, attributes in tags(page):
        if begin < at:  # inside an element whose content isn't markup
            continue
        if begin > at:
            parts.append(page[at:begin])
        at = stop
        if not name:
            continue
        if closing:
            if name in BLOCK or name in FURNITURE:
                flush()
                n = nearest(frozenset((name,)), _SCOPES.get(name, _TOP))
                if n >= 0:
                    pop(n)
            elif name == "br":
                parts.append(" ")
            else:
                n = nearest(frozenset((name,)), BLOCK)
                if n >= 0 and stack[n][1:] != (stack[n - 1][1:] if n else (False, False)):
                    pop(n)
                elif n >= 0:
                    opened[name] -= 1
                    del stack[n]
            continue
        if name in RAW:
            if not attributes.rstrip().endswith("/"):
                close = _close(name).search(page, at)
                at = close.end() if close else end
            if name == "title":
                flush()
            elif name == "textarea":
                parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                parts.append(" ")
            continue
        if name in CLOSES_P:
            n = nearest(_P, _SCOPED)
            if n >= 0:
                pop(n)
        if name in _SIBLINGS:
            n = nearest(_SIBLINGS[name], _LISTS)
            if n >= 0:
                pop(n)
        if name in BLOCK:
            flush()
        bad = not furniture and _marks(name, attributes, article)
        if bad and name not in BLOCK:
            flush()
        opened[name] += 1
        stack.append((name, furniture or bad, article or name in ("article", "main") and not furniture))
        furniture, article = stack[-1][1:]
    if at < end:
        parts.append(page[at:])
    flush()
    return out


_P = frozenset(("p",))
_TOP = frozenset(("html",))
_SCOPED = frozenset("article aside blockquote body div footer header html li main nav section table td th button".split())
_LISTS = frozenset("ul ol dl table tbody thead tfoot select menu".split())
_SCOPES = {"p": _SCOPED, "li": _LISTS, "tr": frozenset(("table",)), "td": frozenset(("table", "tr")), "th": frozenset(("table", "tr"))}
_SIBLINGS = {
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)),
    "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",)),
}


def shared_lines(a: list, b: list) -> list[bool]:
    """For each line of ``a``, whether it is in the longest common subsequence with ``b`` (one fixed choice among
    equals). Bit-parallel: bit j of a row says whether the subsequence grows at line j of b."""
    n, m = len(a), len(b)
    out = [False] * n
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        out[head] = True
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        out[n - 1 - tail] = True
        tail += 1
    a_mid, b_mid = a[head : n - tail], b[head : m - tail]
    wanted = set(a_mid) & set(b_mid)
    if not wanted:
        return out
    rows = [i for i, x in enumerate(a_mid) if x in wanted]
    cols = [x for x in b_mid if x in wanted]
    places: dict = {}
    for j, x in enumerate(cols):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(cols)) - 1

    def after(v: int, i: int) -> int:
        u = v & places[a_mid[i]]
        return ((v + u) | (v - u)) & full

    def rank(bits: int, j: int) -> int:
        """Length of the subsequence with the first j columns: zeros among them."""
        return j - (bits & ((1 << j) - 1)).bit_count()

    step = max(1, math.isqrt(len(rows)))  # only every step-th row is kept; those between are computed again on the way back
    kept, v = [], full
    for n_, i in enumerate(rows):
        if n_ % step == 0:
            kept.append(v)
        v = after(v, i)
    j = len(cols)
    for at in range(len(kept) - 1, -1, -1):
        part = rows[at * step : (at + 1) * step]
        history = [kept[at]]
        for i in part:
            history.append(after(history[-1], i))
        for r in range(len(part) - 1, -1, -1):
            have = rank(history[r + 1], j)
            if have == 0:
                return out
            if rank(history[r], j) == have:
                continue
            while j and rank(history[r + 1], j - 1) == have:
                j -= 1
            out[head + part[r]] = True
            j -= 1
    return out


#: The share of a page's characters (of its article's, where it has one) from which lines shared with another page
#: make it a copy of that page rather than show a template.
COPY_PAGE, COPY_ARTICLE = 0.8, 0.5
#: A page as its blocks' places, the hashes of their texts, and their lengths.
Outline = tuple[list[int], list[int], list[int]]
_PACKED = np.dtype([("place", "u1"), ("hash", "<i8"), ("length", "<i4")])


def outline(page: list[Block]) -> Outline:
    hashes = [xxhash.xxh64_intdigest(text) - (1 << 63) for _, text in page]
    return [place for place, _ in page], hashes, [len(text) for _, text in page]


def _packed(page: Outline) -> bytes:
    out = np.empty(len(page[0]), _PACKED)
    out["place"], out["hash"], out["length"] = page
    return out.tobytes()


def _unpacked(data: bytes) -> Outline:
    out = np.frombuffer(data, _PACKED)
    return out["place"].tolist(), out["hash"].tolist(), out["length"].tolist()


def _own(places: list[int]) -> tuple[bool, list[bool]]:
    """Whether the page has an article, and which blocks count: those inside it, else all."""
    within = 2 in places
    return within, [place == 2 or not within for place in places]


def copied(own: Outline, mate: Outline) -> bool:
    """Whether a page's text is a copy of another page's."""
    within, counts = _own(own[0])
    whole = sum(n for n, c in zip(own[2], counts) if c)
    both = sum(n for n, c, s in zip(own[2], counts, shared_lines(own[1], mate[1])) if c and s)
    return whole > 0 and both >= (COPY_ARTICLE if within else COPY_PAGE) * whole


def alike(a: Outline, b: Outline) -> bool:
    """Whether two pages that stand next to each other belong to one run."""
    return a == b or copied(a, b) or copied(b, a)


def main_text(own: list[Block], mate: Outline | None) -> str:
    """The text of a page given a neighbour that it isn't a copy of."""
    shape = outline(own)
    shared = shared_lines(shape[1], mate[1]) if mate else [False] * len(own)
    return "\n".join(t for (_, t), counts, both in zip(own, _own(shape[0])[1], shared) if counts and not both)


_URL = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)([^?#]*)")


def place_of(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL: lower-case host without a leading www, path without query and fragment."""
    m = _URL.match(url or "")
    if not m:
        return "", (url or "").split("#")[0].split("?")[0]
    host = m[1].lower()
    return (host[4:] if host.startswith("www.") else host), m[2]


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


#: A neighbour: its path and its outline.
Mate = tuple[str, Outline]


def chosen(path: str, own: Outline, before: Mate | None, after: Mate | None) -> Outline | None:
    """The neighbour that a page is compared with."""
    found = [x for x in (before, after) if x and x[1] != own and not copied(own, x[1])]
    return max(found, key=lambda x: _common(x[0], path))[1] if found else None


_NULL_ID = -(1 << 62)
_KEY = ["host", "path", "page_id", "url"]
_ORDER = "part long, host string, path string, page_id long, url string, tie long"
_OUTLINES = f"{_ORDER}, lines binary"
#: Rows of the first pass: a run's first page with the page after the run (1; 2 if the part ends with the run), and of each
#: part its first page, the first of its second run, the last before its last run, and its last page.
RUN, OPEN, FIRST, SECOND, LAST_BUT_RUN, LAST = range(1, 7)
_FOUND = f"{_ORDER}, kind int, mate_path string, mate binary"
_TEXTS = f"{_ORDER}, kind int, id long, link string, times int, lines string"
SCHEMA = "page_id long, url string, text string, n_chars long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[Counter]:
    """Rows (page_id, url, html) of each batch with how often they are in it."""
    for columns in rows_of(batches, "page_id", "url", "html"):
        yield Counter(zip(*columns))


def _sorted_key(page_id: int | None, url: str | None) -> tuple[str, str, int, str]:
    return (*place_of(url), _NULL_ID if page_id is None else page_id, url or "")


def _splitters(pages: DataFrame, parts: int) -> list[tuple]:
    """The least key of each range partition but the first."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls in rows_of(batches, "page_id", "url"):
            yield _batch([_sorted_key(i, u) for i, u in zip(ids, urls)], "host string, path string, page_id long, url string")

    light = pages.select("page_id", "url").mapInArrow(keyed, "host string, path string, page_id long, url string")
    ranged = light.repartitionByRange(parts, *_KEY).select(F.spark_partition_id().alias("part"), F.struct(*_KEY).alias("key"))
    return sorted(tuple(r[0]) for r in ranged.groupBy("part").agg(F.min("key").alias("low")).select("low").collect())[1:]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first pass over sorted outlines: where runs begin, and the pages around the borders."""
    key = last = first = None  # of the run; the page before; the first page of the part
    second = before = None
    many = False

    def closed() -> list[tuple]:
        own = key[0]
        rows = [(*key, OPEN, None, None), (*first[:6], FIRST, first[2], first[6]), (*last[:6], LAST, last[2], last[6])]
        if many:
            for kind, page in ((SECOND, second), (LAST_BUT_RUN, before)):
                rows.append((*page[:6], kind, page[2], page[6]) if page else (own, "", "", 0, "", 0, kind, None, None))
        return rows

    shape: Outline = ([], [], [])
    for columns in rows_of(batches, *(c.split()[0] for c in _OUTLINES.split(", "))):
        out = []
        for page in zip(*columns):
            own = _unpacked(page[6])
            if last and page[0] != last[0]:
                out += closed()
                last = None
            if not last:
                key, first, second, before, many = page[:6], page, None, None, False
            elif page[1] != last[1] or not alike(own, shape):
                same = page[1] == last[1]
                out.append((*key, RUN, page[2] if same else None, page[6] if same else None))
                if not many:
                    second = page if same else None
                before = last if same else None
                key, many = page[:6], True
            last, shape = page, own
        yield _batch(out, _FOUND)
    yield _batch(closed() if last else [], _FOUND)


def _carried(edges: list) -> dict[int, tuple[Mate | None, Mate | None]]:
    """For each part, the page before the run that it begins with and the page after the one that it ends with."""
    parts: dict[int, dict[int, tuple | None]] = {}
    for r in edges:
        page = (r["host"], r["path"], _unpacked(r["mate"])) if r["mate"] is not None else None
        parts.setdefault(r["part"], {})[r["kind"]] = page

    def mate(page: tuple | None) -> Mate | None:
        return page[1:] if page else None

    def scan(order: list[int], far: int, near: int, beyond: int) -> dict[int, Mate | None]:
        """``near``: this part's page at the border, ``far``: the other part's, ``beyond``: the one behind its run."""
        found: dict[int, Mate | None] = {}
        for i, part in enumerate(order):
            own, other = parts[part], parts[order[i - 1]] if i else None
            if not other or other[far][0] != own[near][0]:
                found[part] = None
            elif not alike(own[near][2], other[far][2]):
                found[part] = mate(other[far])
            else:
                found[part] = mate(other[beyond]) if beyond in other else found[order[i - 1]]
        return found

    order = sorted(parts)
    before, after = scan(order, LAST, FIRST, LAST_BUT_RUN), scan(order[::-1], FIRST, LAST, SECOND)
    return {part: (before[part], after[part]) for part in order}


def extract(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """``SCHEMA`` of every page (page_id, url, html)."""
    spark = pages.sparkSession
    tune(spark)
    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    splitters = _splitters(rows, 4 * n)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in _merged(batches):
            out = []
            for (page_id, url, text), times in batch.items():
                own = blocks(text)
                key = _sorted_key(page_id, url)
                lines = _packed(outline(own))
                tie = xxhash.xxh64_intdigest(lines) - (1 << 63)
                out.append((bisect_right(splitters, key), *key, tie, lines, page_id, url, times, own))
            yield out

    def outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in parsed(batches):
            yield _batch([r[:7] for r in out], _OUTLINES)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in parsed(batches):
            yield _batch([(*r[:6], LAST + 1, *r[7:10], json.dumps(r[10], ensure_ascii=False)) for r in out], _TEXTS)

    def in_order(df: DataFrame, *then: str) -> DataFrame:
        keys = ["part", *_KEY, "tie", *then]
        return df.repartition(n, "part").sortWithinPartitions(*keys)

    found = stored(in_order(rows.mapInArrow(outlines, _OUTLINES)).mapInArrow(_runs, _FOUND))
    carried = spark.sparkContext.broadcast(_carried(found.where(F.col("kind") >= FIRST).collect()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = before = after = last = None
        names = [c.split()[0] for c in _TEXTS.split(", ")]
        for columns in rows_of(batches, *names, "mate_path", "mate"):
            out = []
            for row in zip(*columns):
                here, host, path, kind = row[0], row[1], row[2], row[6]
                if kind <= OPEN:
                    if here != part:
                        before, part = carried.value[here][0], here
                    else:
                        before = last[1:] if last[0] == host else None
                    after = carried.value[here][1] if kind == OPEN else (row[11], _unpacked(row[12])) if row[12] is not None else None
                    continue
                page_id, url, times, own = row[7], row[8], row[9], [tuple(x) for x in json.loads(row[10])]
                shape = outline(own)
                text = main_text(own, chosen(path, shape, before, after))
                out += [(page_id, url, text, len(text))] * times
                last = (host, path, shape)
            yield _batch(out, SCHEMA)

    # a part's first run may have begun in the part before: then its row here has what comes after it
    nothing = [F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in _TEXTS.split(", ")[7:])]
    begun = found.where(F.col("kind") <= OPEN).select(*(c.split()[0] for c in _TEXTS.split(", ")[:7]), *nothing, "mate_path", "mate")
    whole = rows.mapInArrow(texts, _TEXTS).select("*", F.lit(None).cast("string").alias("mate_path"), F.lit(None).cast("binary").alias("mate"))
    return in_order(whole.unionByName(begun), "kind").mapInArrow(compare, SCHEMA)
