"""Whole operators 2 and 3 against slow versions: every pair of pages of a host, every alignment of a document with an item."""

import itertools
import math
import random
from collections import Counter, defaultdict

import pytest
import xxhash

from quadrat.llm import decontaminate, extract
from quadrat.llm.common import table

SF = "/root/testdata/sf0.001"


def slow_texts(rows):
    """Each page against the nearest page before and after its run of copies, on its host."""
    hosts = defaultdict(list)
    for page_id, url, html in rows:
        host, path = extract.place_of(url)
        own = extract.blocks(html)
        hosts[host].append((path, -(1 << 62) if page_id is None else page_id, url or "", extract.outline(own), page_id, url, own))
    out = []
    for pages in hosts.values():
        pages.sort(key=lambda p: (p[:3], xxhash.xxh64_intdigest(extract._packed(p[3]))))
        runs = [[pages[0]]]
        for a, b in zip(pages, pages[1:]):
            if extract.alike(a[3], b[3]):
                runs[-1].append(b)
            else:
                runs.append([b])
        for k, run in enumerate(runs):
            sides = [runs[k - 1][-1] if k else None, runs[k + 1][0] if k + 1 < len(runs) else None]
            for path, *_, shape, page_id, url, own in run:
                found = [p for p in sides if p and p[3] != shape and not extract.copied(shape, p[3])]
                near = [(len([*itertools.takewhile(lambda c: c[0] == c[1], zip(p[0], path))]), -i, p[3]) for i, p in enumerate(found)]
                text = extract.main_text(own, max(near, key=lambda x: x[:2])[2] if near else None)
                out.append((page_id, url, text, len(text)))
    return sorted(out, key=str)


def page(title, shared, own):
    lines = [f"<h1>{title}</h1>", *(f"<p>{x}</p>" for x in shared), *(f"<p>{x}</p>" for x in own)]
    return "<html><body><article>" + "".join(lines) + "</article></body></html>"


def made_pages():
    rng = random.Random(12)
    words = [f"word{i}" for i in range(400)]
    line = lambda: " ".join(rng.choice(words) for _ in range(12))
    templates = {h: [line(), line()] for h in "abc"}
    rows, last = [], None
    for i in range(150):
        host = rng.choice("aaaabc")  # one host has most of the pages
        url = f"http://{host}.example/{rng.choice('xy')}/{rng.randint(0, 40)}"
        if last and rng.random() < 0.25:  # a near copy next to its original
            url, html = last[0] + rng.choice(["", "b"]), last[1].replace("word1 ", "changed ")
        else:
            html = page(f"title {i}", templates[host], [line() for _ in range(rng.randint(3, 6))])
        last = (url, html)
        rows.append((i if i % 40 else None, url, html))
    return [*rows, (500, None, None), (501, "", ""), (502, "http://a.example/x/1", None)]


@pytest.mark.parametrize("source", ["made", "supplied"])
def test_extract_equals_slow_version(spark, source):
    if source == "made":
        rows = made_pages()
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    else:
        pages = table(spark, SF, "pages")
        rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    want = slow_texts(rows)
    for parts in (1, 4):
        assert sorted((tuple(r) for r in extract.extract(pages, parts).collect()), key=str) == want


@pytest.mark.parametrize("copies", [1, 3, 20, 100])
def test_runs_of_near_copies(spark, copies):
    """Pages in a row that are near copies of each other: each loses the line that a page after or before them shares."""
    rng = random.Random(copies)
    line = lambda: " ".join(f"word{rng.randint(0, 400)}" for _ in range(12))
    article, rules = [line() for _ in range(6)], "Read our rules"
    rows = [(i, f"http://a.example/p/{i:04}", page("a title", [], [*article, f"copy {i}", rules])) for i in range(copies)]
    rows.append((copies, f"http://a.example/p/{copies:04}", page("other", [], [line(), line(), rules])))
    rows += [(1000 + i, f"http://b.example/{i}", page("same", [], article)) for i in range(copies)]  # a host of one run only
    rows += rows[:2] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = slow_texts(rows)
    assert all(rules not in text for page_id, _, text, _ in want if page_id < 1000)
    for parts in (1, 4, 8):
        assert sorted((tuple(r) for r in extract.extract(pages, parts).collect()), key=str) == want


def test_very_long_page(spark):
    rng = random.Random(3)
    own = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(8)) for _ in range(20_000)]
    rows = [(1, "http://a/1", page("long", ["Read our rules"], own)), (2, "http://a/2", page("short", ["Read our rules"], [own[0], *("another line %d" % i for i in range(9)), "end"]))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in extract.extract(pages, 2).collect()}
    assert texts[1] == "\n".join(["long", *own[1:]]) and texts[2].endswith("end")


def slow_leaks(docs, items):
    """Items and documents that share a rare n-gram, aligned by words over the whole document."""
    vocabulary = {w for _, ws in items for w in ws}
    counts = Counter(w for _, ws in docs for w in ws)
    total = sum(counts.values()) + len(vocabulary) + 1
    seeds = []
    for _, ws in items:
        own = set()
        for at in range(len(ws)):
            for n in range(2, min(decontaminate.LONGEST_SEED, len(ws) - at) + 1):
                rate = math.prod((counts[w] + 1) / total for w in ws[at : at + n])
                if rate <= decontaminate.RARE or n == decontaminate.LONGEST_SEED:
                    own.add(tuple(ws[at : at + n]))
                    break
        seeds.append(own)
    out = []
    for doc, words in docs:
        grams = {tuple(words[i : i + n]) for n in range(2, decontaminate.LONGEST_SEED + 1) for i in range(len(words) - n + 1)}
        for (item, ws), own in zip(items, seeds):
            if grams.isdisjoint(own):
                continue
            best, row = 0, [0] * (len(words) + 1)
            for w in ws:
                above, row = row, [0]
                for j, x in enumerate(words):
                    row.append(max(0, above[j] + (2 if x == w else -1), above[j + 1] - 1, row[j] - 1))
                best = max(best, *row)
            if best / (2 * len(ws)) >= decontaminate.MIN_SCORE:
                out.append((doc, item, round(best / (2 * len(ws)), 9)))
    return sorted(out)


def planted(rng, share, n):
    """``n`` items and documents that each hold one of them, a share of its words replaced."""
    words = [f"w{int(3000 * rng.random() ** 3)}" for _ in range(60_000)]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    items = [(i, text(40)) for i in range(n)]
    docs = []
    for i, ws in items:
        changed = set(rng.sample(range(40), round(40 * share)))
        docs.append((i, text(60) + [rng.choice(words) if k in changed else w for k, w in enumerate(ws)] + text(60)))
    return items, docs + [(10_000 + i, text(200)) for i in range(n)]


def found(spark, items, docs):
    docs = spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "item_id long, text string")
    return sorted((r.doc_id, r.item_id, round(r.score, 9)) for r in decontaminate.leaks(docs, bench).collect())


def test_leaks_equal_slow_version(spark):
    items, docs = planted(random.Random(5), 0.2, 25)
    docs += docs[:2]
    want = slow_leaks(docs, items)
    assert found(spark, items, docs) == want and len(want) >= 25


@pytest.mark.parametrize(("share", "least"), [(0.1, 1.0), (0.2, 0.99), (0.3, 0.95)])
def test_leaks_recall(spark, share, least):
    items, docs = planted(random.Random(6), share, 200)
    got = found(spark, items, docs)
    caught = sum(1 for d, i, _ in got if d == i)
    print("replaced", share, "caught", caught, "of 200, others", len(got) - caught)
    assert caught >= least * 200 and all(d == i for d, i, _ in got)


def test_token_counts_with_one_id(spark):
    """Rows that share an id, a text with more different pre-tokens than the trie has nodes: counts as with a roomy trie."""
    from quadrat.llm import tokencount
    from quadrat.llm.queries import vocabulary

    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(300)) for _ in range(40)]
    docs = spark.createDataFrame([(7, t) for t in [*texts, texts[0]]], "doc_id long, text string")
    assert 0 < len(set(tokencount.sample(docs))) <= 40
    model = tokencount.fit(tokencount.sample(docs), tokencount.vocabulary_of(vocabulary("piece_bpe_32k.model")))
    pieces = dict(zip(tokencount.vocabulary_of(vocabulary("piece_bpe_32k.model")), model.scores))
    small, roomy = (tokencount.Trie(pieces, model.byte_score, room) for room in (50, 10**6))
    assert list(small.measure([" ".join(texts)])) == list(roomy.measure([" ".join(texts)])) and len(small.scores) < 1000
