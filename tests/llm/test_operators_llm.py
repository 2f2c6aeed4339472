"""Each operator against brute force on small tables, with nulls, empty and odd texts, ties, repeated rows, empty tables
and extra columns of clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quadrat.llm import decontaminate, extract, langid, ogg, packing, pii, simhash, suffix, tokencount, warc
from quadrat.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, root long, body string, spans string, own boolean"


def docs_of(spark, rows, parts=3):
    """A documents table with extra columns whose names clash with the operators' own."""
    full = [(i, t, "en", "s", None if t is None else len(t), 1, 2, "b", "x", True) for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "a"), (None, "a b c d e"), (7, " é" * 40), (8, "x" * 9000), (9, "a b c d e"), (9, "a b c d e")]


# ---- 1 ---------------------------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, "x"), (4, "http://d\r\nX: y", "x"), (5, "u", None), (6, "u", ""), (7, "u", big + "1"), (None, "u", big)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, sha256 string")
    warc.write_archive(pages, str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read_archive(spark, str(tmp_path / "w")).collect()}
    assert got[1].record_type == "revisit" and got[1].refers_to == 2 and got[2].record_type == "response" and got[None].refers_to == 2
    assert all(got[i].record_type == "response" and got[i].refers_to is None for i in (3, 4, 5, 6, 7))
    for i, _, body in rows:
        data = (body or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == hashlib.sha1(data).hexdigest()
    records = [bytes(r.record) for r in warc.reconstruct(spark, str(tmp_path / "w")).collect()]
    assert len(records) == len(rows)
    for r in records:
        head, _, block = r.partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert block == block[:n] + b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
    empty = pages.limit(0)
    warc.write_archive(empty, str(tmp_path / "e"))
    assert warc.read_archive(spark, str(tmp_path / "e")).count() == 0


# ---- 2 ---------------------------------------------------------------------------------------------------------------


def test_lcs():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.choice("abcdxy") for _ in range(rng.randint(0, 9))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        kept = [x for x, s in zip(a, extract.shared_lines(a, b)) if s]
        rest = iter(b)
        assert len(kept) == best[-1][-1] and all(x in rest for x in kept)


def test_extract(spark):
    article = "<nav>menu</nav><article><header><h1>T &amp; U</h1></header><p>one\n two<br>x<p>three<div class='ad'>buy</div></article><footer>f</footer>"
    plain = "<body><div>Site name</div><p>{}</p><p>Terms apply</p></body>"
    rows = [(1, "http://h/a/1", article), (2, "http://h/a/2", article), (3, "http://k/p/1", plain.format("first text")), (4, "http://www.k/p/2", plain.format("other text")),
            (5, None, None), (6, "x", ""), (7, "http://z/1", "<script>a<b</script>t<!-- c -->u"), (None, "http://z/9", "<p>alone"), (3, "http://k/p/1", plain.format("first text"))]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, part long")
    for parts in (1, 5):
        got = extract.extract(pages, parts).collect()
        text = {r.page_id: r.text for r in got}
        assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
        assert text[1] == text[2] == "T & U\none two x\nthree" and text[4] == "other text"
        assert text[5] == text[6] == "" and text[7] in ("t u", "tu") and text[None] == "alone"
    assert extract.extract(pages.limit(0)).count() == 0


def test_furniture():
    page = (
        "<body><main><p title='a hidden class=ad'>keep</p><p hidden>no</p><div class=\"cookie-banner\">no</div><section id=comments>no</section>"
        "<form><p>no</p></form><aside>no</aside><div role='complementary'>no</div><ul><li>one<li>two</ul><p class='lead'>last<b>x</b></main><p>out"
    )
    assert extract.main_text(extract.blocks(page), None) == "keep\none\ntwo\nlastx"


def test_headlines_stay():
    page = (
        '<article><header class="entry-header"><h1 class="post-header">Title</h1></header><p class="tag">kept</p><p><math><mi>x</mi></math> one</p>'
        '<svg><text>drawn</text></svg><div class="related">yes</div><p class="ad">no</p><p>a\u200bb</p></article>'
    )
    assert extract.main_text(extract.blocks(page), None) == "Title\nkept\nx one\ndrawn\nyes\na\u200bb"


@pytest.mark.parametrize("name", ["share-price", "social-history", "search-results-analysis", "related", "header-files", "adds", "menu-planning"])
def test_names_count_whole(name):
    page = f'<article><h1>Title</h1><div class="{name}"><p>the text</p></div><div class="x site-footer">no</div><div class="Ad">no</div></article>'
    assert extract.main_text(extract.blocks(page), None) == "Title\nthe text"


def test_differencing_decides(spark):
    """Without a neighbour the same page keeps the line that it shares with it."""
    page = "<article><h1>{0}</h1><p>{0} has its own text here</p><p>Read our rules</p></article>"
    rows = [(i, f"http://k/p/{i}", page.format(f"title {i}")) for i in range(2)]
    both = spark.createDataFrame(rows, "page_id long, url string, html string")
    alone = extract.extract(both.where("page_id = 0")).collect()[0].text
    assert alone.endswith("Read our rules")
    assert all("rules" not in r.text for r in extract.extract(both).collect())


@pytest.mark.parametrize("text", ["<" * 50000, "<a " * 20000, "<p>" * 20000, "<!--" * 20000, "<li>" * 10000, '<a "' * 20000])
def test_extract_odd(text):
    extract.blocks(text)


# ---- 3 ---------------------------------------------------------------------------------------------------------------


def slow_align(item, passage):
    best = 0
    h = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, j in itertools.product(range(len(item)), range(len(passage))):
        h[i + 1][j + 1] = max(0, h[i][j] + (2 if item[i] == passage[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
        best = max(best, h[i + 1][j + 1])
    return best


def test_align():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 8)), rng.integers(-1, 4, rng.integers(1, 12))
        score, begin, end = decontaminate.align(a, b)
        assert score == slow_align(a.tolist(), b.tolist())
        assert slow_align(a.tolist(), b[begin:end].tolist()) == score


def test_leaks(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(40))) for i in range(20)] + [(98, None), (99, "")]
    rows = [(i, " ".join(text(300))) for i in range(60)]
    for k in range(20):
        edited = [w if rng.random() > 0.2 else "new" for w in items[k][1].split()]
        rows.append((100 + k, " ".join(text(50) + edited + text(50))))
    rows += ODD + [(200, items[0][1].upper()), (200, items[0][1].upper())]
    docs, bench = docs_of(spark, rows), spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, word long")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect())
    assert got == sorted([(100 + k, k) for k in range(20)] + [(200, 0), (200, 0)])
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 22
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


# ---- 4 ---------------------------------------------------------------------------------------------------------------


def test_token_counts(spark):
    path = vocabulary("piece_bpe_32k.model")
    model = tokencount.fit(["the quick brown fox jumps over the lazy dog"] * 3, tokencount.vocabulary_of(path))
    trie = tokencount._trie(path, model)

    def brute(word):
        w = tokencount.MARK + word
        forward, best = [0.0], [(0.0, 0)]
        for end in range(1, len(w) + 1):
            ways = [(forward[s], best[s], trie.pieces[w[s:end]], 1) for s in range(end) if w[s:end] in trie.pieces]
            if w[end - 1] not in trie.pieces:
                n = len(w[end - 1].encode())
                ways.append((forward[-1], best[-1], n * trie.byte_score, n))
            most = max(f + p for f, _, p, _ in ways)
            forward.append(most + math.log(sum(math.exp(f + p - most) for f, _, p, _ in ways)))
            best.append(max(((b[0] + p, b[1] + n) for _, b, p, n in ways), key=lambda x: x[0]))
        return best[-1][1], forward[-1]

    rows = [*ODD[:7], (20, "the quick brown fox, the quicker foxes 漢字 \U0001f600"), (21, "quick" * 200), (22, "quicker qui the then")]
    for r in tokencount.token_counts(docs_of(spark, rows), path, model).collect():
        texts = [t or "" for i, t in rows if i == r.doc_id]
        want = [brute(w) for w in texts[0].split()]
        assert r.n_pretokens == len(want) and r.n_tokens == sum(n for n, _ in want)
        assert r.forward_logprob == pytest.approx(sum(f for _, f in want))
    assert tokencount.token_counts(docs_of(spark, rows).limit(0), path).count() == 0
    one, again = (tokencount.Trie(trie.pieces, trie.byte_score, room) for room in (1, 1 << 20))
    texts = [t for _, t in rows if t]
    assert [list(one.measure([t])) for t in texts] == [list(again.measure([t])) for t in texts] == [list(again.measure([t])) for t in texts]
    assert again.alone("quicker") == again.terminals.young["quicker"] and len(again.scores) > len(one.scores)


def test_unigram_fit(spark):
    path = vocabulary("piece_bpe_32k.model")
    pieces = tokencount.vocabulary_of(path)
    text = "the cat sat on the mat and the dog sat on the log " * 3
    model = tokencount.fit([text], pieces)
    found = dict(zip(pieces, model.scores))
    assert math.fsum(map(math.exp, model.scores)) == pytest.approx(1.0)
    assert found["▁the"] > found["▁cat"] > found["▁zebra"] if "▁zebra" in found else found["▁the"] > found["▁cat"]
    docs = docs_of(spark, [(i, text) for i in range(50)] + [(None, text), (60, None)])
    assert tokencount.sample(docs.select("doc_id", "text")) == tokencount.sample(docs.repartition(5).select("doc_id", "text"))


# ---- 5 ---------------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, near):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(values)), 2):
        if near(values[i], values[j]):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_masks_cover():
    for bits in itertools.combinations(range(64), 3):
        gone = sum(1 << b for b in bits)
        assert any(not m & gone for m in simhash.MASKS)
    assert {m.bit_count() for m in simhash.MASKS} == {32} and {s.bit_count() for x in simhash.SUBMASKS for s in x} == {16}


@pytest.mark.parametrize("hot", [2000, 20])
def test_links(spark, hot):
    rng = random.Random(5)
    centre, fps = rng.getrandbits(64), set()
    for _ in range(150):
        x = centre
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(map(simhash.signed, fps))
    want = roots(fps, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    simhash.tune(spark)
    found = dict(simhash.components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), hot)).collect())
    assert [found.get(x, x) for x in fps] == [fps[w] for w in want]


def test_simhash(spark):
    rng = random.Random(6)
    base = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.choice((5, 400)))) for _ in range(12)]
    rows = ODD + [(20 + i, t) for i, t in enumerate(base)] + [(40 + i, t.replace("ax", "AX", 1)) for i, t in enumerate(base)] + [(60 + i, t + " end") for i, t in enumerate(base)]
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    fps = [slow_fingerprint(t) for _, t in rows]
    root = roots(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {r: min(i for (i, _), x in zip(rows, root) if x == r and i is not None) for r in root}
    want = Counter((i, format(f, "016x"), least[r]) for (i, _), f, r in zip(rows, fps, root))
    assert Counter(map(tuple, got)) == want
    one = simhash.deduplicate(docs_of(spark, rows))
    assert one.columns == docs_of(spark, rows).columns and sorted(r.doc_id for r in one.collect()) == sorted(least.values())
    assert simhash.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0


# ---- 6 ---------------------------------------------------------------------------------------------------------------


def test_forward_backward():
    rng = np.random.default_rng(0)
    lengths, move = np.array([5, 3, 1]), rng.normal(size=(3, 3))
    scores = rng.normal(size=(3, 5, 3))
    found, moved = langid.forward_backward(scores, lengths, move)
    moves = np.zeros((3, 3))
    for row, n in enumerate(lengths):
        want, pairs, z = np.zeros((n, 3)), np.zeros((3, 3)), 0.0
        for path in itertools.product(range(3), repeat=int(n)):
            w = math.exp(sum(scores[row, i, p] for i, p in enumerate(path)) + sum(move[a, b] for a, b in itertools.pairwise(path)))
            z += w
            for i, p in enumerate(path):
                want[i, p] += w
            for a, b in itertools.pairwise(path):
                pairs[a, b] += w
        assert np.allclose(found[row, :n], want / z) and not found[row, n:].any()
        moves += pairs / z
    assert np.allclose(moved, moves)


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    odd = spark.createDataFrame([*ODD, (50, "123 ²½ _"), (51, "the and")], "doc_id long, text string").withColumns({"lang": F.lit("en"), "score": F.lit(1)})
    rows = {(r.doc_id, r.lang_pred) for r in langid.identify(odd).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (50, "und")} <= rows
    assert langid.keep_identified(odd).columns == odd.columns
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(odd.limit(0)).count() == 0


def test_code_switch():
    rows = [("en", f"the {a} and the {b} is of that".split()) for a in ("house", "thing") for b in ("water", "night")] * 6
    rows += [("de", f"der {a} und die {b} ist nicht".split()) for a in ("haus", "ding") for b in ("wasser", "nacht")] * 6
    found = langid.Tagger(langid.fit(rows)).marginals(["the night is of that und die nacht ist nicht".split()])[0]
    assert found[:5].argmax(axis=1).tolist() == [1] * 5 and found[5:].argmax(axis=1).tolist() == [0] * 5


# ---- 7 ---------------------------------------------------------------------------------------------------------------


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_ogg():
    assert ogg.checksum(b"OggS abc\xff\x00") == slow_crc(b"OggS abc\xff\x00")
    rng = np.random.default_rng(1)
    for n in (1, 64, 255, 4096, 4080, 255 * 255, 70_000, 300_032):
        data = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
        media = ogg.write_ogg(data)
        back, rate, times = ogg.decode(media)
        assert back == data and times[-1] == n / rate and times == sorted(times)
        assert len(ogg.read_ogg(media)) == 2
        for at in rng.integers(0, len(media), 5):
            broken = bytearray(media)
            broken[at] ^= 4
            with pytest.raises(ogg.OggError):
                ogg.decode(bytes(broken))
        with pytest.raises(ogg.OggError):
            ogg.decode(media[:-3])


def test_media_columns(spark):
    got = ogg.media_columns(docs_of(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r.payload_sha256, set()).add(tuple(r)[1:])
    assert all(len(v) == 1 or len({x[0] for x in v}) == len(v) for v in by.values())
    for i, t in ODD:
        data = (t or "").encode()
        data += bytes(-len(data) % 64 if data else 64)
        r = next(x for x in got if x.doc_id == i)
        assert (r.n_bytes, r.payload_bytes) == (len((t or "").encode()), len(data))
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.tail_crc32 == zlib.crc32(data[-64:])
        assert r.media_sha256 == hashlib.sha256(ogg.write_ogg(data)).hexdigest()
    assert ogg.media_columns(docs_of(spark, ODD).limit(0)).count() == 0


# ---- 8 ---------------------------------------------------------------------------------------------------------------


def slow_pii(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans():
    rng = random.Random(7)
    for _ in range(20000):
        t = "".join(rng.choice("a1.@+- ()9Z%") for _ in range(rng.randint(0, 40)))
        assert pii.base(t) == slow_pii(t), t
    for t in ("4444 3333 2222 1111 0", "4111111111111111", "x 4111-1111-1111-1111.", "1" * 6000 + ".1.1.1", "256.1.1.1 01.002.3.255"):
        if len(t) < 5000:
            assert pii.base(t) == slow_pii(t)
        else:
            assert [s for s in pii.base(t) if s[0] == "ip"] == []


DISGUISED = {
    "mail jоhn.dое@exаmple.com now": "email", "john [at] mail [dot] com": "email", "john(at)mail.example.com": "email",
    "jo at mail dot example dot com": "email", "call +one four four five five five one two three four ok": "phone",
    "ip one nine two dot one six eight dot one dot one": "ip", "john.55 @ mail3.example.com": "email", "j​ohn@ma​il.com": "email",
    "ｊｏｈｎ＠ｍａｉｌ．ｃｏｍ": "email", "four one one one one one one one one one one one one one one one": "card",
}


def test_disguises():
    for text, kind in DISGUISED.items():
        known = pii.base(text)
        found = pii.extra(text, known)
        assert [s[0] for s in found] == [kind], text
        assert f"[{kind.upper()}]" in pii.redacted(text)
    for text in ("look at example.com", "five. six. seven. eight", "meet me at one two three street", "v 2.0 at example.com"):
        assert pii.extra(text, pii.base(text)) == []


@pytest.mark.parametrize("unit", [".", "1", "a", " ", "1 ", "a.", "one ", "@", "a at ", "+", "+1(", "(at)", "[ ", "a@a", "-", "five dot "])
def test_long_texts_are_linear(unit):
    pii.redacted(unit * (60_000 // len(unit)))


def test_pii_query(spark):
    rows = [*ODD, (30, "a@b.co 1.2.3.4 +1 (017) 555-7713"), (31, "john [at] mail [dot] com")]
    got = {r.doc_id: r for r in pii.find_pii(docs_of(spark, rows)).collect()}
    assert got[30].n_email == got[30].n_ip == got[30].n_phone == 1 and got[30].n_card == 0
    assert got[30].spans == "email:0:6,ip:7:14,phone:15:32" and got[30].base_sha256 == hashlib.sha256(got[30].spans.encode()).hexdigest()
    assert got[31].n_email == 0 and got[31].spans == "email:0:24" and got[1].spans == ""
    out = pii.redact(docs_of(spark, rows))
    assert out.columns == docs_of(spark, rows).columns and {r.doc_id: r.text for r in out.collect()}[30] == "[EMAIL] [IP] [PHONE]"
    assert pii.find_pii(docs_of(spark, rows).limit(0)).count() == 0


# ---- 9 ---------------------------------------------------------------------------------------------------------------


def test_encoder():
    e = packing.Encoder(vocabulary("word_bpe_49k.json"))
    rng = random.Random(8)
    alphabet = "ab Z's'tl0123½²ⅧÀéßŸſ_-,.\n\t'dxÿ×÷ɐ<|endoftext|>ŉ＀ĳİı\x1c\xa0 "
    texts = ["".join(rng.choice(alphabet) for _ in range(14)) for _ in range(3000)] + ["<|endoftext|> a", "It's 1,234 KELVIN K", ""]
    assert list(e.encode(texts)) == [e._direct(t) for t in texts]
    plain = e.tokenizer.encode("".join(texts), add_special_tokens=False).ids
    assert np.frombuffer(e("".join(texts)), "<u4").tolist() == plain
    assert list(e.encode(["", " ", ""])) == [b"", b"", b""] and list(e.encode([])) == []


def test_bounds_and_fit():
    rng = np.random.default_rng(3)
    for _ in range(200):
        sizes = np.sort(rng.integers(1, 13, rng.integers(1, 9)))[::-1]
        bins = packing.best_fit_decreasing(sizes, 12)
        assert np.bincount(bins, weights=sizes).max() <= 12

        def fewest(rest, free, best):
            if len(free) >= best:
                return best
            if not rest:
                return len(free)
            for i in {f: i for i, f in enumerate(free) if f >= rest[0]}.values():
                best = min(best, fewest(rest[1:], [*free[:i], free[i] - rest[0], *free[i + 1 :]], best))
            return fewest(rest[1:], [*free, 12 - rest[0]], best)

        assert packing.lower_bound(sizes, 12) <= fewest(sizes.tolist(), [], 99) <= bins.max() + 1


def test_packing(spark):
    path = vocabulary("word_bpe_49k.json")
    rng = random.Random(9)
    rows = [*ODD, *[(100 + i, "word " * rng.randint(0, 90)) for i in range(300)]]
    e = packing.Encoder(path)
    packing.tune(spark)
    cut = packing.stored(packing.pieces(docs_of(spark, rows), path, 64))
    for items in (10_000, 40):
        got = packing.pack(cut, 64, items).collect()
        assert len(got) == cut.count()
        sequences = {}
        for r in got:
            sequences.setdefault(r.sequence_id, []).append(r)
        for parts in sequences.values():
            at = 0
            for r in sorted(parts, key=lambda r: r.offset):
                assert r.offset == at and 1 <= r.length <= 64
                at += r.length
            assert at <= 64
        total = sum(r.length for r in got)
        assert len(sequences) <= -(-total // 64) + 2
    whole = {}
    for r in got:
        whole.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        ids = e._direct(t or "") + b"\1\0\0\0"
        want = {(n, n * 64, len(p) // 4, zlib.crc32(p)) for n, p in enumerate(ids[a : a + 256] for a in range(0, len(ids), 256))}
        assert {(r.piece, r.start, r.length, r.ids_crc32) for r in whole[i]} == want
    assert packing.pack_documents(docs_of(spark, rows).limit(0), path).count() == 0


# ---- 10 --------------------------------------------------------------------------------------------------------------


def slow_repeats(rows, n):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(x[i : i + n] for x in texts for i in range(len(x) - n + 1))
    out = []
    for (doc, _), x in zip(rows, texts):
        gone = bytearray(len(x))
        for i in range(len(x) - n + 1):
            if seen[x[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(x), sum(gone), runs, hashlib.sha256(bytes(v for v, g in zip(x, gone) if not g)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("n", "k", "bucket"), [(40, 8, 2000), (40, 8, 2), (400, 64, 3)])
def test_repeats(spark, n, k, bucket):
    rng = random.Random(n + bucket)
    text = lambda m: "".join(rng.choice("abcdé ") for _ in range(m))
    shared, rows = [text(rng.randint(n // 2, 4 * n)) for _ in range(10)], []
    for doc in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            x = rng.choice(shared)
            if rng.random() < 0.4:
                i = rng.randrange(len(x))
                x = x[:i] + text(1) + x[i + 1 :]
            parts += [x[rng.randrange(len(x)) :] if rng.random() < 0.4 else x, text(rng.randint(0, 2 * n))]
        rows.append((doc if doc % 10 else None, "".join(parts) if doc % 13 else None))
    rows += [*ODD, rows[5], rows[5], (900, "a" * (5 * n)), (901, "ab" * n * 2)]
    got = suffix.remove_repeats(docs_of(spark, rows), n, k, bucket).collect()
    assert Counter(tuple(r)[:5] for r in got) == slow_repeats(rows, n)
    assert all(r.has_repeats == (r.n_removed > 0) and r.removed_share == r.n_removed / max(1, r.n_bytes) for r in got)


def test_repeats_of_one_kgram(spark, monkeypatch):
    """Many contexts around one k-gram, each window in a bucket by itself."""
    monkeypatch.setattr(suffix, "WIDE", 2)
    rng = random.Random(11)
    text = lambda m: "".join(rng.choice("abcdefgh") for _ in range(m))
    sides = [text(30) for _ in range(6)]
    rows = [(i, text(9) + rng.choice(sides)[rng.randrange(9) :] + "A" * 8 + rng.choice(sides)[: 30 - rng.randrange(9)]) for i in range(80)]
    got = suffix.remove_repeats(docs_of(spark, rows), 40, 8, 2).collect()
    assert Counter(tuple(r)[:5] for r in got) == slow_repeats(rows, 40)


def test_no_documents(spark):
    assert suffix.remove_repeats(docs_of(spark, ODD).limit(0)).count() == 0
