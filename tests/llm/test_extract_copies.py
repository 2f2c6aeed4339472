"""Copies next to each other keep their text; lines that pages share inside articles go."""

from quadrat.llm import extract


def texts(spark, rows, parts):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return sorted(((r.page_id, r.text) for r in extract.extract(pages, parts).collect()))


def test_repeated_plain_page(spark):
    plain = "<body><div>Site name</div><p>{}</p><p>Terms apply</p></body>"
    rows = [(3, "http://k/p/1", plain.format("first text"))] * 3 + [(4, "http://k/p/2", plain.format("other text"))]
    for parts in (1, 5):
        assert texts(spark, rows, parts) == [(3, "first text")] * 3 + [(4, "other text")]
    rows = [(i, f"http://k/p/{i}", plain.format("a text of some length " * 4)) for i in (1, 2)] + [(3, "http://k/p/3", plain.format("another text"))]
    assert [t for _, t in texts(spark, rows, 1)] == [("a text of some length " * 4).strip()] * 2 + ["another text"]
    assert texts(spark, rows[:2], 1)[0][1].startswith("Site name")


def test_shared_line_in_article(spark):
    page = "<article><h1>{0}</h1><p>{0} has its own text here</p><p>Read our rules</p></article>"
    rows = [(i, f"http://k/p/{i}", page.format(f"title {i}")) for i in range(3)]
    for parts in (1, 5):
        assert texts(spark, rows, parts) == [(i, f"title {i}\ntitle {i} has its own text here") for i in range(3)]
