import corpus_pipeline as P
from quadrat.llm import decontaminate, packing, pii
from quadrat.llm.common import stored, table
from quadrat.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    seen = [docs]
    for _, stage in P.STAGES:
        seen.append(stored(stage(spark, seen[-1], SF)))
    assert all(d.columns == docs.columns for d in seen[:-1])
    counts = [d.count() for d in seen[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.8 * counts[0]
    leaked = {r.doc_id for r in decontaminate.leaks(seen[2], table(spark, SF, "benchmark")).collect()}
    assert {r.doc_id for r in seen[3].collect()} == {r.doc_id for r in seen[2].collect()} - leaked
    for r in seen[4].collect():
        assert not pii.base(r.text) and r.n_chars == len(r.text)
    e = packing.Encoder(vocabulary("word_bpe_49k.json"))
    lengths = {r.doc_id: len(e(r.text)) // 4 + 1 for r in seen[4].collect()}
    found: dict = {}
    for r in seen[5].collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + r.length
    assert found == lengths


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names}
    assert [n for n, _ in P.STAGES] == ["language", "near_dedup", "decontamination", "pii", "packing"]
