"""What operator 13 holds: names in arrays, stored rows decoded a few at once; the first of each new name is told once."""

import numpy as np

from quadrat.llm import phrases


def test_new_names(monkeypatch):
    rng = np.random.default_rng(4)
    seen, met = phrases._Seen(), set()
    for _ in range(20):
        names = rng.integers(-50, 50, 30, dtype=np.int64).view(np.uint64)
        at = seen.new(names)
        want = {x: i for i, x in reversed(list(enumerate(names.view(np.int64).tolist()))) if x not in met}
        assert {int(names.view(np.int64)[i]): int(i) for i in at} == want and len(at) == len(want)
        met |= set(want)
    assert isinstance(seen.names, np.ndarray) and seen.names.tolist() == sorted(met)
    monkeypatch.setattr(phrases, "HELD", 10)
    seen.new(names)
    assert len(seen.names) == 0  # forgotten, as they are many


def test_stored_rows_are_decoded_a_few_at_once(spark, monkeypatch):
    name, seen = "spark.sql.parquet.columnarReaderBatchSize", []
    former, plain = spark.conf.get(name), phrases.stored
    monkeypatch.setattr(phrases, "stored", lambda df: seen.append(spark.conf.get(name)) or plain(df))
    docs = spark.createDataFrame([("en", "a b c d e a b c d e")] * 5, "lang string, text string")
    assert phrases.collocations(docs, 5).count() > 0
    assert set(seen) == {str(phrases._AT_ONCE)} and spark.conf.get(name) == former
    assert phrases._AT_ONCE * 16 * phrases.SLICE <= 128 << 20
