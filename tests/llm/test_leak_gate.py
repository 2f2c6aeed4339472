"""One rare seed is enough for an alignment."""

import random

from quadrat.llm import decontaminate


def test_one_seed_is_enough(spark):
    words = [f"w{i}" for i in range(9000)]
    item = "alpha beta gamma delta epsilon zeta eta theta".split()
    edited = [w if i not in (3, 5) else "new" for i, w in enumerate(item)]
    rng = random.Random(2)
    fill = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, fill(300)) for i in range(50)] + [(100, f"{fill(20)} {' '.join(edited)} {fill(20)}")]
    # The item's words are so frequent by themselves that seeds are of three words.
    rows += [(200 + i, " ".join(f"{w} x{i}y{k}" for k, w in enumerate(item * 6))) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "w1")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(docs, bench).collect()}
    assert found.get((100, 1), 0) > 0.6 and not any(i == 2 for _, i in found)
    assert 100 not in {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()}
