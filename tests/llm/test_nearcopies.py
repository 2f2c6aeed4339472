"""The pipeline's near-copy stage against brute force over all pairs."""

import random

import corpus_pipeline
from quadrat.llm import nearcopies


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return (len(a & b) / len(a | b) if a | b else 1.0) >= 0.8


def test_near_copies(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    texts = [None, "", " \n", "one", "ONE", "a b c d", "a b c d e"]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice((30, 120, 400)))]
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = "edit"
            texts.append(" ".join(copy))
    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, node long").repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted({find(i) for i in range(len(texts))})
    assert nearcopies.deduplicate(docs.limit(0)).count() == 0


def test_recall_at_the_threshold():
    rng = random.Random(4)
    met = n = 0
    for _ in range(300):
        shared, one, other = ([rng.getrandbits(64) for _ in range(k)] for k in (160, 20, 20))
        sets = [nearcopies.np.unique(nearcopies.np.array(shared + x, nearcopies.np.uint64)) for x in (one, other)]
        met += bool(set(nearcopies.keys_of(sets[0])) & set(nearcopies.keys_of(sets[1])))
        n += 1
    assert met == n


def test_links_across_blocks(spark):
    """Copies that no bucket's least node is near to, in blocks of any size: the same components as brute force."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(120)] = f"e{rng.randrange(30)}"
        texts.append(" ".join(copy))
    sets, root = [grams(t) for t in texts], list(range(60))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(60):
        for j in range(i):
            if alike(sets[i], sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(find(i), set()).add(nearcopies.node_of(nearcopies.shingles(t)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    own = nearcopies.stored(nearcopies._keys(docs, 5))
    for block in (150, 2000, 64_000):
        found = {r.u: r.root for r in nearcopies.components_of(docs, own, block=block).collect()}
        got = {}
        for nodes in groups.values():
            for n in nodes:
                got.setdefault(found.get(n, n), set()).add(n)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))
    assert len(groups) < 60
