"""The balance step against a loop, by buckets of one to three digits, and the filter's areas in batches."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quadrat.functions import cuts
from quadrat.functions import geometry as G
from quadrat.operators import counting


@pytest.mark.parametrize("digits", [1, 3])
def test_balance_by_buckets(spark, monkeypatch, digits):
    monkeypatch.setattr(counting, "_DIGITS", digits)
    rows = [(f"{s}{i}", s, "non_empty" if i % 5 == 0 else "empty") for s in ("a", "b", None) for i in range(200)]
    rows += [(f"c{i}", "c", "empty") for i in range(20)] + [(f"d{i}", "d", "non_empty") for i in range(20)] + [("x", "a", "missing")]
    rows += [(f"e{i}", "e", "empty" if i % 9 == 0 else "non_empty") for i in range(100)]
    by = defaultdict(list)
    for key, split, state in rows:
        by[split, state].append((hashlib.md5(f"7:{key}".encode()).hexdigest(), key))
    df = spark.createDataFrame(rows, "image_id string, split string, state string")
    for every in (False, True):
        want = set()
        for (split, state), own in by.items():
            ne, em = len(by.get((split, "non_empty"), [])), len(by.get((split, "empty"), []))
            quota = 0 if state == "missing" or not ne else ne if em == 0 or every and state == "non_empty" else min(ne, em)
            want |= {(key, split, state) for _, key in sorted(own)[:quota]}
        found = counting.balance_sample(df, "image_id", 7, every)
        assert found.columns == df.columns and found.count() == len(want) and set(map(tuple, found.collect())) == want


def test_balance_ranks_only_what_is_on_the_border(spark):
    """Of the larger side, a small part is ranked, whatever its size."""
    df = spark.range(40_000).select(F.col("id").alias("image_id"), F.lit("a").alias("split"), F.when(F.col("id") % 4 == 0, "non_empty").otherwise("empty").alias("state"))
    found = counting.balance_sample(df, "image_id", 1)
    assert found.count() == 20_000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "Window" not in plan[: plan.index("Union")]


def test_areas_in_batches(spark):
    rows = [(i, [j * 0.37 % 1 for j in range(i)], 7 * i, None if i == 9 else 11) for i in range(14)] + [(20, None, 3, 3), (21, [0.1, None, 0.2, 0.3, 0.5, 0.1], 3, 3)]
    df = spark.createDataFrame(rows, "id int, coords array<double>, w long, h long")
    one = df.select("id", cuts.pixel_area(F.col("coords"), F.col("w"), F.col("h")).alias("a"))
    two = df.select("id", G.pixel_area(F.col("coords"), F.col("w"), F.col("h")).alias("a"))
    small = lambda d: {r.id: r.a for r in d.where("id <> 9").collect()}
    assert small(one) == small(two) and {r.a for r in one.where("id = 9").collect()} == {None}
