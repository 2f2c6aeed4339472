"""Every query against its DuckDB twin at the smallest scale."""

import os

import duckdb
import pytest

from quadrat.plans import catalogue_files, catalogue_labels, catalogue_masks  # noqa: F401  adds to the tables
from quadrat.plans.catalogue import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        path = f"{SF}/{f}" if os.path.isfile(f"{SF}/{f}") else f"{SF}/{f}/*.parquet"
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    return c


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool):
        return str(value)
    try:
        return f"{float(value):.9g}"
    except (TypeError, ValueError):
        return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_greedy_matches(spark):
    from collections import defaultdict

    from quadrat.operators import matching
    from quadrat.plans import catalogue as C

    found = C.candidates(spark, SF)
    by = defaultdict(list)
    for r in found.collect():
        by[r.image_id].append((-r.iou, r.gt_id, r.pred_id))
    want = set()
    for image, rows in by.items():
        g, p = set(), set()
        for o, a, b in sorted(rows):
            if a not in g and b not in p:
                g.add(a), p.add(b), want.add((image, a, b))
    for fold in (0, matching.FOLD):  # in rounds, in one row an image
        assert {(r.image_id, r.gt_id, r.pred_id) for r in matching.greedy_match(found, "gt_id", "pred_id", fold).collect()} == want
    pairs = matching.label_pairs(C.truth(spark, SF), C.predictions(spark, SF), matching.greedy_match(found, "gt_id", "pred_id"), "gt_id", "pred_id")
    assert pairs.where("true_label = pred_label").count() >= len(want)
