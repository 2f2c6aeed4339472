"""Sequential greedy choices taken in rounds, for groups too large for one row.

A choice in a fixed order that only neighbours can forbid needs no sequence: whoever stands before all neighbours that are
still there is chosen in any case. Every round takes all of these at once and removes whom they exclude, so the result is
that of the loop, and a group is never in one task. Rounds are as many as the longest chain of waiting neighbours.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.session import stored


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def greedy_edges(edges: DataFrame, by: str, a: str, b: str, order: list[str], shared: bool = False) -> DataFrame:
    """``(by, a, b)`` of the pairs that a loop takes which goes through a group's pairs in ``order`` and takes those whose
    two ends are free. ``shared``: both ends are of one kind, so an end may stand on either side."""
    sides = (F.lit(0), F.lit(0 if shared else 1))
    end = lambda c, side: F.struct(side.alias("side"), F.col(c).cast("string").alias("key"))
    left = stored(edges.select(by, a, b, *[c for c in order if c not in (by, a, b)]))
    chosen: list[DataFrame] = []
    place = F.struct(*order, *[c for c in (a, b) if c not in order])
    while True:
        ends = left.select(by, F.explode(F.array(end(a, sides[0]), end(b, sides[1]))).alias("_end"), place.alias("_o"))
        first = ends.groupBy(by, "_end").agg(F.min("_o").alias("_o"))
        taken = stored(first.groupBy(by, "_o").agg(F.count("*").alias("n")).where("n = 2").select(by, f"_o.{a}", f"_o.{b}"))
        if taken.isEmpty():
            break
        chosen.append(taken)
        gone = taken.select(by, F.explode(F.array(end(a, sides[0]), end(b, sides[1]))).alias("_end"))
        for c, side in ((a, sides[0]), (b, sides[1])):
            left = left.withColumn("_end", end(c, side)).join(gone, [by, "_end"], "left_anti").drop("_end")
        left = stored(left)
    return _union(chosen) if chosen else taken


def greedy_kept(items: DataFrame, hides: DataFrame, by: str, key: str) -> DataFrame:
    """``(by, key)`` of the items that a loop keeps which drops an item hidden by a kept one. ``hides``: (by, over, under),
    ``over`` before ``under`` in the loop's order."""
    open_items, edges = stored(items.select(by, key)), stored(hides.select(by, "over", "under"))
    kept: list[DataFrame] = []
    while not open_items.isEmpty():
        waiting = edges.select(by, F.col("under").alias(key)).distinct()
        now = stored(open_items.join(waiting, [by, key], "left_anti"))
        kept.append(now)
        gone = stored(edges.join(now.select(by, F.col(key).alias("over")), [by, "over"], "left_semi").select(by, F.col("under").alias(key)).distinct())
        settled = now.unionByName(gone)
        open_items = stored(open_items.join(settled, [by, key], "left_anti"))
        for side in ("over", "under"):
            edges = edges.join(settled.withColumnRenamed(key, side), [by, side], "left_anti")
        edges = stored(edges)
    return _union(kept) if kept else open_items
