"""Connected components of a graph given by its edges: alternating large-star and small-star rounds.

Every round is two aggregations with partial sums and two joins on the node, each of narrow rows, stored in the shared
folder; nothing is collected but two numbers per round. A hub's rows meet in one task only as a partial minimum. The
minima are stored before they are joined: both sides of the join are then plain exchanges, which adaptive execution
splits where a hub is frequent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` with u > v."""
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(u, root)`` of every node that is not the least of its component. ``edges``: (u, v), longs, in any order;
    nodes without an edge, or with one to themselves only, don't appear."""
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        now = stored(_small_star(stored(_large_star(now))))
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components didn't settle")
    return now.select("u", F.col("v").alias("root"))
