"""Pairs of boxes that meet, in groups too large for an equality join on the group alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs of a group up to which the group is joined as a whole, and cells of a box up to which it is dealt to cells.
WHOLE, CELLS = 4_000_000, 64
BOX = ("x1", "y1", "x2", "y2")


def crowded(left: DataFrame, right: DataFrame, by: str, whole: int = WHOLE) -> DataFrame:
    """``(by, cell)`` of the groups with more than ``whole`` pairs, and a cell of twice a box's mean extent."""
    size = F.avg(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    one = left.groupBy(by).agg(F.count("*").alias("n"), size.alias("extent"))
    two = right.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("m"), size.alias("other"))
    return one.join(two, F.col(by) == F.col("_by")).where(F.col("n") * F.col("m") > whole).select(
        by, F.greatest(2 * F.greatest("extent", "other"), F.lit(1e-9)).alias("cell")
    )


def any_crowded(left: DataFrame, right: DataFrame, by: str, whole: int = WHOLE) -> bool:
    """Whether a group may have more than ``whole`` pairs: one side then has more rows than its root. A cheap look before
    ``crowded``."""
    most = int(whole**0.5)
    many = lambda d: d.groupBy(by).count().where(F.col("count") > most).select(by)
    return not many(left).unionByName(many(right)).isEmpty()


def _span(low: str, high: str) -> Column:
    return F.sequence(F.floor(F.col(low) / F.col("cell")), F.floor(F.greatest(low, high) / F.col("cell")))


def _cells(boxes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boxes by cell, the same once each, and those that cover many cells."""
    width = lambda a, b: F.floor(F.greatest(a, b) / F.col("cell")) - F.floor(F.col(a) / F.col("cell")) + 1
    n = width("x1", "x2") * width("y1", "y2")
    few = boxes.where(n <= CELLS)
    dealt = few.withColumn("_cx", F.explode(_span("x1", "x2"))).withColumn("_cy", F.explode(_span("y1", "y2")))
    return dealt, few, boxes.where(n > CELLS)


def meeting(left: DataFrame, right: DataFrame, by: str, cells: DataFrame) -> DataFrame:
    """``(by, a, b)``, structs of all columns of each side, of the pairs of boxes that meet (a touch counts) in the groups
    of ``cells``. A pair whose boxes share several cells is reported in the one that holds the least corner of what they
    share, so once. Boxes over more than ``CELLS`` cells, which meet most others anyway, are joined on the group."""
    l, r = (d.join(cells, by) for d in (left, right))  # noqa: E741
    side = lambda d, columns, name: d.select(by, *[c for c in ("_cx", "_cy", "cell") if c in d.columns], F.struct(*columns).alias(name))
    (lc, lf, lw), (rc, _, rw) = _cells(l), _cells(r)
    meet = (F.col("a.x1") <= F.col("b.x2")) & (F.col("b.x1") <= F.col("a.x2")) & (F.col("a.y1") <= F.col("b.y2")) & (F.col("b.y1") <= F.col("a.y2"))
    a, b = side(lc, left.columns, "a"), side(rc, right.columns, "b").drop("cell")
    at = lambda c: F.floor(F.greatest(f"a.{c}", f"b.{c}") / F.col("cell"))
    near = a.join(b, [by, "_cx", "_cy"]).where(meet & (at("x1") == F.col("_cx")) & (at("y1") == F.col("_cy"))).select(by, "a", "b")
    plain = lambda d, columns, name: side(d, columns, name).select(by, name)
    wide = plain(lw, left.columns, "a").join(plain(r, right.columns, "b"), by).where(meet)
    narrow = plain(lf, left.columns, "a").join(plain(rw, right.columns, "b"), by).where(meet)
    return near.unionByName(wide).unionByName(narrow)
