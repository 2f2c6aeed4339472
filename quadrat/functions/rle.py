"""Run lengths of bit rows: the first run is of zeros and may be 0 long."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode(bits: Column) -> Column:
    """Run lengths of an array of 0 and 1, the last run included."""
    n = F.size(bits)
    ends = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (F.get(bits, i) != F.when(i == 0, 0).otherwise(F.get(bits, i - 1))))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(
        F.transform(ends, lambda e, i: (e - F.when(i == 0, 0).otherwise(F.get(ends, i - 1))).cast("int"))
    )


def decode(runs: Column) -> Column:
    """The bits of run lengths."""
    return F.flatten(F.transform(runs, lambda r, i: F.array_repeat((i % 2).cast("int"), r)))
