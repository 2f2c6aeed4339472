"""Concave polygons cut to a rectangle, each part by itself."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrat.functions.geometry import bound, points

Ring = list[tuple[float, float]]


def is_convex(coords: Column) -> Column:
    """Whether a polygon turns one way only."""

    def one(p: Column) -> Column:
        n = F.size(p)
        at = lambda i: F.get(p, i % n)

        def turn(i: Column) -> Column:
            a, b, c = at(i), at(i + 1), at(i + 2)
            return F.signum((b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"]))

        turns = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), turn)
        return (n < 3) | ~(F.exists(turns, lambda t: t > 0) & F.exists(turns, lambda t: t < 0))

    return bound(points(coords), one)


def halved(ring: Ring, axis: int, limit: float, sign: int) -> list[Ring]:
    """The parts of a simple polygon where ``sign`` times (coordinate - limit) is positive.

    The border is walked in chains, each from the point where it enters to the one where it leaves. In order along the
    line, every other stretch between such points lies in the polygon, so it joins a leaving point to an entering one.
    Where several meet, those come first whose border leans that way, as on a line a little further in.
    """
    depth = [sign * (p[axis] - limit) for p in ring]
    n = len(ring)
    if all(d > 0 for d in depth):
        return [ring]
    begins = [i for i in range(n) if depth[i] > 0 and depth[i - 1] <= 0]

    def crossing(out: int, inner: int) -> tuple[tuple[float, float], float, float]:
        """The point between two corners, its place along the line, and how the border leans there."""
        p, q = ring[out], ring[inner]
        t = depth[out] / (depth[out] - depth[inner])
        along = p[1 - axis] + t * (q[1 - axis] - p[1 - axis])
        point = (limit, along) if axis == 0 else (along, limit)
        return point, along, (q[1 - axis] - along) / depth[inner]

    chains, marks = [], []
    for k, first in enumerate(begins):
        inner = [first]
        while depth[(inner[-1] + 1) % n] > 0:
            inner.append((inner[-1] + 1) % n)
        enter, leave = crossing(first - 1, first), crossing((inner[-1] + 1) % n, inner[-1])
        chains.append([enter[0], *(ring[i] for i in inner), leave[0]])
        marks += [(*enter[1:], k, 0), (*leave[1:], k, 1)]
    marks.sort()
    goes = {}
    for a, b in zip(marks[::2], marks[1::2]):
        for x, y in ((a, b), (b, a)):
            if x[3] == 1:
                goes[x[2]] = y[2]
    out, left = [], set(range(len(chains)))
    while left:
        k = min(left)
        whole: Ring = []
        while k in left:
            left.discard(k)
            whole += chains[k]
            k = goes.get(k, k)
        out.append([p for i, p in enumerate(whole) if p != whole[i - 1]])
    return [r for r in out if len(r) >= 3]


def clip_parts(coords: str, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Flat coordinates of each part of a simple polygon inside a rectangle; none for null or without a common area."""

    @F.pandas_udf("array<array<double>>")
    def cut(polygons: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        out = []
        for flat, *box in zip(polygons, x0, y0, x1, y1):
            rings = [[(float(flat[i]), float(flat[i + 1])) for i in range(0, len(flat) - 1, 2)]] if flat is not None else []
            for axis, limit, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
                rings = [part for ring in rings for part in halved(ring, axis, float(limit), sign)]
            out.append([[c for p in ring for c in p] for ring in rings])
        return pd.Series(out, dtype=object)

    return cut(coords, x0, y0, x1, y1)
