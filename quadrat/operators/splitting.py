"""Train, validation and test splits."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrat.session import ranked_randomly

SPLITS = ("train", "val", "test")
RATIOS = (0.7, 0.15, 0.15)
#: Weights of the greedy rule, and of the exact one's deviations.
GREEDY_WEIGHTS = (0.8, 0.9, 1.0)
EXACT_WEIGHTS = (3.0, 2.0, 1.0)


def check_ratios(ratios: Sequence[float]) -> None:
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError(f"ratios must add up to 1: {ratios}")


def random_split(df: DataFrame, key: str, ratios: Sequence[float] = RATIOS, seed: int = 42) -> DataFrame:
    """Each split gets one row first; floors of the rest follow, test takes what is left. One row: train; two: train
    and val."""
    check_ratios(ratios)
    total = df.agg(F.count("*").alias("_n"))
    rest = F.greatest(F.col("_n") - 3, F.lit(0))
    train, val = F.floor(rest * ratios[0]), F.floor(rest * ratios[1])
    at = F.col("_rn") - 3
    split = (
        F.when(F.col("_rn") == 1, "train").when(F.col("_rn") == 2, "val").when(F.col("_rn") == 3, "test")
        .when(at <= train, "train").when(at <= train + val, "val").otherwise("test")
    )
    return ranked_randomly(df, seed, key, "_rn").crossJoin(F.broadcast(total)).withColumn("split", split).drop("_rn", "_n")  # one row


def group_counts(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), value).agg(F.count("*").alias("n"))


def greedy_groups(counts: DataFrame, value: str, ratios: Sequence[float] = RATIOS, by: list[str] | None = None) -> DataFrame:
    """``counts`` (value, n; per stratum of ``by``) with ``split``: the largest three go to train, val and test, each
    further one to the split whose weighted relative distance from its target is then least.

    The values of a stratum (tiles, rooms, weeks) are few; they are folded in one expression.
    """
    check_ratios(ratios)
    by = by or []
    groups = counts.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(value).alias("v"), "n"))).alias("_g"),
        F.sum("n").alias("_total"),
    )
    zero = F.struct(
        *[F.lit(0).cast("long").alias(s) for s in SPLITS], F.array().cast("array<string>").alias("out")
    )

    def place(acc, g):
        i = F.size(acc["out"])
        gaps = [
            F.lit(w) * F.abs((acc[s] + g["n"]) / F.greatest(F.lit(1.0), F.col("_total") * r) - 1)
            for s, w, r in zip(SPLITS, GREEDY_WEIGHTS, ratios)
        ]
        least = F.least(*gaps)
        chosen = F.when(i < 3, F.get(F.array(*map(F.lit, SPLITS)), i)).otherwise(
            F.when(gaps[0] == least, "train").when(gaps[1] == least, "val").otherwise("test")
        )
        return F.struct(
            *[(acc[s] + F.when(chosen == s, g["n"]).otherwise(0)).alias(s) for s in SPLITS],
            F.concat(acc["out"], F.array(chosen)).alias("out"),
        )

    folded = groups.select(*by, "_g", F.aggregate("_g", zero, place)["out"].alias("_s"))
    return folded.select(*by, F.explode(F.arrays_zip("_g", "_s")).alias("x")).select(
        *by, F.col("x._g.v").alias(value), F.col("x._g.n").alias("n"), F.col("x._s").alias("split")
    )


def assign_groups(df: DataFrame, chosen: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Rows with the split of their group."""
    return df.join(chosen.select(*(by or []), value, "split"), [*(by or []), value])


def last_stratum(chosen: DataFrame, value: str, stratum: str) -> DataFrame:
    """One split for each value: later strata overwrite earlier ones."""
    return chosen.groupBy(value).agg(F.max_by("split", stratum).alias("split"))


def split_counts(df: DataFrame, ratios: Sequence[float] = RATIOS) -> DataFrame:
    """Rows, share and distance from the target of each split."""
    target = F.coalesce(*[F.when(F.col("split") == s, F.lit(r)) for s, r in zip(SPLITS, ratios)])
    counts = df.groupBy("split").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # three rows
    return counts.select(
        "split", "n", F.round(100.0 * F.col("n") / total, 6).alias("pct"),
        F.round(F.abs(F.col("n") - total * target), 6).alias("deviation"),
    )


#: Groups whose assignments are met in the middle, in two halves of at most 3^11 sums each.
MIDDLE = 22


def _sums(sizes: Sequence[int], total: int) -> np.ndarray:
    """What train and val can hold, which splits are used (bits), and one assignment (base 3) for each such case."""
    out = np.zeros((4, 1), np.int64)
    for i, n in enumerate(sizes):
        steps = ((n, 0, 1, 0), (0, n, 2, 3**i), (0, 0, 4, 2 * 3**i))
        parts = [np.stack((out[0] + da, out[1] + db, out[2] | bit, out[3] + code)) for da, db, bit, code in steps]
        out = np.concatenate(parts, axis=1)
        _, first = np.unique((out[0] * (total + 1) + out[1]) * 8 + out[2], return_index=True)
        out = out[:, first]
    return out


def exact_groups(counts: Sequence[tuple], ratios: Sequence[float] = RATIOS) -> tuple[dict, float]:
    """The assignment of group values (value, n) with the least weighted deviation, none of the splits empty.

    Branch and bound over the largest groups; the last ``MIDDLE`` are met in the middle: sums of one half in cells, and
    for each sum of the other those within the best deviation so far. It ends when that is the least that any sums
    could have, or when all is searched. The groups are the few values of one field, gathered on the driver.
    """
    check_ratios(ratios)
    order = sorted(counts, key=lambda c: (-c[1], str(c[0])))
    if len(order) <= 3:
        out = dict(zip((v for v, _ in order), SPLITS))
        return out, _objective(order, out, ratios)
    sizes = [int(n) for _, n in order]
    total, step = sum(sizes), max(1, math.gcd(*sizes))
    goals = [total * r for r in ratios]

    def cost(a, b):
        return sum(w * abs(x - g) for w, x, g in zip(EXACT_WEIGHTS, (a, b, total - a - b), goals))

    near = [[(int(g // step) + k) * step for k in range(-2, 4)] for g in goals[:2]]
    bound = min(cost(a, b) for a in near[0] for b in near[1]) + 1e-6
    cut = max(0, len(order) - MIDDLE)
    one, two = _sums(sizes[cut::2], total), _sums(sizes[cut + 1 :: 2], total)
    one = one[:, np.random.default_rng(42).permutation(one.shape[1])]
    best, found = np.inf, None
    stack: list[tuple[tuple[int, ...], int, int, int]] = [((), 0, 0, 0)]  # splits of the largest, train, val, bits
    while stack and best > bound:
        prefix, a0, b0, used = stack.pop()
        over = [max(0, x - g) for x, g in zip((a0, b0, sum(sizes[: len(prefix)]) - a0 - b0), goals)]
        if sum((w + min(EXACT_WEIGHTS)) * o for w, o in zip(EXACT_WEIGHTS, over)) > best:
            continue
        if len(prefix) < cut:
            n = sizes[len(prefix)]
            held = (a0, b0, sum(sizes[: len(prefix)]) - a0 - b0)
            for s in sorted(range(3), key=lambda s: goals[s] - held[s]):  # the emptiest is searched first
                stack.append(((*prefix, s), a0 + n * (s == 0), b0 + n * (s == 1), used | 1 << s))
            continue
        at, take, side = 0, 300, np.inf
        while at < one.shape[1] and best > bound:
            room = best / min(EXACT_WEIGHTS[:2]) + 1 if found else total + 1.0
            if 1.5 * room < side:  # cells no narrower than the deviation leaves room for
                side = room
                row, column = (two[:2] // side).astype(np.int64)
                width = int(total // side) + 3
                dealt = np.argsort(keys := row * width + column, kind="stable")
                keys, side_sums = keys[dealt], two[:, dealt]
            part = one[:, at : at + take]
            rows = np.floor((goals[0] - a0 - part[0]) / side).astype(np.int64) + np.array([[-1], [0], [1]])
            columns = np.floor((goals[1] - b0 - part[1]) / side).astype(np.int64)
            lo = np.searchsorted(keys, rows * width + np.maximum(columns - 1, 0)).ravel()
            hi = np.searchsorted(keys, rows * width + np.minimum(columns + 1, width - 1), "right").ravel()
            hi = np.maximum(lo, hi)
            if (ends := np.cumsum(hi - lo))[-1] > 4_000_000 and part.shape[1] > 1:
                take = max(1, part.shape[1] // 2)
                continue
            at += part.shape[1]
            take = min(1 << 16, 2 * take)
            if not ends[-1]:
                continue
            i = np.repeat(np.tile(np.arange(part.shape[1]), 3), hi - lo)
            j = np.arange(ends[-1]) - np.repeat(ends - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
            values = cost(a0 + part[0, i] + side_sums[0, j], b0 + part[1, i] + side_sums[1, j])
            values = np.where(used | part[2, i] | side_sums[2, j] == 7, values, np.inf)
            k = int(values.argmin())
            if values[k] < best:
                best, found = float(values[k]), (prefix, int(part[3, i[k]]), int(side_sums[3, j[k]]))
    prefix, left, right = found
    splits = list(prefix) + [0] * (len(order) - cut)
    for first, code in ((cut, left), (cut + 1, right)):
        for k in range(first, len(order), 2):
            code, splits[k] = divmod(code, 3)
    out = {value: SPLITS[s] for (value, _), s in zip(order, splits)}
    return out, _objective(order, out, ratios)


def _objective(counts: Sequence[tuple], chosen: dict, ratios: Sequence[float]) -> float:
    total = sum(n for _, n in counts)
    held = {s: sum(n for v, n in counts if chosen.get(v) == s) for s in SPLITS}
    return sum(w * abs(held[s] - total * r) for s, w, r in zip(SPLITS, EXACT_WEIGHTS, ratios))


def preview(df: DataFrame, key: str, ratios: Sequence[float] = RATIOS, seed: int = 42) -> DataFrame:
    """``key, split`` of a random split that is only looked at: floors of the shares, test takes what is left, and no split
    is given a row first."""
    check_ratios(ratios)
    total = df.agg(F.count("*").alias("_n"))
    train, val = F.floor(F.col("_n") * ratios[0]), F.floor(F.col("_n") * ratios[1])
    split = F.when(F.col("_rn") <= train, "train").when(F.col("_rn") <= train + val, "val").otherwise("test")
    return ranked_randomly(df, seed, key, "_rn").crossJoin(total).select(key, split.alias("split"))


def preview_summary(assigned: DataFrame, ratios: Sequence[float] = RATIOS) -> DataFrame:
    """``split, n, deviation``: sizes, and how far each share is from its target; a split without a row is there with 0."""
    target = F.create_map(*[F.lit(x) for s, r in zip(SPLITS, ratios) for x in (s, float(r))])
    counts = assigned.agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS], F.count("*").alias("_all"))
    rows = counts.select("_all", F.explode(F.create_map(*[x for s in SPLITS for x in (F.lit(s), F.col(s))])).alias("split", "n"))
    share = F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("_all")), F.lit(0.0))
    return rows.select("split", "n", F.round(F.abs(share - F.element_at(target, F.col("split"))), 9).alias("deviation"))
