"""Polygons cut to tiles in numpy: all polygons of an Arrow batch with as many points are worked on at once.

The same results as the column builders ``geometry.clip`` (convex polygons) and ``parts.clip_parts`` (others), number by
number. Memory is bounded by ``VALUES``, however many tiles a polygon lies in."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrat.functions.parts import halved

#: Numbers of a table of points that are worked on at once.
VALUES = 1 << 18


def simple(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which polygons have no two edges that cross or touch and aren't neighbours. A row is a polygon."""
    n = x.shape[1]
    out = np.full(len(x), n >= 3)
    step = max(1, (1 << 15) // n)
    for first in range(0, n - 2, step):
        i, j = (v.ravel() for v in np.meshgrid(np.arange(first, min(first + step, n - 2)), np.arange(2, n), indexing="ij"))
        apart = (j > i + 1) & ~((i == 0) & (j == n - 1))
        i, j = i[apart], j[apart]
        rows = max(1, (1 << 15) // max(1, len(i)))
        for at in range(0, len(x), rows):
            out[at : at + rows] &= ~_crossing(x[at : at + rows], y[at : at + rows], i, j).any(axis=1)
    return out


def _crossing(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = ((x[:, k], y[:, k]) for k in (i, (i + 1) % n, j, (j + 1) % n))
    out = (np.maximum(ax, bx) >= np.minimum(cx, dx)) & (np.maximum(cx, dx) >= np.minimum(ax, bx))
    out &= (np.maximum(ay, by) >= np.minimum(cy, dy)) & (np.maximum(cy, dy) >= np.minimum(ay, by))
    if not out.any():
        return out
    turn = lambda px, py, qx, qy, rx, ry: np.sign((qx - px) * (ry - py) - (qy - py) * (rx - px))
    out &= turn(ax, ay, bx, by, cx, cy) * turn(ax, ay, bx, by, dx, dy) <= 0
    return out & (turn(cx, cy, dx, dy, ax, ay) * turn(cx, cy, dx, dy, bx, by) <= 0)


def convex(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which polygons turn one way only."""
    bx, by, cx, cy = (np.roll(v, -k, axis=1) for k in (1, 2) for v in (x, y))
    turn = (bx - x) * (cy - by) - (by - y) * (cx - bx)
    return ~((turn > 0).any(axis=1) & (turn < 0).any(axis=1))


def areas(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Shoelace areas of the first ``n`` points of each row, summed in their order."""
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for i in range(x.shape[1]):
        j = np.maximum(n - 1, 0) if i == 0 else i - 1
        px, py = (x[rows, j], y[rows, j]) if i == 0 else (x[:, j], y[:, j])
        total += np.where(i < n, x[:, i] * py - y[:, i] * px, 0.0)
    return np.where(n >= 3, 0.5 * np.abs(total), 0.0)


def _half(x: np.ndarray, y: np.ndarray, n: np.ndarray, limit: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Convex polygons where ``sign`` times (x - limit) isn't negative."""
    k = np.arange(x.shape[1])
    there, limits = k < n[:, None], limit[:, None]
    inside = (sign * (x - limits) >= 0) & there
    before = np.where(k == 0, np.maximum(n[:, None] - 1, 0), k - 1)
    px, py, was = (np.take_along_axis(v, before, axis=1) for v in (x, y, inside))
    cross = (inside != was) & there
    with np.errstate(all="ignore"):
        along = py + (limits - px) / (x - px) * (y - py)
    many = cross.astype(np.int64) + inside
    ends = np.cumsum(many, axis=1)
    size = ends[:, -1]
    ox, oy = np.zeros((2, len(x), max(1, int(size.max(initial=0)))))
    r, i = np.nonzero(cross)
    at = ends[r, i] - many[r, i]
    ox[r, at], oy[r, at] = limit[r], along[r, i]
    r, i = np.nonzero(inside)
    ox[r, ends[r, i] - 1], oy[r, ends[r, i] - 1] = x[r, i], y[r, i]
    return ox, oy, size


def _joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of points, one under the other."""
    wide = max(p[0].shape[1] for p in parts)
    pad = lambda v: np.pad(v, ((0, 0), (0, wide - v.shape[1])))
    return np.concatenate([pad(p[0]) for p in parts]), np.concatenate([pad(p[1]) for p in parts]), np.concatenate([p[2] for p in parts])


def clipped(x: np.ndarray, y: np.ndarray, box: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Convex polygons cut to boxes (x0, y0, x1, y1), and how many points each has then."""
    n = np.full(len(x), x.shape[1])
    for axis, side, sign in ((0, 0, 1), (0, 2, -1), (1, 1, 1), (1, 3, -1)):
        v, limit = (x, y)[axis], box[side]
        out = ((sign * (v - limit[:, None]) < 0) & (np.arange(v.shape[1]) < n[:, None])).any(axis=1)
        if not out.any():
            continue
        one, other = (x, y) if axis == 0 else (y, x)
        a, b, m = _half(one[out], other[out], n[out], limit[out], sign)
        cut = (a, b, m) if axis == 0 else (b, a, m)
        order = np.argsort(np.concatenate([np.flatnonzero(~out), np.flatnonzero(out)]))
        x, y, n = (v[order] for v in _joined([(x[~out], y[~out], n[~out]), cut]))
    return x, y, n


def _chain(x: np.ndarray, y: np.ndarray, n: np.ndarray, limit: np.ndarray, depth: np.ndarray, first: np.ndarray, many: np.ndarray):
    """As ``halved``, of polygons that enter once: at corner ``first``, for ``many`` corners."""
    rows = np.arange(len(x))

    def crossing(out: np.ndarray, inner: np.ndarray) -> np.ndarray:
        t = depth[rows, out] / (depth[rows, out] - depth[rows, inner])
        return y[rows, out] + t * (y[rows, inner] - y[rows, out])

    k = np.arange(int(many.max()))
    at = (first[:, None] + k) % n[:, None]
    ox, oy = np.zeros((2, len(x), len(k) + 2))
    ox[:, 1:-1], oy[:, 1:-1] = np.take_along_axis(x, at, axis=1), np.take_along_axis(y, at, axis=1)
    last = (first + many - 1) % n
    ox[:, 0], oy[:, 0] = limit, crossing((first - 1) % n, first)
    ox[rows, many + 1], oy[rows, many + 1] = limit, crossing((last + 1) % n, last)
    size = many + 2
    before = np.where(np.arange(ox.shape[1]) == 0, size[:, None] - 1, np.arange(ox.shape[1]) - 1)
    new = (ox != np.take_along_axis(ox, before, axis=1)) | (oy != np.take_along_axis(oy, before, axis=1))
    new &= np.arange(ox.shape[1]) < size[:, None]
    if (new.sum(axis=1) < size).any():
        order = np.argsort(~new, axis=1, kind="stable")
        ox, oy, size = np.take_along_axis(ox, order, axis=1), np.take_along_axis(oy, order, axis=1), new.sum(axis=1)
    return ox, oy, size


def split(x: np.ndarray, y: np.ndarray, box: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parts of simple polygons in boxes, how many points each has, and whose it is; in the order of polygons and parts."""
    n, owner = np.full(len(x), x.shape[1]), np.arange(len(x))
    for axis, side, sign in ((0, 0, 1), (0, 2, -1), (1, 1, 1), (1, 3, -1)):
        if not len(x):
            break
        one, other = (x, y) if axis == 0 else (y, x)
        limit = box[side][owner]
        depth = sign * (one - limit[:, None])
        there = np.arange(x.shape[1]) < n[:, None]
        inner = (depth > 0) & there
        before = np.where(np.arange(x.shape[1]) == 0, n[:, None] - 1, np.arange(x.shape[1]) - 1)
        begins = inner & ~np.take_along_axis(inner, before, axis=1)
        many, entries = inner.sum(axis=1), begins.sum(axis=1)
        if (many == n).all():
            continue
        whole, single, several = many == n, (many < n) & (entries == 1), np.flatnonzero(entries > 1)
        parts, places = [(one[whole], other[whole], n[whole])], [(np.flatnonzero(whole), np.zeros(int(whole.sum()), np.int64))]
        if single.any():
            parts.append(_chain(one[single], other[single], n[single], limit[single], depth[single], begins[single].argmax(axis=1), many[single]))
            places.append((np.flatnonzero(single), np.zeros(int(single.sum()), np.int64)))
        for r in several.tolist():
            ring = list(zip(one[r, : n[r]].tolist(), other[r, : n[r]].tolist()))
            for k, part in enumerate(halved(ring, 0, float(limit[r]), sign)):
                parts.append((np.array([[p[0] for p in part]]), np.array([[p[1] for p in part]]), np.array([len(part)])))
                places.append((np.array([r]), np.array([k])))
        one, other, n = _joined(parts)
        row, sub = (np.concatenate(v) for v in zip(*places))
        order = np.lexsort((sub, row))
        order = order[n[order] >= 3]
        one, other, n, owner = one[order], other[order], n[order], owner[row[order]]
        x, y = (one, other) if axis == 0 else (other, one)
    return x, y, n, owner


def _listed(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> pa.Array:
    there = np.arange(x.shape[1]) < n[:, None]
    offsets = np.concatenate(([0], np.cumsum(2 * n))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.stack([x, y], axis=2)[there].ravel()))


def _tables(coords: pa.Array, w: np.ndarray, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of flat ``coords`` with as many points (three or more), and tables of their points times width and height."""
    values = coords.flatten().to_numpy(zero_copy_only=False)
    lengths = coords.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    starts, points = np.cumsum(lengths) - lengths, lengths // 2
    for size in np.unique(points[points >= 3]).tolist():
        all_rows, many = np.flatnonzero(points == size), max(1, VALUES // size)
        for begin in range(0, len(all_rows), many):
            rows = all_rows[begin : begin + many]
            at = starts[rows][:, None] + 2 * np.arange(size)
            yield rows, values[at] * w[rows][:, None], values[at + 1] * h[rows][:, None]


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def pixel_area(coords: Column, width: Column, height: Column) -> Column:
    """As ``geometry.pixel_area``, in batches: an expression over it leaves ``coords`` computed once."""

    @F.arrow_udf("double")
    def area(coords: pa.Array, w: pa.Array, h: pa.Array) -> pa.Array:
        out = np.zeros(len(coords))
        for rows, x, y in _tables(coords, _numbers(w), _numbers(h)):
            out[rows] = areas(x, y, np.full(len(rows), x.shape[1]))
        flat = coords.flatten()
        unknown = np.zeros(len(coords), bool)
        if flat.null_count or w.null_count or h.null_count:
            owner = np.repeat(np.arange(len(coords)), coords.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            unknown[owner[flat.is_null().to_numpy(zero_copy_only=False)]] = True
            unknown |= (w.is_null().to_numpy(zero_copy_only=False) | h.is_null().to_numpy(zero_copy_only=False))
        return pa.array(out, mask=unknown)

    return area(coords.cast("array<double>"), width, height)


def cut(batches: Iterator[pa.RecordBatch], t, names: Sequence[str], wanted: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows of ``coords, _w, _h`` and ``names`` by tile: ``names, tx, ty, part_no, inside`` and those of ``part`` and
    ``tile_coords`` that are ``wanted``. ``t``: a ``Tiling``."""
    step = t.width - t.overlap_px, t.height - t.overlap_px
    # what only touches a tile has no area there, which is enough only where none is asked for
    tight = t.min_viable_area > 0 and t.share >= 0

    def keeps(area: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return (inside > t.share * area) | ((inside >= t.min_viable_area) & (inside >= t.min_fraction * area))

    def span(low: np.ndarray, high: np.ndarray, size: np.ndarray, tile: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """First tile, and how many, along an axis."""
        last = np.where(size < tile, 0, np.floor((size - tile + step) / step)) - 1
        first = np.maximum(0, np.floor((low - tile) / step) + tight)
        last = np.minimum(last, np.ceil(high / step) - 1 if tight else np.floor(high / step))
        return first.astype(np.int64), np.maximum(0, last - first + 1).astype(np.int64)

    def out(batch: pa.RecordBatch, rows, tx, ty, part_no, inside, x, y, n) -> pa.RecordBatch:
        columns = [batch.column(name).take(pa.array(rows)) for name in names]
        columns += [pa.array(tx.astype(np.int32)), pa.array(ty.astype(np.int32)), pa.array(part_no.astype(np.int32)), pa.array(inside)]
        columns += [_listed(x, y, n)] if "part" in wanted else []
        columns += [_listed((x - tx[:, None]) / t.width, (y - ty[:, None]) / t.height, n)] if "tile_coords" in wanted else []
        return pa.RecordBatch.from_arrays(columns, [*names, "tx", "ty", "part_no", "inside", *(c for c in ("part", "tile_coords") if c in wanted)])

    def of(batch: pa.RecordBatch, rows: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Polygons with as many points, whose tiles are numbered through."""
        size = x.shape[1]
        bends, area = ~convex(x, y), areas(x, y, np.full(len(x), size))
        low, high = (x.min(axis=1), y.min(axis=1)), (x.max(axis=1), y.max(axis=1))
        (fx, nx), (fy, ny) = span(low[0], high[0], w, t.width, step[0]), span(low[1], high[1], h, t.height, step[1])
        ends = np.cumsum(nx * ny)
        many = max(1, VALUES // size)
        for begin in range(0, int(ends[-1]) if len(ends) else 0, many):
            at = np.arange(begin, min(begin + many, int(ends[-1])))
            r = np.searchsorted(ends, at, side="right")
            k = at - (ends[r] - nx[r] * ny[r])
            tx, ty = (fx[r] + k % nx[r]) * step[0], (fy[r] + k // nx[r]) * step[1]
            box = tx, ty, tx + t.width, ty + t.height
            gap = np.minimum(np.minimum(low[0][r] - box[0], low[1][r] - box[1]), np.minimum(box[2] - high[0][r], box[3] - high[1][r]))
            whole = np.where(bends[r], gap > 0, gap >= 0)
            kept = np.flatnonzero(whole & keeps(area[r], area[r]))
            if len(kept):
                q = r[kept]
                yield out(batch, rows[q], tx[kept], ty[kept], np.zeros(len(q)), area[q], x[q], y[q], np.full(len(q), size))
            some = np.flatnonzero(~whole & ~bends[r])
            if len(some):
                q = r[some]
                px, py, n = clipped(x[q], y[q], tuple(b[some].astype(float) for b in box))
                inside = areas(px, py, n)
                kept = np.flatnonzero(keeps(area[q], inside) & (n >= 3))
                yield out(batch, rows[q[kept]], tx[some[kept]], ty[some[kept]], np.zeros(len(kept)), inside[kept], px[kept], py[kept], n[kept])
            some = np.flatnonzero(~whole & bends[r])
            if len(some):
                q = r[some]
                px, py, n, owner = split(x[q], y[q], tuple(b[some].astype(float) for b in box))
                inside = areas(px, py, n)
                kept = np.flatnonzero(keeps(area[q], np.bincount(owner, inside, len(q)))[owner])
                part_no = np.arange(len(owner)) - np.searchsorted(owner, owner)
                own = owner[kept]
                yield out(batch, rows[q[own]], tx[some[own]], ty[some[own]], part_no[kept], inside[kept], px[kept], py[kept], n[kept])

    for batch in batches:
        w, h = (_numbers(batch.column(c)) for c in ("_w", "_h"))
        for rows, x, y in _tables(batch.column("coords"), w, h):
            x, y = np.rint(x), np.rint(y)
            good = np.isfinite(x).all(axis=1) & np.isfinite(y).all(axis=1)
            rows, x, y = rows[good], x[good], y[good]
            good = simple(x, y)
            rows, x, y = rows[good], x[good], y[good]
            yield from of(batch, rows, x, y, w[rows], h[rows])
