"""Places of images and boxes in mosaics, crops and slices: arithmetic on columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _case(place: Column, values: list[Column]) -> Column:
    return F.coalesce(*[F.when(place == i, v) for i, v in enumerate(values)])


def mosaic4(images: DataFrame, size: int, xc: int, yc: int) -> DataFrame:
    """Places of four images (place 0 to 3, width, height) around a centre of a canvas of 2 x ``size``: the part of the
    canvas ``ax1 ... ay2`` and what labels move by, ``dx, dy``."""
    w, h, p = F.col("width"), F.col("height"), F.col("place")
    zero, full = F.lit(0), F.lit(2 * size)
    left, right = F.greatest(F.lit(xc) - w, zero), F.least(F.lit(xc) + w, full)
    top, bottom = F.greatest(F.lit(yc) - h, zero), F.least(F.lit(yc) + h, full)
    x, y = F.lit(xc), F.lit(yc)
    out = images.withColumns(
        {
            "ax1": _case(p, [left, x, left, x]), "ay1": _case(p, [top, top, y, y]),
            "ax2": _case(p, [x, right, x, right]), "ay2": _case(p, [y, y, bottom, bottom]),
        }
    )
    # the part of the image that is seen begins at its far corner where the image is left of or above the centre
    bx = _case(p, [w - (x - left), zero, w - (x - left), zero])
    by = _case(p, [h - (y - top), h - (y - top), zero, zero])
    return out.withColumns({"dx": F.col("ax1") - bx, "dy": F.col("ay1") - by})


def mosaic9(images: DataFrame, size: int, by: str = "mosaic") -> DataFrame:
    """Places of up to nine images (place 0 to 8: the centre, then clockwise from the top; the first three of the row
    form are places 0, 3 and 7) on a canvas of 3 x ``size``: ``dx, dy`` that labels move by and the canvas part
    ``ax1 ... ay2``. Each image is set against the one before it."""
    p, w, h, s = F.col("place"), F.col("width"), F.col("height"), F.lit(size)
    order = Window.partitionBy(by).orderBy("place")
    whole = Window.partitionBy(by)
    first = lambda c: F.max(F.when(p == 0, F.col(c))).over(whole)
    rows = images.withColumns({"_w0": first("width"), "_h0": first("height"), "_wp": F.lag("width").over(order), "_hp": F.lag("height").over(order)})
    w0, h0, wp, hp = (F.col(c) for c in ("_w0", "_h0", "_wp", "_hp"))
    dx = _case(p, [s, s, s + wp, s + w0, s + w0, s + w0 - w, s + w0 - wp - w, s - w, s - w])
    dy = _case(p, [s, s - h, s - h, s, s + hp, s + h0, s + h0, s + h0 - h, s + h0 - hp - h])
    right = _case(p, [s + w, s + w, s + wp + w, s + w0 + w, s + w0 + w, s + w0, s + w0 - wp, s, s])
    bottom = _case(p, [s + h, s, s, s + h, s + hp + h, s + h0 + h, s + h0 + h, s + h0, s + h0 - hp])
    out = rows.withColumns({"dx": dx, "dy": dy, "_r": right, "_b": bottom})
    inside = lambda c: F.greatest(F.col(c), F.lit(0))
    placed = out.withColumns({"ax1": inside("dx"), "ay1": inside("dy"), "ax2": inside("_r"), "ay2": inside("_b")})
    return placed.drop("_w0", "_h0", "_wp", "_hp", "_r", "_b")


def centre_crop(df: DataFrame, width: Column, height: Column, size: int) -> DataFrame:
    """Boxes after the largest centred square is cut out and scaled to ``size``; those outside go."""
    m = F.least(width, height)
    left, top = F.floor((width - m) / 2), F.floor((height - m) / 2)
    cut = lambda c, start: F.least(F.greatest(F.col(c) - start, F.lit(0.0)), m.cast("double")) * (size / m)
    moved = df.withColumns({"x1": cut("x1", left), "x2": cut("x2", left), "y1": cut("y1", top), "y2": cut("y2", top)})
    return moved.where("x1 < x2 AND y1 < y2")


def slices(images: DataFrame, size: int = 640, overlap: float = 0.5, keep: Sequence[str] = ()) -> DataFrame:
    """Overlapping windows ``x0, y0, x1, y1``; the last of a row ends at the edge. ``keep``: columns of the images that
    stay."""
    step = size - int(overlap * size)

    def starts(c: str) -> Column:
        edge = F.greatest(F.col(c).cast("int") - size, F.lit(0))
        n = F.ceil(edge / step).cast("int")
        return F.transform(F.sequence(F.lit(0), n), lambda i: F.least(i * step, edge))

    rows = images.select("image_id", *keep, "width", "height", F.explode(starts("width")).alias("x0"))
    rows = rows.select("*", F.explode(starts("height")).alias("y0"))
    far = lambda start, c: F.least(F.col(start) + size, F.col(c)).cast("int")
    return rows.select("image_id", *keep, "x0", "y0", far("x0", "width").alias("x1"), far("y0", "height").alias("y1"))


def from_slices(found: DataFrame) -> DataFrame:
    """Boxes found inside windows (``x0, y0`` is the window's corner) in coordinates of the image."""
    return found.withColumns({c: F.col(c) + F.col(f"{c[0]}0") for c in ("x1", "y1", "x2", "y2")})


def copy_paste(boxes: DataFrame, others: DataFrame, key: str, share: float, most: float = 0.30, by: str = "image_id") -> DataFrame:
    """``by, key, overlap``: of the boxes that cover less than ``most`` of every other box, the part ``share`` (rounded
    half to even) that overlaps least. Boxes of an image are few."""
    a = boxes.select(by, F.col(key), F.col("x1").alias("a1"), F.col("y1").alias("b1"), F.col("x2").alias("a2"), F.col("y2").alias("b2"))
    b = others.select(F.col(by).alias("_by"), "x1", "y1", "x2", "y2")
    meets = (F.col(by) == F.col("_by")) & (F.col("a1") < F.col("x2")) & (F.col("x1") < F.col("a2")) & (F.col("b1") < F.col("y2")) & (F.col("y1") < F.col("b2"))
    inter = (F.least("a2", "x2") - F.greatest("a1", "x1")) * (F.least("b2", "y2") - F.greatest("b1", "y1"))
    cover = inter / ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    most_of = a.join(b, meets).select(by, key, cover.alias("c")).groupBy(by, key).agg(F.max("c").alias("overlap"))
    rows = a.select(by, key).distinct().join(most_of, [by, key], "left").fillna(0.0, ["overlap"]).where(F.col("overlap") < most)
    at = F.row_number().over(Window.partitionBy(by).orderBy("overlap", key))
    n = F.count("*").over(Window.partitionBy(by))
    return rows.withColumns({"_at": at, "_n": n}).where(F.col("_at") <= F.rint(F.col("_n") * share)).drop("_at", "_n")


def mosaic3(images: DataFrame, size: int, by: str = "mosaic") -> DataFrame:
    """Places of three images in a row (place 0 to 2: the centre, right, left) on a canvas of 3 x ``size``: ``dx, dy`` that
    labels move by and the canvas part ``ax1 ... ay2``."""
    p, w, h, s = F.col("place"), F.col("width"), F.col("height"), F.lit(size)
    whole = Window.partitionBy(by)
    first = lambda c: F.max(F.when(p == 0, F.col(c))).over(whole)
    rows = images.withColumns({"_w0": first("width"), "_h0": first("height")})
    w0, h0 = F.col("_w0"), F.col("_h0")
    placed = rows.withColumns({"dx": _case(p, [s, s + w0, s - w]), "dy": _case(p, [s, s, s + h0 - h])})
    ends = {"ax2": _case(p, [s + w, s + w0 + w, s]), "ay2": _case(p, [s + h, s + h, s + h0])}
    starts = {f"a{c}1": F.greatest(F.col(f"d{c}"), F.lit(0)) for c in "xy"}
    return placed.withColumns({**starts, **{k: F.greatest(v, F.lit(0)) for k, v in ends.items()}}).drop("_w0", "_h0")
