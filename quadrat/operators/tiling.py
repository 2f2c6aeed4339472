"""Tiles of images and the labels in them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions import cuts
from quadrat.functions import geometry as G


@dataclass(frozen=True)
class Tiling:
    """Tile size, overlap as a share, and what makes a label part of a tile."""

    width: int = 640
    height: int = 640
    overlap: float = 0.5
    share: float = 0.5
    min_viable_area: float = 20.0
    min_fraction: float = 0.1
    full_cover: bool = False

    @property
    def overlap_px(self) -> int:
        return round((self.height + self.width) / 2 * self.overlap)

    def count(self, size: Column, tile: int) -> Column:
        """Tiles along an axis: none if the image is smaller; the last pixels short of a step stay uncovered."""
        step = tile - self.overlap_px
        return F.when(size < tile, F.lit(0)).otherwise(F.floor((size - tile + step) / step)).cast("int")

    def estimate(self, size: Column, tile: int) -> Column:
        """The rougher number that output folders are planned with."""
        step = tile - self.overlap_px
        return F.floor((size + step - 1) / step).cast("long")


def _starts(size: Column, tile: int, t: Tiling) -> Column:
    step, n = tile - t.overlap_px, t.count(size, tile)
    starts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * step)
    if t.full_cover:
        edge = (size - tile).cast("int")
        starts = F.when(edge % step > 0, F.concat(starts, F.array(edge))).otherwise(starts)
    return F.when(n > 0, starts).otherwise(F.array().cast("array<int>"))


def tiles(images: DataFrame, t: Tiling = Tiling(), keep: Sequence[str] = ()) -> DataFrame:
    """``image_id, x0, x1, y0, y1`` of every tile. ``keep``: columns of the images that stay."""
    xs = images.select("image_id", *keep, "height", F.explode(_starts(F.col("width"), t.width, t)).alias("x0"))
    both = xs.select("image_id", *keep, "x0", F.explode(_starts(F.col("height"), t.height, t)).alias("y0"))
    return both.select(
        "image_id", *keep, "x0", (F.col("x0") + t.width).alias("x1"), "y0", (F.col("y0") + t.height).alias("y1")
    )


def tile_estimate(images: DataFrame, t: Tiling = Tiling()) -> DataFrame:
    nx, ny = t.estimate(F.col("width"), t.width), t.estimate(F.col("height"), t.height)
    return images.select("image_id", nx.alias("nx"), ny.alias("ny"), (nx * ny).alias("n"))


def segments(images: DataFrame, n: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """An n x n grid; pixels that don't divide are left out. ``keep``: columns of the images that stay."""
    w, h = F.floor(F.col("width") / n).cast("long"), F.floor(F.col("height") / n).cast("long")
    grid = images.select(
        "image_id", *keep, w.alias("w"), h.alias("h"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("row")
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("col"))
    return grid.select(
        "image_id", *keep, "row", "col", (F.col("col") * F.col("w")).alias("x0"), (F.col("row") * F.col("h")).alias("y0"),
        ((F.col("col") + 1) * F.col("w")).alias("x1"), ((F.col("row") + 1) * F.col("h")).alias("y1"),
    )


def candidate_tiles(labels: DataFrame, images: DataFrame, t: Tiling = Tiling()) -> DataFrame:
    """Each label with the tiles that its box (x1, y1, x2, y2, pixels) meets. The tiles are computed from the box, so
    the join is on the image alone and a label brings as many rows as it has tiles."""

    def span(low: Column, high: Column, size: Column, tile: int) -> Column:
        step = tile - t.overlap_px
        first = F.greatest(F.lit(0), F.floor((low - tile) / step).cast("int"))
        last = F.least(t.count(size, tile) - 1, F.floor(high / step).cast("int"))
        return F.when(first <= last, F.transform(F.sequence(first, F.greatest(first, last)), lambda i: i * step)).otherwise(
            F.array().cast("array<int>")
        )

    joined = labels.join(images.select("image_id", "width", "height"), "image_id")
    out = joined.withColumn("tx", F.explode(span(F.col("x1"), F.col("x2"), F.col("width"), t.width))).withColumn(
        "ty", F.explode(span(F.col("y1"), F.col("y2"), F.col("height"), t.height))
    )
    return out


def keeps(area: Column, inside: Column, t: Tiling = Tiling()) -> Column:
    """Whether the part of a label inside a tile is enough of it."""
    return (inside > t.share * area) | ((inside >= t.min_viable_area) & (inside >= t.min_fraction * area))


def tile_boxes(labels: DataFrame, images: DataFrame, t: Tiling = Tiling()) -> DataFrame:
    """Box labels by tile, cut to it, with pixel coordinates and fractions of the tile."""
    c = candidate_tiles(labels, images, t)
    box = {k: F.col(k) for k in ("x1", "y1", "x2", "y2")}
    x, y = F.col("tx").cast("double"), F.col("ty").cast("double")
    tile = {"x1": x, "y1": y, "x2": x + t.width, "y2": y + t.height}
    cut = {
        "cx1": F.greatest(box["x1"], tile["x1"]), "cy1": F.greatest(box["y1"], tile["y1"]),
        "cx2": F.least(box["x2"], tile["x2"]), "cy2": F.least(box["y2"], tile["y2"]),
    }
    out = c.withColumns(cut).where("cx1 < cx2 AND cy1 < cy2")
    out = out.withColumn("inside", (F.col("cx2") - F.col("cx1")) * (F.col("cy2") - F.col("cy1")))
    out = out.where(keeps(G.box_area(box), F.col("inside"), t)).drop("inside")
    return out.withColumns(
        {
            "nx1": (F.col("cx1") - F.col("tx")) / t.width, "ny1": (F.col("cy1") - F.col("ty")) / t.height,
            "nx2": (F.col("cx2") - F.col("tx")) / t.width, "ny2": (F.col("cy2") - F.col("ty")) / t.height,
        }
    )


def tile_polygons(
    labels: DataFrame, images: DataFrame, t: Tiling = Tiling(), wanted: Sequence[str] = ("part", "tile_coords")
) -> DataFrame:
    """Polygon labels (``coords``, fractions of the image) by tile: vertices in whole pixels, cut to the tile. A concave
    polygon may fall into parts, each a row of its own (``part_no`` from 0); whether enough of it lies in the tile is judged
    by all of them. Polygons that cross themselves or have a value that is no finite number are in no tile.

    The columns of ``labels`` but ``coords``, then ``tx, ty, part_no``, the part's area ``inside`` and, as far as ``wanted``,
    its pixels ``part`` and fractions of the tile ``tile_coords``. Cut in numpy, batch by batch (``functions.cuts``)."""
    image = images.select("image_id", F.col("width").alias("_w"), F.col("height").alias("_h"))
    names = [c for c in labels.columns if c != "coords"]
    rows = labels.join(image, "image_id").select(*names, F.col("coords").cast("array<double>").alias("coords"), "_w", "_h")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema]
    kinds += ["tx int", "ty int", "part_no int", "inside double", *(f"{c} array<double>" for c in ("part", "tile_coords") if c in wanted)]
    return rows.mapInArrow(lambda batches: cuts.cut(batches, t, names, wanted), ", ".join(kinds))
