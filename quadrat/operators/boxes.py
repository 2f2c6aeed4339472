"""Box geometry of augmentations, range joins of boxes, region lookups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quadrat.functions import geometry as G


def flip(df: DataFrame, width: Column, height: Column, horizontal: bool = True) -> DataFrame:
    if horizontal:
        return df.withColumns({"x1": width - F.col("x2"), "x2": width - F.col("x1")})
    return df.withColumns({"y1": height - F.col("y2"), "y2": height - F.col("y1")})


def letterbox(df: DataFrame, width: Column, height: Column, to: tuple[int, int] = (640, 640), scale_up: bool = True) -> DataFrame:
    """Boxes after the image is fitted into ``to`` (height, width) and padded evenly."""
    r = F.least(to[0] / height, to[1] / width)
    r = r if scale_up else F.least(r, F.lit(1.0))
    left = F.rint((to[1] - F.rint(width * r)) / 2 - 0.1)
    top = F.rint((to[0] - F.rint(height * r)) / 2 - 0.1)
    return df.withColumns(
        {"x1": F.col("x1") * r + left, "y1": F.col("y1") * r + top, "x2": F.col("x2") * r + left, "y2": F.col("y2") * r + top}
    )


def mosaic(df: DataFrame, dx: Column, dy: Column, width: float, height: float) -> DataFrame:
    """Boxes moved to their place on a canvas, clipped to it; those without area go."""
    x = lambda c: F.least(F.greatest(F.col(c) + dx, F.lit(0.0)), F.lit(float(width)))
    y = lambda c: F.least(F.greatest(F.col(c) + dy, F.lit(0.0)), F.lit(float(height)))
    moved = df.withColumns({"x1": x("x1"), "x2": x("x2"), "y1": y("y1"), "y2": y("y2")})
    return moved.where("x1 < x2 AND y1 < y2")


def overlapping_pairs(boxes: DataFrame, key: str, by: str = "image_id") -> DataFrame:
    """Pairs of boxes of an image that meet, each once: an equality join with the overlap as its condition."""
    a = boxes.select(by, F.col(key).alias("a"), F.struct("x1", "y1", "x2", "y2").alias("_a"))
    b = boxes.select(F.col(by).alias("_by"), F.col(key).alias("b"), F.struct("x1", "y1", "x2", "y2").alias("_b"))
    return a.join(b, (F.col(by) == F.col("_by")) & (F.col("a") < F.col("b")) & G.overlaps(F.col("_a"), F.col("_b"))).select(by, "a", "b")


def low_overlap(boxes: DataFrame, others: DataFrame, key: str, most: float = 0.30, by: str = "image_id") -> DataFrame:
    """Boxes of which each other box covers less than ``most``."""
    a = boxes.select(by, key, F.struct("x1", "y1", "x2", "y2").alias("_a"))
    b = others.select(F.col(by).alias("_by"), F.col(key).alias("_key"), F.struct("x1", "y1", "x2", "y2").alias("_b"))
    cover = G.intersection_area(F.col("_a"), F.col("_b")) / G.box_area(F.col("_a"))
    on = (F.col(by) == F.col("_by")) & (F.col(key) != F.col("_key")) & G.overlaps(F.col("_a"), F.col("_b")) & (cover >= most)
    return a.join(b, on, "left_anti").select(by, key)


def in_own_windows(rois: DataFrame, images: DataFrame, windows: Callable[[DataFrame, list[str]], DataFrame], by: str = "image_id") -> DataFrame:
    """Regions with the windows of their image that contain them, in columns ``w_...``; borders count. ``windows`` makes the
    windows (``x0, y0, x1, y1`` and more) of a table of images and keeps the columns that are named beside it. It gets the
    regions with the size of their image, so only images are joined: Spark takes a table of all windows for as small as that
    of the images, and would send it to every task."""
    named = {c: f"_r_{c}" for c in rois.columns if c != by}
    rows = rois.withColumnsRenamed(named).join(images.select(by, "width", "height"), by)
    found = windows(rows, list(named.values()))
    inside = (F.col("_r_x1") >= F.col("x0")) & (F.col("_r_y1") >= F.col("y0")) & (F.col("_r_x2") <= F.col("x1")) & (F.col("_r_y2") <= F.col("y1"))
    own = [F.col(c).alias(f"w_{c}") for c in found.columns if c != by and c not in named.values()]
    return found.where(inside).select(by, *[F.col(r).alias(c) for c, r in named.items()], *own)


def class_lookup(rois: DataFrame, master: DataFrame, name: str, order: str, value: str) -> DataFrame:
    """Regions with the class of the first master row of their name, else ``Not Found``."""
    first = master.groupBy(name).agg(F.min_by(value, order).alias(value))
    return rois.join(first, name, "left").withColumn(value, F.coalesce(F.col(value).cast("string"), F.lit("Not Found")))


def windows(images: DataFrame, size: int = 3000) -> DataFrame:
    """Batch windows without overlap, clipped at the image's edge."""
    starts = lambda c: F.sequence(F.lit(0), F.col(c).cast("int") - 1, F.lit(size))
    rows = images.select("image_id", "width", "height", F.explode(starts("width")).alias("x0"))
    rows = rows.select("*", F.explode(starts("height")).alias("y0"))
    return rows.select(
        "image_id", "x0", "y0", F.least(F.col("x0") + size, F.col("width")).alias("x1"), F.least(F.col("y0") + size, F.col("height")).alias("y1")
    )


def thumbnails(df: DataFrame, rank: str, per_row: int) -> DataFrame:
    """Row and column of each item of a ranked list (from 1)."""
    at = F.col(rank) - 1
    return df.withColumns({"row": F.floor(at / per_row).cast("long"), "col": (at % per_row).cast("long")})


def transform_boxes(df: DataFrame, matrix: list[list[float]], width: float, height: float, area_thr: float = 0.1) -> DataFrame:
    """Boxes around their corners under a 3 x 3 matrix, clipped to the canvas; those that aren't usable go."""
    from quadrat.operators.filters import box_candidates

    moved = G.affine(G.box_polygon(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))), matrix)
    rows = df.withColumn("_b", G.bbox(moved))
    clip = lambda c, top: F.least(F.greatest(F.col(f"_b.{c}"), F.lit(0.0)), F.lit(float(top)))
    rows = rows.withColumns({"nx1": clip("x1", width), "ny1": clip("y1", height), "nx2": clip("x2", width), "ny2": clip("y2", height)})
    w1, h1 = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return rows.where(box_candidates(w1, h1, F.col("nx2") - F.col("nx1"), F.col("ny2") - F.col("ny1"), area_thr=area_thr)).drop("_b")


def partners(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Each sample with another one to be mixed with: the next in random order."""
    from quadrat.session import ranked_randomly

    ranks = ranked_randomly(df.select(key), seed, key, "_rn")
    total = ranks.agg(F.max("_rn").alias("_n"))
    after = ranks.select(F.col(key).alias("partner"), F.col("_rn").alias("_at"))
    joined = ranks.crossJoin(F.broadcast(total)).join(after, (F.col("_rn") % F.col("_n")) + 1 == F.col("_at"))  # one row
    return joined.select(key, "partner")


def formatted(df: DataFrame, width: float, height: float) -> DataFrame:
    """Centre, width and height as fractions of the image."""
    return df.withColumns(
        {
            "xc": (F.col("x1") + F.col("x2")) / 2 / width, "yc": (F.col("y1") + F.col("y2")) / 2 / height,
            "bw": (F.col("x2") - F.col("x1")) / width, "bh": (F.col("y2") - F.col("y1")) / height,
        }
    )


def class_texts(df: DataFrame, by: str, classes: list[str], most: int, seed: int) -> DataFrame:
    """``texts`` of each sample: its own classes and, up to ``most``, others in a random order of its own; ``labels``
    are places in it; own classes beyond ``most`` are in neither."""
    rows = df.groupBy(by).agg(F.sort_array(F.collect_set("class_id")).alias("own"))
    others = F.filter(F.sequence(F.lit(0), F.lit(len(classes) - 1)), lambda c: ~F.array_contains("own", c))
    order = F.transform(
        F.array_sort(F.transform(others, lambda c: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(by).cast("string"), c.cast("string")).cast("binary")).alias("o"), c.alias("c")))),
        lambda s: s["c"],
    )
    kept = F.slice(F.concat("own", order), 1, most)
    names = F.array(*map(F.lit, classes))
    shown = F.filter("own", lambda c: F.array_contains("kept", c))
    return rows.select(by, "own", kept.alias("kept")).select(
        by, F.transform("kept", lambda c: F.get(names, c)).alias("texts"),
        F.transform(shown, lambda c: (F.array_position("kept", c) - 1).cast("int")).alias("labels"),
    )


def mixed(labels: DataFrame, partners_: DataFrame, key: str) -> DataFrame:
    """The labels of each sample and of its partner."""
    own = labels.join(partners_.select(key), key, "left_semi")
    other = labels.join(partners_.select(F.col("partner").alias(key), F.col(key).alias("_own")), key)
    return own.unionByName(other.withColumn(key, F.col("_own")).drop("_own").select(*own.columns))


def layers(labels: DataFrame, area: str, ties: list[str], by: str = "image_id") -> DataFrame:
    """``layer`` from 1: larger labels of an image lie below smaller ones. Labels of an image are few."""
    return labels.withColumn("layer", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(area), *ties)))
