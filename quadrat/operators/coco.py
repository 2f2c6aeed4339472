"""COCO tables: repair, merge, numbering, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions import names
from quadrat.session import ranked, ranked_by_key, stored


def valid(bbox: Column, segmentation: Column) -> Column:
    """A box and a segmentation that aren't empty."""
    return (F.coalesce(F.size(bbox), F.lit(0)) > 0) & (F.coalesce(F.size(segmentation), F.lit(0)) > 0)


def repair(annotations: DataFrame) -> DataFrame:
    return annotations.where(valid(F.col("bbox"), F.col("segmentation")))


def validity(annotations: DataFrame) -> DataFrame:
    ok = valid(F.col("bbox"), F.col("segmentation"))
    return annotations.agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


def with_extent(annotations: DataFrame) -> DataFrame:
    """Boxes [x, y, w, h] with width and height over 0."""
    return annotations.where((F.get("bbox", F.lit(2)) > 0) & (F.get("bbox", F.lit(3)) > 0))


def all_parts(segmentation: Column) -> Column:
    """Whether there are parts and none is empty."""
    return (F.size(segmentation) > 0) & F.forall(segmentation, lambda s: F.size(s) > 0)


def segmentation_or_box(segmentation: Column, box: Column) -> Column:
    """Polygons if usable, else the box's corners; null if there is neither."""
    corners = F.array(F.array(*[box[c] for c in ("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")]))
    return F.when(segmentation.isNull() | (F.size(segmentation) == 0), F.when(box.isNotNull(), corners)).when(all_parts(segmentation), segmentation)


def merge_categories(base: DataFrame, extra: DataFrame) -> DataFrame:
    """``id, name, base_id, extra_id``: union by name, numbered from 1, base first. Categories are few."""
    both = base.select("name", F.col("id").alias("base_id"), F.lit(None).cast("long").alias("extra_id"), F.lit(0).alias("side"), F.col("id").alias("o"))
    both = both.unionByName(extra.select("name", F.lit(None).cast("long").alias("base_id"), F.col("id").alias("extra_id"), F.lit(1).alias("side"), F.col("id").alias("o")))
    named = both.groupBy("name").agg(
        F.min(F.struct("side", "o")).alias("first"), F.max("base_id").alias("base_id"), F.max("extra_id").alias("extra_id")
    )
    return ranked(named, [F.col("first")], F.col("first.side"), "id").select(F.col("id").cast("long"), "name", "base_id", "extra_id")


def merge(
    base_images: DataFrame, base_anns: DataFrame, extra_images: DataFrame, extra_anns: DataFrame, categories: DataFrame,
    keep_base_categories: bool = False,
) -> DataFrame:
    """Annotations of the base's images: those of the other set where it has the image (by file name) with at least one
    annotation, else the base's; categories renumbered, ids from 1 by image and annotation."""
    names_of = lambda d: d.withColumn("_name", names.basename(F.col("file_name")))
    extra_by_name = names_of(extra_images).groupBy("_name").agg(F.max("id").alias("_extra"))
    common = names_of(base_images).select(F.col("id").alias("image_id"), "_name").join(extra_by_name, "_name")
    cats = stored(categories)
    theirs = stored(
        extra_anns.join(common.select("_extra", F.col("image_id").alias("_own")), extra_anns["image_id"] == F.col("_extra"))
        .withColumn("image_id", F.col("_own")).drop("_own", "_extra")
        .join(cats.select(F.col("extra_id").alias("category_id"), F.col("id").alias("_cat")), "category_id")
        .withColumn("category_id", F.col("_cat")).drop("_cat")
    )
    ours = base_anns.join(base_images.select(F.col("id").alias("image_id")), "image_id", "left_semi").join(
        theirs.select("image_id").distinct(), "image_id", "left_anti"
    )
    if not keep_base_categories:
        ours = ours.join(cats.select(F.col("base_id").alias("category_id"), F.col("id").alias("_cat")), "category_id").withColumn(
            "category_id", F.col("_cat")
        ).drop("_cat")
    both = ours.withColumn("side", F.lit("base")).unionByName(theirs.withColumn("side", F.lit("extra")))
    return ranked_by_key(both, "image_id", "new_id", ["id"])


def statistics(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    def one(d: DataFrame, name: str) -> DataFrame:
        return d.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")

    return one(images, "images").unionByName(one(annotations, "annotations")).unionByName(one(categories, "categories"))


def from_predictions(preds: DataFrame, names_to_ids: dict[str, int]) -> DataFrame:
    """Annotations of predictions (image_id, class_name, conf, box, polygon): boxes without extent and broken polygons go,
    unknown names are 1, ids from 1."""
    known = F.create_map(*[F.lit(x) for kv in names_to_ids.items() for x in kv])
    box = F.col("box")
    rows = preds.where((box["x2"] > box["x1"]) & (box["y2"] > box["y1"])).select(
        "image_id", F.coalesce(F.element_at(known, F.col("class_name")), F.lit(1)).alias("category_id"),
        F.array(box["x1"], box["y1"], box["x2"] - box["x1"], box["y2"] - box["y1"]).alias("bbox"),
        ((box["x2"] - box["x1"]) * (box["y2"] - box["y1"])).alias("area"),
        segmentation_or_box(F.col("polygon"), box).alias("segmentation"), F.lit(0).alias("iscrowd"), "conf",
    )
    rows = rows.where(F.col("segmentation").isNotNull())
    rows = rows.withColumn("_o", -F.col("conf"))
    return ranked_by_key(rows, "image_id", "id", ["_o", "bbox"]).drop("_o")
