"""Writers: label files, COCO and CVAT documents, region and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions import names as N


def label_table(labels: DataFrame, by: list[str]) -> DataFrame:
    """``by``, ``text``: the label file of each image or tile; groups without a line don't appear."""
    line = N.label_text(F.col("class_id"), F.col("coords"))
    return labels.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))


def write_labels(labels: DataFrame, path: str, by: str = "stem") -> None:
    """One folder for each image with its lines as a text file; lines of an image are written by one task."""
    line = N.label_text(F.col("class_id"), F.col("coords"))
    labels.select(by, line.alias("value")).repartition(by).write.mode("overwrite").partitionBy(by).text(path)


def predictions_text(preds: DataFrame, path: str, boxes: bool = False) -> None:
    """``class x y ... conf`` lines, or ``x1 y1 x2 y2 class conf``."""
    coords = [F.col(c).cast("string") for c in ("x1", "y1", "x2", "y2")]
    if boxes:
        line = F.concat_ws(" ", *coords, F.col("class_id").cast("string"), F.col("conf").cast("string"))
    else:
        line = F.concat_ws(" ", N.label_text(F.col("class_id"), F.col("coords")), F.col("conf").cast("string"))
    preds.select(line.alias("value")).write.mode("overwrite").text(path)


def write_coco(
    images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str, tables: bool = True, description: str = "", licence: str = ""
) -> None:
    """Three tables, the form that scales; or one document, for a set that fits a task."""
    if tables:
        for name, df in (("images", images), ("annotations", annotations), ("categories", categories)):
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        return

    def listed(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))

    doc = listed(images, "images").crossJoin(listed(annotations, "annotations")).crossJoin(listed(categories, "categories"))  # one row each
    info = F.struct(F.lit(description).alias("description"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("date_created"))
    licences = F.array(F.struct(F.lit(1).alias("id"), F.lit(licence).alias("name"))).alias("licenses")
    doc.select(F.to_json(F.struct(info.alias("info"), licences, "images", "annotations", "categories")).alias("value")).coalesce(1).write.mode(
        "overwrite"
    ).text(path)


def cvat_points(labels: DataFrame) -> DataFrame:
    """``points`` attribute of polygons; points with a zero coordinate are left out."""
    flat = F.col("coords")
    points = F.transform(
        F.filter(F.sequence(F.lit(0), (F.size(flat) / 2).cast("int") - 1), lambda i: (F.get(flat, 2 * i) != 0) & (F.get(flat, 2 * i + 1) != 0)),
        lambda i: F.format_string("%.2f,%.2f", F.get(flat, 2 * i), F.get(flat, 2 * i + 1)),
    )
    return labels.withColumn("points", F.array_join(points, ";"))


def write_cvat(labels: DataFrame, path: str) -> None:
    """``image`` elements with ``polygon`` children."""
    polygon = F.struct(F.col("label").alias("_label"), F.col("points").alias("_points"))
    rows = cvat_points(labels).groupBy("image_id", "name", "width", "height").agg(F.collect_list(polygon).alias("polygon"))
    rows = rows.select(
        F.col("image_id").alias("_id"), F.col("name").alias("_name"), F.col("width").alias("_width"), F.col("height").alias("_height"), "polygon"
    )
    rows.write.mode("overwrite").format("xml").option("rootTag", "annotations").option("rowTag", "image").save(path)


def write_rois(rois: DataFrame, path: str) -> None:
    rois.write.mode("overwrite").csv(path, sep="\t", header=True)


def append_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").csv(path, header=True)


def tiled_manifest(tiles: DataFrame) -> DataFrame:
    """``split, folders`` of tile folders: by the first part of the folder's name."""
    folder = F.element_at(F.split("path", "/"), -3)
    split = F.substring_index(folder, "_", 1)
    return tiles.groupBy(split.alias("split")).agg(F.sort_array(F.collect_set(F.concat(folder, F.lit("/images")))).alias("folders"))


def copy_plan(images: DataFrame, root: str, to: str) -> DataFrame:
    """``src, dst`` of image and label files, relative paths kept: tables refer to files instead of copying them."""
    both = images.select(F.explode(F.array("image_path", N.label_path(F.col("image_path")))).alias("src"))
    return both.select("src", F.concat(F.lit(to), F.substring(F.col("src"), F.lit(len(root) + 1), F.length("src"))).alias("dst"))


def write_table(rows: DataFrame, path: str) -> None:
    """Metrics, details, summaries or lists of names as delimited text with a header."""
    rows.write.mode("overwrite").csv(path, header=True)


def write_cvat_masks(masks: DataFrame, path: str) -> None:
    """``image`` elements with ``mask`` children. ``masks``: image_id, name, label, left, top, width, height (of the mask) and
    ``runs``, its run lengths."""
    mask = F.struct(
        F.col("label").alias("_label"), F.lit("semi-auto").alias("_source"), F.lit(0).alias("_occluded"),
        F.array_join(F.col("runs").cast("array<string>"), ", ").alias("_rle"), *[F.col(c).alias(f"_{c}") for c in ("left", "top", "width", "height")],
        F.lit(0).alias("_z_order"),
    )
    rows = masks.groupBy("image_id", "name").agg(F.collect_list(mask).alias("mask"))
    rows = rows.select(F.col("image_id").alias("_id"), F.col("name").alias("_name"), "mask")
    rows.write.mode("overwrite").format("xml").option("rootTag", "annotations").option("rowTag", "image").save(path)
