"""Listings, label files, annotation documents, logs: everything by Spark's readers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import names as N
from quadrat.operators import folders

IMAGES = ("jpg", "jpeg", "png", "bmp")


def listing(spark: SparkSession, path: str | list[str], extensions: tuple[str, ...] = IMAGES, recursive: bool = True, any_case: bool = False) -> DataFrame:
    """``path, length, modified`` of files; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if not any_case:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    rows = reader.load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    return rows.where(N.extension(F.col("path")).isin([e.lower().lstrip(".") for e in extensions])) if any_case else rows


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """``archive, name, content`` of the files in archives, one archive at a time in a task."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, data in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(data)) as found:
                    for info in found.infolist():
                        if not info.is_dir():
                            yield pd.DataFrame({"archive": [archive], "name": [info.filename], "content": [found.read(info)]})

    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    return rows.mapInPandas(unpack, "archive string, name string, content binary")


def with_empty(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``path, length`` of a listing and of its files without a byte. Readers give no row for those; the index, which is
    on the driver anyway, has them."""
    plain = F.regexp_replace("path", "^file:/+", "file:/")
    listed = spark.createDataFrame([(f,) for f in rows.inputFiles()], "path string").select(plain.alias("path"))
    return listed.join(rows.select(plain.alias("path"), "length"), "path", "left").fillna(0, ["length"])


def images(spark: SparkSession, path: str) -> DataFrame:
    """``path, height, width`` of images that can be decoded."""
    rows = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", "true").load(path)
    return rows.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"))


def _tokens(line: Column) -> Column:
    return F.filter(F.split(F.trim(line), r"\s+"), lambda t: t != "")


def label_lines(spark: SparkSession, path: str | list[str], min_tokens: int = 9, strict: bool = True) -> DataFrame:
    """``path, stem, class_id, coords, raw`` of label lines with enough tokens. ``strict`` drops every line of a file
    that has one that can't be read, else only that line."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"), _tokens(F.col("value")).alias("t"))
    rows = rows.withColumns(
        {
            "class_id": F.expr("try_cast(get(t, 0) AS int)"),
            "coords": F.expr("transform(slice(t, 2, greatest(size(t) - 1, 0)), x -> try_cast(x AS double))"),
        }
    )
    bad = (F.size("t") > 0) & (F.col("class_id").isNull() | F.exists("coords", lambda c: c.isNull()))
    if strict:
        broken = rows.where(bad).select("path").distinct()
        rows = rows.join(broken, "path", "left_anti")
    else:
        rows = rows.where(~bad)
    return rows.where(F.size("t") >= min_tokens).select("path", N.stem(F.col("path")).alias("stem"), "class_id", "coords", "raw")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Label lines as boxes (5 tokens) or polygons (more, three points at least); shorter ones go."""
    rows = label_lines(spark, path, 5, strict=False)
    n = F.size("coords")
    return rows.withColumn("kind", F.when(n == 4, "box").otherwise("polygon")).where((n == 4) | (n >= 6))


def label_states(spark: SparkSession, image_path: str, label_path: str) -> DataFrame:
    """``stem, state`` of images."""
    found = listing(spark, image_path).select(N.stem(F.col("path")).alias("stem")).distinct()
    sizes = with_empty(spark, listing(spark, label_path, ("txt",))).select(N.stem(F.col("path")).alias("stem"), "length")
    state = F.when(F.col("length") > 0, "non_empty").when(F.col("length") == 0, "empty").otherwise("missing")
    return found.join(sizes, "stem", "left").select("stem", state.alias("state"))


def pairs(spark: SparkSession, image_path: str, label_path: str, positional: bool = False) -> DataFrame:
    """``image_path, label_path`` by stem; ``positional`` pairs the i-th of both in order of name instead."""
    a = listing(spark, image_path).select(F.col("path").alias("image_path"))
    b = with_empty(spark, listing(spark, label_path, ("txt",))).select(F.col("path").alias("label_path"))
    return folders.pairs(a, b, positional)


COCO = (
    "info struct<description:string,date_created:string>, images array<struct<id:bigint,file_name:string,width:int,height:int>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,area:double,"
    "segmentation:array<array<double>>,iscrowd:int>>, categories array<struct<id:bigint,name:string>>"
)


def coco(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The images, annotations and categories of COCO documents."""
    doc = spark.read.schema(COCO).json(path, multiLine=True)
    return {k: doc.select(F.inline(k)) for k in ("images", "annotations", "categories")}


CVAT = (
    "_id bigint, _name string, _width int, _height int, polygon array<struct<_label:string,_points:string>>, "
    "mask array<struct<_label:string,_rle:string,_left:int,_top:int,_width:int,_height:int>>, "
    "box array<struct<_label:string,_xtl:double,_ytl:double,_xbr:double,_ybr:double>>"
)


def cvat(spark: SparkSession, path: str) -> DataFrame:
    """A row for each image of annotation documents, with its polygons, masks and boxes."""
    rows = spark.read.schema(CVAT).format("xml").option("rowTag", "image").load(path)
    return rows.select(
        F.col("_id").alias("id"), F.col("_name").alias("name"), F.col("_width").alias("width"), F.col("_height").alias("height"),
        "polygon", "mask", "box",
    )


def cvat_polygons(images_: DataFrame) -> DataFrame:
    """``id, name, label, coords`` of polygons."""
    rows = images_.select("id", "name", F.explode("polygon").alias("p"))
    coords = F.transform(F.filter(F.split(F.col("p._points"), "[;,]"), lambda c: c != ""), lambda c: c.cast("double"))
    return rows.select("id", "name", F.col("p._label").alias("label"), coords.alias("coords"))


def rois(spark: SparkSession, path: str) -> DataFrame:
    """Region tables, tab-separated; coordinate cells may hold lines."""
    return spark.read.csv(path, sep="\t", header=True, multiLine=True, quote='"', inferSchema=False)


def training_log(spark: SparkSession, path: str) -> DataFrame:
    """Logs of training runs; blanks around column names go."""
    rows = spark.read.csv(path, header=True, inferSchema=True)
    return rows.toDF(*[c.strip() for c in rows.columns])


def results(spark: SparkSession, files: list[str], columns: list[str]) -> DataFrame:
    """Some columns of result files; files that lack one are left out, and it is an error if all do."""
    out = None
    for f in files:  # one small file a run
        rows = spark.read.csv(f, header=True, inferSchema=True)
        if set(columns) <= set(rows.columns):
            out = rows.select(*columns) if out is None else out.unionByName(rows.select(*columns))
    if out is None:
        raise ValueError("no file has all columns")
    return out


def train_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("rel_path")).where("rel_path <> ''")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def cvat_masks(spark: SparkSession, path: str) -> DataFrame:
    """``image_id, name, label, left, top, width, height, runs`` of the masks of a CVAT document."""
    kind = "array<struct<_label: string, _rle: string, _left: bigint, _top: bigint, _width: bigint, _height: bigint>>"
    rows = spark.read.format("xml").option("rowTag", "image").schema(f"_id bigint, _name string, mask {kind}").load(path)
    flat = rows.select(F.col("_id").alias("image_id"), F.col("_name").alias("name"), F.explode("mask").alias("m"))
    runs = F.transform(F.split("m._rle", r"\s*,\s*"), lambda r: r.cast("long")).alias("runs")
    return flat.select("image_id", "name", *[F.col(f"m._{c}").alias(c) for c in ("label", "left", "top", "width", "height")], runs)
