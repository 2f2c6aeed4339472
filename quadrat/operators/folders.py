"""Tables of paths: probing, selection, renaming, walking, merging. Files are rows; nothing is copied or moved."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions import names as N

# The extensions that are tried for a label's image, in order.
PROBED = ("jpg", "jpeg", "png", "bmp")
#: File kinds that a tree leaves out, but for the list of training images.
UNSEEN = ("jpg", "jpeg", "png", "gif", "bmp", "txt")


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def images_of_labels(labels: DataFrame, images: DataFrame) -> DataFrame:
    """``label_path, image_path``: the image of each label file, in the folder called images instead of labels; of
    several the first in the order of ``PROBED``. Null where there is none."""
    key = F.concat(F.regexp_replace(folder(F.col("label_path")), "labels", "images"), F.lit("/"), N.stem(F.col("label_path")))
    found = images.select(
        F.concat(folder(F.col("image_path")), F.lit("/"), N.stem(F.col("image_path"))).alias("_key"), "image_path",
        F.array_position(F.array(*map(F.lit, PROBED)), F.regexp_extract("image_path", r"\.([^./]+)$", 1)).alias("_rank"),
    ).where("_rank > 0")
    first = found.groupBy("_key").agg(F.min_by("image_path", "_rank").alias("image_path"))
    return labels.select("label_path", key.alias("_key")).join(first, "_key", "left").select("label_path", "image_path")


def pairs(images: DataFrame, labels: DataFrame, positional: bool = False) -> DataFrame:
    """``image_path, label_path`` by stem; ``positional`` pairs the i-th of both in order of name instead."""
    if not positional:
        named = lambda df, c: df.select(c, N.stem(F.col(c)).alias("_stem"))
        return named(images, "image_path").join(named(labels, "label_path"), "_stem").drop("_stem")
    from quadrat.session import ranked_by_key

    order = lambda df, c: ranked_by_key(df.select(c), c, "_rn")
    return order(images, "image_path").join(order(labels, "label_path"), "_rn").drop("_rn")


def named_like(df: DataFrame, column: str, prefix: str, species: str, tile: str, index: str) -> DataFrame:
    """Files of one specimen over time: ``df`` with ``week``."""
    pattern = rf"^{prefix}_{species}_.+_(\d{{8}})_w(\d+)_({tile})_({index})\.jpg"
    return df.where(F.col(column).rlike(pattern)).withColumn("week", F.regexp_extract(column, pattern, 2).cast("int"))


def with_known_stem(images: DataFrame, labels: DataFrame, image: str = "image_path", label: str = "label_path") -> DataFrame:
    """Images whose stem is that of some label file."""
    stems = labels.select(N.stem(F.col(label)).alias("_stem"))
    return images.withColumn("_stem", N.stem(F.col(image))).join(stems, "_stem", "left_semi").drop("_stem")


def common_names(a: DataFrame, b: DataFrame, column: str = "file_name") -> DataFrame:
    """Base names on both sides, each once."""
    name = N.basename(F.col(column)).alias("name")
    return a.select(name).intersect(b.select(name))


def blank_labels(images: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """``key, text``: an empty label file for each image without one."""
    return images.select(key).join(labels.select(key), key, "left_anti").select(key, F.lit("").alias("text"))


def without_folders(df: DataFrame, column: str = "dataset", excluded: tuple[str, ...] = ("test_0", "test_1", "test_2")) -> DataFrame:
    return df.where(~F.col(column).isin(*excluded))


def corrected_name(name: Column, wrong: str, right: str, week: int) -> Column:
    """A name with another room and week; names of other rooms, or of a week of two digits, stay."""
    return F.regexp_replace(name, rf"^(\w+)_{wrong}_([0-9]{{8}})_w[0-9]_(T[0-9]{{2}}_[0-9]{{2}}\.jpg)", rf"$1_{right}_$2_w{week}_$3")


def next_number(names: DataFrame, column: str, prefix: str) -> DataFrame:
    """``number``: the largest number after the prefix and one, from 1."""
    n = F.regexp_extract(column, rf"^{prefix}_(\d+)(?:_|$)", 1)
    return names.agg((F.coalesce(F.max(F.when(n != "", n.cast("long"))), F.lit(0)) + 1).alias("number"))


def first_of_each(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    row = F.struct(*[c for c in df.columns if c != key])
    return df.groupBy(key).agg(F.min_by(row, F.struct(*order)).alias("_r")).select(key, "_r.*").select(*df.columns)


def unsplit(parts: dict[str, DataFrame], column: str = "path") -> DataFrame:
    """Splits merged to one set; of files of one name the last in order of path stays, as one copied over another."""
    both = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("split"), column) for name, df in parts.items()])
    name = N.basename(F.col(column)).alias("name")
    return both.groupBy(name).agg(F.max_by(F.struct("split", column), F.col(column)).alias("_r")).select("name", "_r.*")


def tree(paths: DataFrame, column: str = "path", most: int = 3, list_name: str = "train.txt") -> DataFrame:
    """``entry, depth, is_dir, text`` of folders and files down to a depth: hidden names, images and label files go."""
    rows = paths.select(F.split(column, "/").alias("p"))
    upto = rows.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"))
    cut = upto.select(
        F.array_join(F.slice("p", 1, F.col("n")), "/").alias("entry"), (F.col("n") - 1).alias("depth"), (F.col("n") < F.size("p")).alias("is_dir"),
        F.get("p", F.col("n") - 1).alias("name"), F.exists(F.slice("p", 1, F.col("n")), lambda x: x.startswith(".")).alias("hidden"),
    ).where((F.col("depth") <= most) & ~F.col("hidden"))
    unseen = ~F.col("is_dir") & N.extension(F.col("name")).isin(*UNSEEN) & (F.lower("name") != list_name)
    shown = cut.where(~unseen).distinct()
    text = F.concat(F.repeat(F.lit("    "), F.col("depth")), "name", F.when(F.col("is_dir"), "/").otherwise(""))
    return shown.select("entry", "depth", "is_dir", text.alias("text"))


def walk(paths: DataFrame, parts: list[str], column: str = "path") -> DataFrame:
    """Path parts as columns: nested folders of months, weeks, species and the like."""
    p = F.split(column, "/")
    return paths.select(column, *[F.get(p, F.lit(i)).alias(name) for i, name in enumerate(parts)])


def image_table(paths: DataFrame, column: str = "path") -> DataFrame:
    """An image table for files that aren't opened: ids from 0 by name, no size."""
    from quadrat.session import ranked_by_key

    ranks = ranked_by_key(paths.select(column), column, "_rn")
    return ranks.select(
        (F.col("_rn") - 1).alias("id"), N.basename(F.col(column)).alias("file_name"), F.lit(0).alias("width"), F.lit(0).alias("height")
    )


def copy_counters(df: DataFrame, by: str = "dataset") -> DataFrame:
    """Copied and missing images and labels of each data set. ``df``: has_image, has_label."""
    return df.groupBy(by).agg(
        F.count_if("has_image").alias("image"), F.count_if("has_label").alias("label"),
        F.count_if(~F.col("has_image")).alias("missing_images"), F.count_if(~F.col("has_label")).alias("missing_labels"),
    )


def validation_summary(judged: DataFrame) -> DataFrame:
    """``n_valid, n_invalid, errors`` of ``dataset, ok, message``; errors is a map of the few data sets that fail."""
    entries = F.collect_list(F.when(~F.col("ok"), F.struct("dataset", "message")))
    return judged.agg(
        F.count_if("ok").alias("n_valid"), F.count_if(~F.col("ok")).alias("n_invalid"), F.map_from_entries(F.sort_array(entries)).alias("errors")
    )
