"""File names and paths as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two naming patterns, from which species, room, date, week, tile and index are read.
SPECIMEN = r"_([^_]+)_([^_]+)_(\d{8})_w(\d+)_T(\d{2})_(\d{2})\.([^.]+)$"
DASHED = r"(\d+)-(\d+)-(\d+)-(\d+)-(\d+)-(\d{6})-(\d{4})\.([^.]+)$"
FIELDS = ("species", "room", "date", "week", "tile", "index", "extension")


def parse(name: Column) -> dict[str, Column]:
    """The columns ``FIELDS`` of a file name; all null where neither pattern fits."""
    first, second = name.rlike(SPECIMEN), name.rlike(DASHED)

    def one(i: int) -> Column:
        return F.regexp_extract(name, SPECIMEN, i)

    def two(i: int) -> Column:
        return F.regexp_extract(name, DASHED, i)

    def pick(a: Column, b: Column) -> Column:
        return F.when(first, a).when(second, b)

    return {
        "species": pick(one(1), F.lit("aspa")),
        "room": pick(one(2), F.concat(F.lit("room_"), two(2).cast("long").cast("string"))),
        "date": pick(one(3), two(6)),
        "week": pick(one(4), F.lit("1")).cast("int"),
        "tile": pick(one(5), two(4)).cast("int"),
        "index": pick(one(6), two(1)).cast("int"),
        "extension": pick(one(7), two(8)),
    }


def malformed(name: Column) -> Column:
    return ~(name.rlike(SPECIMEN) | name.rlike(DASHED))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]+$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def label_path(image_path: Column) -> Column:
    """Where an image's label file is: ``images`` becomes ``labels`` in the folder, the extension ``txt``."""
    folder = F.regexp_replace(F.regexp_extract(image_path, r"^(.*/)[^/]*$", 1), "images", "labels")
    return F.concat(folder, stem(image_path), F.lit(".txt"))


def dataset_name(path: Column, rule: str = "before_images") -> Column:
    """The data set that a path belongs to. Rules: ``last_other`` (last folder not called images), ``third_last``,
    ``before_images`` (else the second last), ``before_images_or_first``, ``second``."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "images")
    before = F.when(at > 1, F.get(parts, at.cast("int") - 2))
    if rule == "last_other":
        return F.element_at(F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p != "images"), -1)
    if rule == "third_last":
        return F.get(parts, F.size(parts) - 3)
    if rule == "before_images":
        return F.coalesce(before, F.get(parts, F.size(parts) - 2))
    if rule == "before_images_or_first":
        return F.coalesce(before, F.get(parts, F.lit(0)))
    if rule == "second":
        return F.get(parts, F.lit(1))
    raise ValueError(f"no such rule: {rule}")


def without_tile(name: Column) -> Column:
    """A tile's stem without its last two parts."""
    return F.regexp_replace(name, r"_[^_]+_[^_]+$", "")


def tile_origin(name: Column) -> Column:
    """The x and y of a tile's stem."""
    return F.struct(
        F.regexp_extract(name, r"_(\d+)_(\d+)$", 1).cast("int").alias("x"),
        F.regexp_extract(name, r"_(\d+)_(\d+)$", 2).cast("int").alias("y"),
    )


def padded(number: Column, width: int = 4) -> Column:
    """With leading zeros, longer numbers whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def tile_name(stem_: Column, x: Column, y: Column) -> Column:
    return F.concat_ws("_", stem_, padded(x), padded(y))


def numbers(text: Column) -> Column:
    """The numbers in free text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))


def last_token(text: Column, by: str = "_") -> Column:
    return F.substring_index(text, by, -1)


def tray_folder(tile: Column) -> Column:
    """``T3`` to ``T03 (Done)``; T23 keeps its name."""
    two = F.concat(F.lit("T"), F.lpad(F.regexp_extract(tile, r"T(\d+)", 1), 2, "0"))
    return F.when(two == "T23", two).otherwise(F.concat(two, F.lit(" (Done)")))


def label_text(class_id: Column, coords: Column) -> Column:
    """A label line."""
    return F.concat_ws(" ", class_id.cast("string"), F.array_join(F.transform(coords, lambda c: c.cast("string")), " "))


def segment_window(name: Column) -> Column:
    """``x0, y0, x1, y1`` from the third to sixth part of a segment's name."""
    p = F.split(name, "_")
    return F.struct(*[F.get(p, F.lit(i + 2)).cast("long").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


def point_lines(text: Column) -> Column:
    """``array<struct<x, y>>`` of the lines with two numbers exactly."""
    pairs = F.filter(F.transform(F.split(text, "\n"), numbers), lambda v: F.size(v) == 2)
    return F.transform(pairs, lambda v: F.struct(F.get(v, F.lit(0)).alias("x"), F.get(v, F.lit(1)).alias("y")))


def conf_list(text: Column) -> Column:
    """Confidences of a comma-separated list; ``auto``, ``none`` and nothing are null."""
    word = lambda x: F.lower(F.trim(x))
    return F.transform(F.split(text, ","), lambda x: F.when(~word(x).isin("auto", "none", ""), word(x).cast("double")))
