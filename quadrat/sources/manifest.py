"""Data-set manifests: small YAML files, read on the driver into tables."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import PurePosixPath

import yaml
from pyspark.sql import DataFrame, SparkSession

KEYS = ("data", "train", "val", "test")
PATHS = "dataset string, split string, rel_path string"
CLASSES = "class_id int, name string"


def read_text(spark: SparkSession, path: str) -> str:
    """A small file by any path that Spark reads."""
    rows = spark.read.text(path, wholetext=True).where("value <> ''").collect()
    return rows[0][0] if rows else ""


def parse(text: str) -> dict:
    found = yaml.safe_load(text) or {}
    if "names" not in found:
        raise ValueError("manifest has no names")
    return found


def _listed(value, strings: bool) -> Iterable[tuple[str | None, str]]:
    """(data set, path) of a list, a string, or a map of lists, strings or {images: path}."""
    if value is None:
        return
    if isinstance(value, str):
        if strings:
            yield None, value
    elif isinstance(value, list):
        for v in value:
            yield from _listed(v, True)
    elif isinstance(value, dict):
        for name, v in value.items():
            if isinstance(v, dict):
                v = v.get("images")
            for _, p in _listed(v, True):
                yield name, p
    else:
        raise ValueError(f"not a list of paths: {value!r}")


def paths(found: dict, keys: Iterable[str] = KEYS, strings: bool = True, strict: bool = False) -> list[tuple[str, str, str]]:
    """(data set, split, path) of a manifest; an error if there is none. Without ``strings`` a string is ignored; if
    ``strict``, it is an error."""
    out = []
    for key in keys:
        if strict and isinstance(found.get(key), str):
            raise ValueError(f"{key} must be a list or a map")
        for name, path in _listed(found.get(key), strings):
            parts = [p for p in PurePosixPath(path).parts if p not in ("images", "/")]
            out.append((name or (parts[-1] if parts else path), key, path))
    if not out:
        raise ValueError("manifest has no paths")
    return out


def read(spark: SparkSession, path: str, keys: Iterable[str] = KEYS, strings: bool = True) -> tuple[DataFrame, DataFrame]:
    """The tables of paths and of classes."""
    found = parse(read_text(spark, path))
    names = found["names"]
    pairs = list(enumerate(names)) if isinstance(names, list) else [(int(k), v) for k, v in names.items()]
    return spark.createDataFrame(paths(found, keys, strings), PATHS), spark.createDataFrame(pairs, CLASSES)


def dump(names: dict[int, str], splits: dict[str, list[str]], root: str) -> str:
    """A manifest's text, keys in order."""
    return yaml.safe_dump({"path": root, **splits, "names": dict(names)}, sort_keys=False, allow_unicode=True)


def write(spark: SparkSession, text: str, path: str) -> None:
    """A small file by any path that Spark writes."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def renamed(names: dict[int, str], changes: dict[int, str]) -> dict[int, str]:
    """A class map with some names changed or added, in order of number."""
    return dict(sorted((names | changes).items()))


def cumulative(upto: int, step: int = 10) -> list[str]:
    """Folders of nested training sets up to a size."""
    return [f"train_{n}/images" for n in range(step, upto + 1, step)]


def merge_classes(maps: Iterable[dict[int, str] | list[str]]) -> dict[int, str]:
    """Class maps to one. A list's name whose number is taken gets the next free one; a map's keeps the first name."""
    out: dict[int, str] = {}
    for m in maps:
        as_list = isinstance(m, list)
        for k, name in enumerate(m) if as_list else sorted((int(k), v) for k, v in m.items()):
            if name in out.values():
                continue
            if k not in out:
                out[k] = name
            elif as_list:
                out[max(out) + 1] = name
    return out
