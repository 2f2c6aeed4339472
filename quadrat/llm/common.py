"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Collection, Iterator
from pathlib import Path
from typing import TypeVar

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one hand-over to Python holds at most (a longer row goes alone); texts may be long, so both are
#: kept small.
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20
#: Characters of the texts that are split into words at once.
LOT_CHARS = 1 << 20
T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound what one hand-over to Python holds, free shuffle files once a query has run, and let Python workers on
    this machine find the package where it isn't installed."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in (paths := env.get("PYTHONPATH", "").split(os.pathsep)):
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``; a folder of this machine only
    where everything runs on it, else an error, as executors wouldn't see each other's files."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; deleted when the session ends (deleteOnExit of its file system)."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` dealt evenly to as many partitions as the session shuffles to."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *columns)


def utf8(column: str) -> F.Column:
    """A text as UTF-8 bytes, null as no bytes."""
    return F.encode(F.coalesce(F.col(column), F.lit("")), "UTF-8")


def lots(texts: list[str], most: int, chars: int = LOT_CHARS) -> Iterator[list[str]]:
    """``texts`` in order, in lists of at most ``most`` texts and ``chars`` characters (a longer text goes alone)."""
    lot, size = [], 0
    for text in texts:
        if lot and (len(lot) == most or size + len(text) > chars):
            yield lot
            lot, size = [], 0
        lot.append(text)
        size += len(text)
    if lot:
        yield lot


class Memory:
    """A dictionary of strings to bytes (or short tuples) whose size in bytes is bounded, keys, values and slots counted. The older of two
    generations is dropped when the younger has half of ``room``."""

    #: Bytes of an entry besides the characters of its key and the bytes of its value.
    SLOT = 180

    def __init__(self, room: int):
        self.room, self.young, self.old, self.used = room, {}, {}, 0

    def keep(self, keys: Collection[str], values: list) -> None:
        self.young.update(zip(keys, values))
        self.used += sum(map(len, keys)) + sum(map(len, values)) + self.SLOT * len(values)

    def missing(self, keys: set[str]) -> list[str]:
        """Those of ``keys`` that aren't known; the others are young afterwards."""
        new = keys.difference(self.young)
        again = self.old.keys() & new
        if again:
            self.keep(again, list(map(self.old.__getitem__, again)))
            new -= again
        return list(new)

    def turn(self) -> None:
        """Begin another generation if the younger is full."""
        if self.used > self.room // 2:
            self.young, self.old, self.used = {}, self.young, 0


#: What a worker remembers, by stage and name; see ``for_stage``. And the stage of the last task that read.
_HELD: dict[tuple, object] = {}
_LAST: list[int | None] = [None]


def _let_go() -> int | None:
    """The running task's stage. If it is another than the last task's, what was remembered is dropped, and freed memory
    handed back to the system."""
    task = TaskContext.get()
    stage = task.stageId() if task else None
    if stage != _LAST[0]:
        _LAST[0] = stage
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)
    return stage


def for_stage(make: Callable[..., T], *name) -> T:
    """``make(*name)``, one for all tasks of a stage in this worker. It goes when a task of another stage begins to
    read, so that workers, which live long, don't gather what each operator remembers."""
    key = (_let_go(), make, *name)
    if key not in _HELD:
        for other in [k for k in _HELD if k[1] is make]:
            del _HELD[other]
        _HELD[key] = make(*name)
    return _HELD[key]


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    """Each Arrow batch as lists of Python values, one list per name."""
    _let_go()
    for batch in batches:
        yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)
