"""The prediction chain: a model's annotations, their repair and their merge into a base set, each step fed by the one
before unless it is given its own input. What passes each step is counted in the pass that computes it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quadrat.operators import coco, matching

STEPS = ("predict", "fix", "combine")
#: A model's rows: the polygon may be missing, then the box's corners stand for it.
SCHEMA = "image_id long, class_name string, conf double, x1 double, y1 double, x2 double, y2 double, polygon array<array<double>>"


@dataclass
class Chain:
    """Inputs of the steps. ``images``: of the predictions, (id, file_name); ``load``: gives the model, once a partition,
    from images to rows of ``SCHEMA``; ``found``: annotations for ``fix`` instead of predictions; ``extra``: annotations for
    ``combine`` instead of those; ``base`` and ``categories``: what is merged into."""

    steps: tuple[str, ...] = STEPS
    images: DataFrame | None = None
    load: Callable | None = None
    class_ids: dict[str, int] | None = None
    found: DataFrame | None = None
    extra: DataFrame | None = None
    base: tuple[DataFrame, DataFrame] | None = None
    categories: DataFrame | None = None


def run(chain: Chain) -> tuple[DataFrame, dict[str, Observation]]:
    """The last step's annotations, and the counter ``n`` of each step that ran (to be read after an action)."""
    if unknown := set(chain.steps) - set(STEPS):
        raise ValueError(f"no such steps: {sorted(unknown)}")
    counters: dict[str, Observation] = {}

    def counted(df: DataFrame, step: str) -> DataFrame:
        counters[step] = Observation(step)
        return df.observe(counters[step], F.count("*").alias("n"))

    out = None
    if "predict" in chain.steps:
        if chain.images is None or chain.load is None:
            raise ValueError("predict needs images and a model")
        rows = matching.predict(chain.images, chain.load, SCHEMA).withColumn("box", F.struct("x1", "y1", "x2", "y2"))
        out = coco.from_predictions(counted(rows, "predict"), chain.class_ids or {})
    if "fix" in chain.steps:
        given = chain.found if chain.found is not None else out
        if given is None:
            raise ValueError("fix needs annotations or the step before")
        out = counted(coco.with_extent(coco.repair(given)).where(coco.all_parts(F.col("segmentation"))), "fix")
    if "combine" in chain.steps:
        given = chain.extra if chain.extra is not None else out
        if given is None or chain.base is None or chain.categories is None or chain.images is None:
            raise ValueError("combine needs a base set, its categories, images and annotations")
        kept = ["id", "image_id", "category_id", "bbox", "segmentation"]
        base_images, base = chain.base
        wide = lambda d: d.select(*[F.col(c).cast("long").alias(c) if c in kept[:3] else c for c in kept])
        out = counted(coco.merge(base_images, wide(base), chain.images, wide(given), chain.categories), "combine")
    if out is None:
        raise ValueError("a chain has at least one step")
    return out, counters
