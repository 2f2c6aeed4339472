"""The dataset preparation as one lazy chain of steps: filter, split, patch, balance."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions import cuts
from quadrat.operators import areas, counting, splitting, tiling
from quadrat.session import stored


@dataclass(frozen=True)
class Settings:
    """Steps with their parameters; a step whose flag is off is left out."""

    steps: tuple[str, ...] = ("filter", "split", "patch", "balance")
    disabled: frozenset[str] = frozenset()
    min_areas: tuple[float, ...] = (175, 175, 200, 200)
    split_field: str | None = "tile"
    ratios: tuple[float, float, float] = splitting.RATIOS
    seed: int = 42
    tiling: tiling.Tiling = field(default_factory=tiling.Tiling)
    preserve_all_non_empty: bool = False

    @classmethod
    def of(cls, config: dict) -> Settings:
        """From a nested configuration; missing values keep their defaults."""
        known = ("filter", "split", "patch", "balance")
        steps = tuple(s for s in config.get("pipeline", known) if s != "folder_structure")
        if unknown := set(steps) - set(known):
            raise ValueError(f"unknown steps: {sorted(unknown)}")
        patch, base = config.get("patch", {}), tiling.Tiling()
        return cls(
            steps=steps,
            disabled=frozenset(s for s in steps if not config.get(s, {}).get("enabled", True)),
            min_areas=tuple(config.get("filter", {}).get("min_pixel_area", cls.min_areas)),
            split_field=config.get("split", {}).get("split_field", cls.split_field),
            ratios=tuple(config.get("split", {}).get(k, r) for k, r in zip(("train", "val", "test"), cls.ratios)),
            seed=config.get("split", {}).get("seed", cls.seed),
            tiling=tiling.Tiling(
                patch.get("tile_width", base.width), patch.get("tile_height", base.height), patch.get("overlap", base.overlap)
            ),
            preserve_all_non_empty=config.get("balance", {}).get("preserve_all_non_empty", cls.preserve_all_non_empty),
        )

    def suffix(self) -> str:
        """What output names of the steps end in."""
        names = {"filter": "filtered", "split": "split", "patch": "tiled", "balance": "balanced"}
        return "".join(f"_{names[s]}" for s in self.steps if s not in self.disabled)


State = tuple[DataFrame, DataFrame]  # images (image_id, width, height, split, ...), labels (image_id, class_id, coords)


def _filter(state: State, s: Settings) -> State:
    images, labels = state
    spark = images.sparkSession
    thresholds = F.broadcast(spark.createDataFrame(list(enumerate(map(float, s.min_areas))), "class_id int, min_area double"))  # settings
    sized = labels.join(images.select("image_id", "width", "height"), "image_id")
    sized = sized.withColumn("area", cuts.pixel_area(F.col("coords"), F.col("width"), F.col("height")))
    judged = areas.filter_small(sized, thresholds, "area", F.size("coords") + 1)
    return images, judged.where("kept").select(*labels.columns)


def _split(state: State, s: Settings) -> State:
    images, labels = state
    rest = images.drop("split")
    if s.split_field is None:
        return splitting.random_split(rest, "image_id", s.ratios, s.seed), labels
    chosen = splitting.greedy_groups(splitting.group_counts(rest, s.split_field), s.split_field, s.ratios)
    return splitting.assign_groups(rest, chosen, s.split_field), labels


def _patch(state: State, s: Settings) -> State:
    """Images become tiles; a tile's id is image, x and y."""
    images, labels = state
    name = F.concat_ws("_", F.col("image_id").cast("string"), F.col("x0").cast("string"), F.col("y0").cast("string"))
    grid = tiling.tiles(images, s.tiling, [c for c in images.columns if c not in ("image_id", "width", "height")])
    tiles = grid.withColumn("image_id", name).withColumns({"width": F.lit(s.tiling.width), "height": F.lit(s.tiling.height)})
    cut = tiling.tile_polygons(labels, images, s.tiling, wanted=["tile_coords"])
    key = F.concat_ws("_", F.col("image_id").cast("string"), F.col("tx").cast("string"), F.col("ty").cast("string"))
    return tiles, cut.select(key.alias("image_id"), "class_id", F.col("tile_coords").alias("coords"))


def _balance(state: State, s: Settings) -> State:
    images, labels = state
    labels = stored(labels)  # used twice, and costly after patching
    used = labels.select("image_id").distinct().withColumn("_used", F.lit(True))
    stated = images.join(used, "image_id", "left").withColumn("state", F.when(F.col("_used"), "non_empty").otherwise("empty")).drop("_used")
    kept = stored(counting.balance_sample(stated, "image_id", s.seed, s.preserve_all_non_empty).drop("state"))  # used twice
    return kept, labels.join(kept.select("image_id"), "image_id", "left_semi")


STEPS: dict[str, Callable[[State, Settings], State]] = {"filter": _filter, "split": _split, "patch": _patch, "balance": _balance}


def prepare(images: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> State:
    """Images and labels after the enabled steps, in order. Only the balance, which counts, computes before an action."""
    state = images, labels
    for step in settings.steps:
        if step not in settings.disabled:
            state = STEPS[step](state, settings)
    return state
