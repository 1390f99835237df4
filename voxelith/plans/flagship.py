"""The whole chain over many volumes: crop, z-score, resample, tile, score, blend, back, decide, report."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.operators import evaluate, grid, planes
from voxelith.plans import views
from voxelith.session import new_path


@dataclass(frozen=True)
class Plan:
    """How volumes are segmented: `patch` and `ratio` of tiles, the `spacing` that the model works at, `folds` to average, `classes` it
    scores, `bins` to merge them to, the class that is `background` outside the box, whether probabilities (softmax at `temperature`) or
    labels are wanted, whether on the volume's own grid or on the whole grid at `spacing` (`upsample`), and the decimals that decide labels."""

    patch: tuple[int, int, int] = (128, 128, 96)
    ratio: float = 0.5
    spacing: float = 0.75
    folds: tuple[int, ...] = (0,)
    classes: int = 18
    bins: Sequence[int] | None = None
    background: int = 0
    probabilities: bool = False
    temperature: float = 1.0
    upsample: bool = False
    digits: int | None = None

    @property
    def out_classes(self) -> int:
        return self.classes if self.bins is None else max(self.bins) + 1


TEST = Plan(patch=(8, 8, 8), folds=(0, 1), classes=3, digits=6)


def boxes(volumes: DataFrame) -> DataFrame:
    return volumes.select("vol", *(f"{k}{end}" for k in "zyx" for end in ("lo", "hi")))


def extents(volumes: DataFrame, spacing: float) -> DataFrame:
    """Each crop's extent n, and its size t at the target spacing."""
    return grid.target_shape(volumes.select("vol", *((F.col(f"{k}hi") - F.col(f"{k}lo")).alias(f"n{k}") for k in "zyx"), "sz", "sy", "sx"), spacing)


def linear_model(weights: list[tuple[int, list[float], list[float]]], classes: int) -> Callable:
    """load() of the linear scorer, as planes.overlap_add() and tiles.score_bricks() take it."""
    import numpy as np

    of = {f: (np.array(w), np.array(b)) for f, w, b in weights}

    def load(fold):
        w, b = of[fold]
        term = 0.01 * (np.arange(classes) % 3)
        return lambda tile, brick: brick[None] * w[:, None, None, None] + (b + term * tile)[:, None, None, None]

    return load


def segmented(vox: DataFrame, meta: DataFrame, load: Callable, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """(lines, volumes): labels, or probabilities p put end to end, of each line along x; and header, box and moments of each volume.

    `vox`: vol, z, y, x, val of dense volumes; `meta`: vol, nz, ny, nx, sz, sy, sx and others. What there is one row a volume of is
    written once to the shared folder, and every later step joins it from there. Voxels are read once for that and once to be packed
    into planes; what follows are planes and lines only. Lines are on the volume's own grid, or with plan.upsample on the whole grid at
    the plan's spacing, where what rounding puts past the end is dropped.
    """
    path = new_path(vox.sparkSession, "volumes")
    planes.measured(vox).join(meta, "vol").write.parquet(path)
    volumes = vox.sparkSession.read.parquet(path)
    bbox, shape = boxes(volumes), extents(volumes, plan.spacing)
    packed = planes.pack(grid.zscore(grid.crop(vox, bbox), volumes))
    slabs = planes.slabs(planes.resized(packed, shape, 3), shape, plan.patch, plan.ratio, 3)
    blended = planes.blended(planes.overlap_add(slabs, plan.patch, load, list(plan.folds), plan.classes, 3), shape, plan.patch, plan.classes)
    value = "p" if plan.probabilities else "labels"
    decide = planes.probabilities(plan.temperature, plan.bins) if plan.probabilities else planes.first_largest(plan.digits, plan.bins)
    background = [float(c == plan.background) for c in range(plan.out_classes)] if plan.probabilities else plan.background
    width = plan.out_classes if plan.probabilities else 1
    if plan.upsample:
        same = shape.select("vol", F.col("tz").alias("nz"), "tz")
        lines = planes.decided(blended, same, plan.classes, decide, value)
        full = grid.target_shape(volumes, plan.spacing)
        low = {k: F.round(F.col(f"{k}lo") * F.col(f"s{k}") / plan.spacing).cast("int") for k in "zyx"}
        size = {k: grid.resized(F.col(f"{k}hi") - F.col(f"{k}lo"), F.col(f"s{k}"), plan.spacing) for k in "zyx"}
        box = full.select("vol", *(c.alias(f"{k}lo") for k, c in low.items()), *(F.least(low[k] + size[k], F.col(f"t{k}")).alias(f"{k}hi") for k in "zyx"))
        kept = lines.join(box, "vol").filter((F.col("z") < F.col("zhi") - F.col("zlo")) & (F.col("y") < F.col("yhi") - F.col("ylo")))
        lines = kept.select("vol", "z", "y", F.slice(value, F.lit(1), (F.col("xhi") - F.col("xlo")) * width).alias(value))
        return planes.uncropped(lines, box, full.select("vol", *(F.col(f"t{k}").alias(f"n{k}") for k in "zyx")), background, value), volumes
    back = shape.select("vol", F.col("tz").alias("nz"), *(F.col(f"n{k}").alias(f"t{k}") for k in "zyx"))
    lines = planes.decided(planes.resized(blended, back, 1, plan.classes), back, plan.classes, decide, value)
    return planes.uncropped(lines, bbox, volumes, background, value), volumes


def segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vol, z, y, labels of the given volumes by the linear scorer."""
    load = linear_model(views.fold_weights(spark, sf_dir, len(TEST.folds), TEST.classes), TEST.classes)
    return segmented(views.view(spark, sf_dir, "vox"), views.view(spark, sf_dir, "volmeta"), load, TEST)[0]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.class_counts(planes.voxels_of_lines(segment(spark, sf_dir)))
