"""Bounding boxes, crops, padding and dense grids over voxels (vol, z, y, x, val)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def box_columns() -> list[Column]:
    """Aggregates zlo, zhi, ylo, yhi, xlo, xhi of voxels."""
    inside = F.col("val") != 0
    out = []
    for k in "zyx":
        out += [F.coalesce(F.min(F.when(inside, F.col(k))), F.lit(0)).alias(f"{k}lo"), F.coalesce(F.max(F.when(inside, F.col(k) + 1)), F.max(F.col(k)) + 1).alias(f"{k}hi")]
    return out


def nonzero_bbox(voxels: DataFrame) -> DataFrame:
    """vol, zlo, zhi, ylo, yhi, xlo, xhi: half-open box around values other than 0; the whole volume if there are none."""
    return voxels.groupBy("vol").agg(*box_columns())


def crop(voxels: DataFrame, bbox: DataFrame) -> DataFrame:
    """Voxels inside the box, counted from its corner."""
    both = voxels.join(bbox, "vol")
    for k in "zyx":
        both = both.filter((F.col(k) >= F.col(f"{k}lo")) & (F.col(k) < F.col(f"{k}hi")))
    return both.withColumns({k: F.col(k) - F.col(f"{k}lo") for k in "zyx"}).select(*voxels.columns)


def moments(voxels: DataFrame) -> DataFrame:
    """vol, mean_, sd_ over all of a volume's voxels. A grouped aggregate, not a window, so a volume's voxels stay spread over tasks."""
    return voxels.groupBy("vol").agg(F.avg("val").alias("mean_"), F.stddev_pop("val").alias("sd_"))


def zscore(voxels: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(val - mean) / max(population standard deviation, 1e-8) over all of a volume's voxels, or with the moments in `stats`."""
    stats = moments(voxels) if stats is None else stats.select("vol", "mean_", "sd_")
    return voxels.join(stats, "vol").withColumn("val", (F.col("val") - F.col("mean_")) / F.greatest("sd_", F.lit(1e-8))).select(*voxels.columns)


def resized(n: Column, old: Column, new: float) -> Column:
    """Samples along an axis at another spacing, halves rounded away from zero."""
    return F.round(n * old / new).cast("int")


def target_shape(meta: DataFrame, spacing: float) -> DataFrame:
    """`meta` (nz, ny, nx, sz, sy, sx) with tz, ty, tx."""
    return meta.withColumns({f"t{k}": resized(F.col(f"n{k}"), F.col(f"s{k}"), spacing) for k in "zyx"})


def extent(voxels: DataFrame) -> DataFrame:
    """vol, nz, ny, nx of dense voxels."""
    return voxels.groupBy("vol").agg(*((F.max(k) + 1).alias(f"n{k}") for k in "zyx"))


def dense(shape: DataFrame, nz: str = "nz", ny: str = "ny", nx: str = "nx") -> DataFrame:
    """Every voxel of each volume of `shape`, made in place from its one row."""
    axis = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    return shape.select("vol", nz, ny, nx, F.explode(axis(nz)).alias("z")).select("vol", "z", nz, ny, nx, F.explode(axis(ny)).alias("y")).select("vol", "z", "y", F.explode(axis(nx)).alias("x"))


def pad_to(voxels: DataFrame, shape: DataFrame, patch: tuple[int, int, int]) -> DataFrame:
    """Zeros around each dense volume up to the patch; half of them, rounded down, before the first voxel. Only the zeros are made; voxels are moved in place."""
    ends = [F.greatest(F.col(f"n{k}"), F.lit(p)).alias(f"p{k}") for k, p in zip("zyx", patch, strict=True)]
    sides = shape.select("vol", "nz", "ny", "nx", *ends, *(offset(F.col(f"n{k}"), p).alias(f"o{k}") for k, p in zip("zyx", patch, strict=True)))
    moved = voxels.join(sides.select("vol", "oz", "oy", "ox"), "vol").select("vol", *((F.col(k) + F.col(f"o{k}")).alias(k) for k in "zyx"), "val")
    inside = [(F.col(k) >= F.col(f"o{k}")) & (F.col(k) < F.col(f"o{k}") + F.col(f"n{k}")) for k in "zyx"]
    around = dense(sides, "pz", "py", "px").join(sides, "vol").filter(~(inside[0] & inside[1] & inside[2]))
    return moved.unionByName(around.select("vol", "z", "y", "x", F.lit(0.0).alias("val")))


def offset(n: Column, patch: int) -> Column:
    """Padding before the first voxel of an axis."""
    return F.floor((F.greatest(n, F.lit(patch)) - n) / 2).cast("int")


def unpad(rows: DataFrame, shape: DataFrame, patch: tuple[int, int, int]) -> DataFrame:
    """Rows (vol, z, y, x, ...) of padded volumes back on their own grid."""
    both = rows.join(shape.select("vol", "nz", "ny", "nx"), "vol")
    for k, p in zip("zyx", patch, strict=True):
        both = both.withColumn(k, F.col(k) - offset(F.col(f"n{k}"), p)).filter((F.col(k) >= 0) & (F.col(k) < F.col(f"n{k}")))
    return both.select(*rows.columns)


def _around(bbox: DataFrame, shape: DataFrame, value: Column) -> DataFrame:
    """vol, z, y, x of the full grid outside the box, and `value` there. Made from the box alone, without a join with what is inside."""
    sides = bbox.join(shape.select("vol", "nz", "ny", "nx"), "vol")
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = sides.select("*", axis("nz").alias("z")).select("*", axis("ny").alias("y")).select("*", axis("nx").alias("x"))
    inside = [(F.col(k) >= F.col(f"{k}lo")) & (F.col(k) < F.col(f"{k}hi")) for k in "zyx"]
    return rows.filter(~(inside[0] & inside[1] & inside[2])).select("vol", "z", "y", "x", value)


def uncrop_labels(labels: DataFrame, bbox: DataFrame, shape: DataFrame, background: int = 0) -> DataFrame:
    """Labels (vol, z, y, x, label) of whole crops on the full grid, `background` outside the box."""
    moved = labels.join(bbox, "vol").withColumns({k: F.col(k) + F.col(f"{k}lo") for k in "zyx"}).select("vol", "z", "y", "x", "label")
    return moved.unionByName(_around(bbox, shape, F.lit(background).cast(dict(labels.dtypes)["label"]).alias("label")))


def uncrop_tpm(tpm: DataFrame, bbox: DataFrame, shape: DataFrame, classes: int, background: int = 0) -> DataFrame:
    """Probabilities (vol, z, y, x, p array) of whole crops on the full grid; outside the box the background class has 1."""
    moved = tpm.join(bbox, "vol").withColumns({k: F.col(k) + F.col(f"{k}lo") for k in "zyx"}).select("vol", "z", "y", "x", "p")
    outside = F.array(*(F.lit(1.0 if c == background else 0.0) for c in range(classes)))
    return moved.unionByName(_around(bbox, shape, outside.alias("p")))


def place_upsampled(rows: DataFrame, bbox: DataFrame, meta: DataFrame, spacing: float) -> DataFrame:
    """Rows of the resampled crop on the full grid at `spacing`; what rounding puts past its end is dropped."""
    full = target_shape(meta, spacing)
    both = rows.join(bbox.join(full, "vol"), "vol")
    for k in "zyx":
        both = both.withColumn(k, F.col(k) + F.round(F.col(f"{k}lo") * F.col(f"s{k}") / spacing).cast("int")).filter(F.col(k) < F.col(f"t{k}"))
    return both.select(*rows.columns)
