"""Files in, files out: every image below a folder is read, segmented and written in its own orientation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.operators import geometry, planes
from voxelith.operators.classes import LABELS_6, LABELS_18, MERGE_18_TO_6
from voxelith.plans.flagship import Plan, segmented
from voxelith.session import new_path, ship_code
from voxelith.sources import jnifti, nifti
from voxelith.sources.files import listed

VOLUME = ["vol", "path", "n0", "n1", "n2", *geometry.AFFINE]


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_folder(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """read_files() of all files below `path`."""
    return read_files(listed(spark, path))


def read_files(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(volumes, voxels, report) of the files in `files` (path), NIfTI and JNIfTI text.

    volumes: VOLUME, a row for each file that is whole, vol being a 63-bit hash of its path, so that a rerun gives the same; voxels: vol,
    i0, i1, i2, val on the file's axes, in Parquet by then, and geometry.AXES of their volume, which planes bring along; report: path, form,
    status of every file. Each file's data is read once.
    """
    ship_code(files.sparkSession)
    text = F.lower("path").endswith(".jnii")
    n = geometry.header_status(nifti.headers_of(files.filter(~text)))
    heads = geometry.select_affine(n).select("path", "n0", "n1", "n2", *geometry.AFFINE, "status", "dim4", "datatype", "vox_offset", "scl_slope", "scl_inter")
    j = jnifti.headers_of(files.filter(text))
    deep = (F.col("status") == "ok") & (F.size("array_size") == 4)
    j = j.withColumn("status", F.when(deep, "four_d").otherwise(F.col("status")))
    heads, j = _stored(heads, "heads"), _stored(j, "heads")
    a, b = _stored(nifti.scan(heads), "planes"), _stored(jnifti.scan(j), "planes")
    report = nifti.statuses(a).withColumn("form", F.lit("nii")).unionByName(nifti.statuses(b).withColumn("form", F.lit("jnii")))
    sizes = j.select("path", *(F.try_element_at("array_size", F.lit(i + 1)).cast("int").alias(f"n{i}") for i in range(3)), *(F.col("affine")[r][c].alias(f"a{r}{c}") for r in range(3) for c in range(4)))
    whole = report.filter("status in ('ok', 'trailing_bytes')").select("path")
    both = heads.select("path", "n0", "n1", "n2", *geometry.AFFINE).unionByName(sizes).join(whole, "path")
    volumes = _stored(both.withColumn("vol", F.expr("xxhash64(path) & 9223372036854775807")).select(*VOLUME), "volumes")
    if volumes.groupBy("vol").count().filter("count > 1").head(1):
        raise ValueError("two paths have one hash: read them apart")
    own = geometry.axes_to_canonical(volumes).select("vol", "path", *geometry.AXES)
    x = nifti.good_planes(a).join(own, "path").select("vol", *geometry.AXES, F.col("z").alias("i2"), "nx", F.posexplode("data").alias("i", "val"))
    x = x.select("vol", (F.col("i") % F.col("nx")).cast("int").alias("i0"), F.floor(F.col("i") / F.col("nx")).cast("int").alias("i1"), "i2", "val", *geometry.AXES)
    y = nifti.good_planes(b).join(own, "path").select("vol", *geometry.AXES, F.col("x").alias("i0"), "nz", F.posexplode("data").alias("i", "val"))
    y = y.select("vol", "i0", F.floor(F.col("i") / F.col("nz")).cast("int").alias("i1"), (F.col("i") % F.col("nz")).cast("int").alias("i2"), "val", *geometry.AXES)
    return volumes, x.unionByName(y), report.select("path", "form", "status")


def label_table(plan: Plan) -> dict | None:
    """The label table of a container's header, for the two known class sets."""
    rows = LABELS_6 if plan.bins is not None and tuple(plan.bins) == tuple(MERGE_18_TO_6) else LABELS_18 if plan.bins is None and plan.classes == 18 else None
    return rows and {str(i): {"Label": a, "Name": b, "SourceLabel": c, "RGBA": list(rgba)} for i, a, b, c, *rgba in rows}


def segment_folder(spark: SparkSession, path: str, out: str, load: Callable, plan: Plan, suffix: str = ".nii.gz", shuffle: int = 1) -> DataFrame:
    """segment_files() of all files below `path`."""
    return segment_files(listed(spark, path), out, load, plan, suffix, shuffle)


def segment_files(files: DataFrame, out: str, load: Callable, plan: Plan, suffix: str = ".nii.gz", shuffle: int = 1) -> DataFrame:
    """path, form, status, out_path: a row for each of `files` (path), and the file that was written for it below `out`, if it is whole.

    Volumes are turned to canonical axes, segmented by flagship.segmented() with the models that `load(fold)` gives, and written with labels (uint8)
    or probabilities (float32 a class) on the input's axes with its affine; with plan.upsample on canonical axes at the plan's spacing.
    `suffix`: .nii, .nii.gz or .jnii. Files that cannot be read keep their reason and end nothing. A rerun writes the same files again.
    """
    volumes, voxels, report = read_files(files)
    axes = geometry.canonical_affine(geometry.axes_to_canonical(volumes))
    canonical = {f"a{r}{c}": F.col(f"c{r}{c}") for r in range(3) for c in range(4)}
    world = [F.when(F.col("d0") == j, F.col("n0")).when(F.col("d1") == j, F.col("n1")).otherwise(F.col("n2")) for j in range(3)]
    turned = axes.select("vol", *(w.alias(f"m{j}") for j, w in enumerate(world)), *(c.alias(a) for a, c in canonical.items()))
    sizes = geometry.zooms(turned)
    meta = sizes.select("vol", F.col("m2").alias("nz"), F.col("m1").alias("ny"), F.col("m0").alias("nx"), F.col("z2").alias("sz"), F.col("z1").alias("sy"), F.col("z0").alias("sx"))
    lines, _ = segmented(geometry.to_canonical(voxels).select("vol", "z", "y", "x", "val"), meta, load, plan)
    value, width = ("p", plan.out_classes) if plan.probabilities else ("labels", 0)
    name = "p" if width else "label"
    if plan.upsample:
        up = geometry.upsampled_affine(sizes, plan.spacing)
        head = up.select("vol", *(F.round(F.col(f"m{i}") * F.col(f"z{i}") / plan.spacing).cast("int").alias(f"n{i}") for i in range(3)), *(F.col(f"u{r}{c}").alias(f"a{r}{c}") for r in range(3) for c in range(4)))
        more = [c for c in head.columns if c != "vol"]
        rows = planes.voxels_of_lines(lines.join(head, "vol"), value, name, width, *more)
        rows = rows.select("vol", F.col("x").alias("i0"), F.col("y").alias("i1"), F.col("z").alias("i2"), name, *more)
    else:
        head = axes.select("vol", *geometry.AXES, *geometry.AFFINE)  # headers meet lines, not voxels
        rows = geometry.from_canonical(planes.voxels_of_lines(lines.join(head, "vol"), value, name, width, *geometry.AXES, *geometry.AFFINE))
    if suffix.lower() == ".jnii":
        made = jnifti.export(rows, out, label_table(plan), width, shuffle)
    else:
        made = nifti.export(rows, out, suffix, width)
    written = _stored(made, "written")
    done = volumes.select("vol", "path").join(written.withColumnRenamed("path", "out_path"), "vol").drop("vol")
    return report.join(done, "path", "left")
