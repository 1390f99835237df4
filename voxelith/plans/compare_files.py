"""Two folders of label files against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.operators import evaluate, geometry
from voxelith.plans.segment_files import read_folder


def _side(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(files: name, shape and status of each file below `path`; runs of its planes of constant canonical z)."""
    volumes, voxels, report = read_folder(spark, path)
    axes = geometry.axes_to_canonical(volumes)
    own = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"(?i)\.(nii|nii\.gz|jnii)$", "")
    world = [F.when(F.col("d0") == j, F.col("n0")).when(F.col("d1") == j, F.col("n1")).otherwise(F.col("n2")) for j in range(3)]
    shape = F.array(*world)
    files = report.join(axes.select("path", "vol", shape.alias("shape")), "path", "left").select(own.alias("name"), "status", "vol", "shape")
    labels = geometry.to_canonical(voxels).join(axes.select("vol", own.alias("name")), "vol")
    runs = evaluate.runs(labels.select(F.col("name").alias("vol"), "z", "y", "x", F.col("val").cast("int").alias("label"), world[0].alias("width")), F.col("width"))
    return files.select("name", *(F.col(c).alias(f"{name}_{c}") for c in ("status", "shape"))), runs


def compared_folders(spark: SparkSession, ref: str, new: str, floor: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """(report, dice) of the label files of two folders that have the same names, whatever their formats and orientations.

    report: name, verdict, voxels, matches, agreement, worst: PASS or FAIL by the worst Dice of any label against `floor`, or why two
    files were not compared: missing_ref, missing_new, the file's own reason (ref_... or new_...), or other_shape. dice: name, label,
    n_ref, n_pred, n_both, dice of those that were. Shuffles carry runs of equal labels.
    """
    (a, x), (b, y) = _side(spark, ref, "ref"), _side(spark, new, "new")
    fine = lambda s: F.col(f"{s}_status").isin("ok", "trailing_bytes")
    why = (
        F.when(F.col("ref_status").isNull(), "missing_ref")
        .when(F.col("new_status").isNull(), "missing_new")
        .when(~fine("ref"), F.concat(F.lit("ref_"), "ref_status"))
        .when(~fine("new"), F.concat(F.lit("new_"), "new_status"))
        .when(F.col("ref_shape") != F.col("new_shape"), "other_shape")
    )
    pairs = a.join(b, "name", "full").select("name", why.alias("why"))
    alike = pairs.filter("why is null").select(F.col("name").alias("vol"))
    counts = evaluate.compared(x.join(alike, "vol"), y.join(alike, "vol"))
    dices = evaluate.dice(counts)
    told = evaluate.agreement(counts).join(evaluate.verdict(dices, floor), "vol").withColumnRenamed("vol", "name")
    report = pairs.join(told, "name", "left").select("name", F.coalesce("why", "verdict").alias("verdict"), "voxels", "matches", "agreement", "worst")
    return report, dices.withColumnRenamed("vol", "name")
