"""Files written from the given tables and read back."""

from __future__ import annotations

import gzip
import itertools
import math
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.operators import geometry
from voxelith.operators.classes import LABELS_18
from voxelith.plans.views import view
from voxelith.session import new_path
from voxelith.sources import jnifti, nifti
from voxelith.sources.files import open_file, replacing


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and three class probabilities of each voxel, on the input's axes, with a header."""
    lab = view(spark, sf_dir, "lab").select("vol", F.col("x").alias("i0"), F.col("y").alias("i1"), F.col("z").alias("i2"), F.col("ref").alias("label"))
    lab = lab.withColumn("p", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: F.when(c == F.col("label") % 3, 0.75).otherwise(0.125)))
    return geometry.default_affine(lab.withColumns({"n0": F.lit(15), "n1": F.lit(10), "n2": F.lit(10)}))


def _vol(df: DataFrame) -> DataFrame:
    return df.withColumn("vol", F.regexp_extract("path", r"vol-(\d+)\.", 1).cast("long"))


def _written(files: DataFrame) -> None:
    """Writing is an action: the read that follows lists the folder."""
    files.write.mode("overwrite").format("noop").save()


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ingest_nifti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vol, z, y, x, val of plain files of the labels, each read once: planes and statuses are stored together."""
    folder = new_path(spark, "nii")
    _written(nifti.export(_rows(spark, sf_dir), folder, ".nii"))
    scanned = _stored(nifti.scan(geometry.header_status(nifti.headers(spark, folder))), "planes")
    return _vol(nifti.voxels(nifti.good_planes(scanned))).select("vol", "z", "y", "x", "val")


def labels_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through gzip, with each file's status and voxel sizes."""
    folder = new_path(spark, "nii-gz")
    _written(nifti.export(_rows(spark, sf_dir), folder))
    head = geometry.header_status(nifti.headers(spark, folder)).select("path", "status", "p0", "p1", "p2")
    # headers meet planes, not voxels; Spark guesses the planes' size from their packed files, and by its guess would broadcast them
    both = _vol(nifti.voxels(nifti.slabs(spark, folder).join(head.hint("merge"), "path"), "status", "p0", "p1", "p2"))
    return both.select("vol", "z", "y", "x", "val", "status", "p0", "p1", "p2")


def tpm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vol, c, z, y, x, val of four-dimensional files."""
    folder = new_path(spark, "tpm")
    _written(nifti.export(_rows(spark, sf_dir), folder, ".nii.gz", 3))
    return _vol(nifti.voxels(nifti.slabs(spark, folder, channels=True))).select("vol", "c", "z", "y", "x", "val")


def jnii_roundtrip(spark: SparkSession, sf_dir: str, shuffle: int) -> DataFrame:
    """vol, c, z, y, x, val of text files: labels with a label table, or shuffled probabilities if `shuffle` is 4."""
    folder = new_path(spark, "jnii")
    table = {str(i): {"Label": a, "Name": b, "SourceLabel": c, "RGBA": list(rgba)} for i, a, b, c, *rgba in LABELS_18}
    _written(jnifti.export(_rows(spark, sf_dir), folder, table, 3 if shuffle > 1 else 0, shuffle))
    scanned = _stored(jnifti.scan(jnifti.headers(spark, folder)), "planes")
    return _vol(jnifti.voxels(nifti.good_planes(scanned))).select("vol", "c", "z", "y", "x", "val")


def _spoiled(files: DataFrame, harm) -> None:
    """Each file (vol, path) as `harm(vol, its bytes)` makes it."""

    def run(frames):
        for f in frames:
            for vol, path in zip(f["vol"], f["path"], strict=True):
                with open_file(path, "rb") as old:
                    raw = old.read()
                with replacing(path) as new:
                    new.write(harm(int(vol), raw))
            yield f

    _written(files.mapInPandas(run, files.schema))


def _harm_gzip(vol: int, raw: bytes) -> bytes:
    whole = lambda h: nifti.member(gzip.decompress(raw)[: h[0]] + h[1] + gzip.decompress(raw)[h[0] + len(h[1]) :])
    kind = vol % 7
    return {0: raw, 1: raw[: len(raw) // 2], 2: raw + b"junk", 3: whole((108, struct.pack("<f", math.nan))), 4: whole((344, b"xx")), 5: raw[:-8] + b"\0\0\0\0" + raw[-4:], 6: raw[:100]}[kind]


def _harm_text(vol: int, raw: bytes) -> bytes:
    kind = vol % 8
    if kind in (3, 5):
        data = raw.index(b'"_ArrayZipData_": "') + 19
        return raw[:data] + (b"AAAA" if kind == 3 else b"****") + raw[data + 4 :]
    return {0: raw, 1: raw[: len(raw) // 2], 2: b"[" + raw + b"]", 4: raw.replace(b'"_ArraySize_": [15', b'"_ArraySize_": [16'), 6: raw.replace(b'"zlib"', b'"lzma"'), 7: raw.replace(b'"Affine"', b'"Affix"')}[kind]


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vol, form, header_status, status, n_planes: files of every volume, most of them spoiled, with the reason that the header and the whole
    file give, and the planes that are let through."""
    rows, out = _rows(spark, sf_dir), []
    for form, export, harm in (("nii.gz", nifti.export, _harm_gzip), ("jnii", jnifti.export, _harm_text)):
        folder = new_path(spark, "spoiled")
        _spoiled(_stored(export(rows, folder), "files"), harm)
        head = geometry.header_status(nifti.headers(spark, folder)) if form == "nii.gz" else jnifti.headers(spark, folder)
        scanned = _stored((nifti if form == "nii.gz" else jnifti).scan(head), "planes")
        kept = nifti.good_planes(scanned).groupBy("path").agg(F.count(F.lit(1)).alias("n_planes"))
        both = head.select("path", F.col("status").alias("header_status")).join(nifti.statuses(scanned), "path").join(kept, "path", "left")
        out.append(_vol(both).select("vol", F.lit(form).alias("form"), "header_status", "status", F.coalesce("n_planes", F.lit(0)).alias("n_planes")))
    return out[0].unionByName(out[1])


def _images(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Files of the volumes in all orientations: double NIfTI for two thirds, double JNIfTI for the others."""
    meta = view(spark, sf_dir, "volmeta")
    turns = list(itertools.permutations(range(3)))
    pick = lambda i: F.element_at(F.array(*(F.lit(t[i]) for t in turns)), (F.col("vol") % 6 + 1).cast("int"))
    sizes, spacings = F.array("nx", "ny", "nz"), F.array("sx", "sy", "sz")
    h = meta.withColumns({f"d{i}": pick(i) for i in range(3)} | {f"g{i}": 1 - 2 * (F.floor(F.col("vol") / (6 * 2**i)) % 2).cast("int") for i in range(3)})
    h = h.withColumns({f"n{i}": F.element_at(sizes, F.col(f"d{i}") + 1) for i in range(3)})
    entry = lambda r, i: F.when(F.col(f"d{i}") == r, F.col(f"g{i}") * F.element_at(spacings, F.col(f"d{i}") + 1)).otherwise(0.0)
    h = h.withColumns({f"a{r}{i}": entry(r, i) for r in range(3) for i in range(3)} | {f"a{r}3": F.lit(float(r)) for r in range(3)}).select("vol", *geometry.AXES, *geometry.AFFINE)
    rows = geometry.from_canonical(view(spark, sf_dir, "vox").join(h, "vol"))
    _written(nifti.export(rows.filter("vol % 3 <> 2"), folder, ".nii.gz", code=64))
    _written(jnifti.export(rows.filter("vol % 3 = 2"), folder, name="double"))


def compare_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vol, verdict, voxels, matches, agreement, worst of label files: some of either side are missing, spoiled or of another shape."""
    from voxelith.plans.compare_files import compared_folders

    rows, ref, new = _rows(spark, sf_dir), new_path(spark, "ref"), new_path(spark, "new")
    cut = rows.filter("vol % 9 <> 4 or i0 < 14").withColumn("n0", F.when(F.expr("vol % 9 = 4"), 14).otherwise(F.col("n0")))
    _spoiled(_stored(nifti.export(cut.filter("vol % 9 <> 1"), ref), "files"), lambda vol, raw: raw[:-20] if vol % 9 == 3 else raw)
    pred = view(spark, sf_dir, "lab").select("vol", F.col("x").alias("i0"), F.col("y").alias("i1"), F.col("z").alias("i2"), F.col("pred").alias("new"))
    other = rows.join(pred, ["vol", "i0", "i1", "i2"]).withColumn("label", F.when(F.expr("vol % 9 = 5"), F.col("label")).otherwise(F.col("new")))
    _written(jnifti.export(other.filter("vol % 9 <> 2").drop("new"), new))
    report, _ = compared_folders(spark, ref, new, 0.87)
    return report.select(F.regexp_extract("name", r"vol-(\d+)", 1).cast("long").alias("vol"), "verdict", "voxels", "matches", F.round("agreement", 9).alias("agreement"), F.round("worst", 9).alias("worst"))


def segment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vol, status, z, y, x, label: files written from the volumes in all orientations, segmented from folder to folder, and the files written
    read back and turned to canonical axes."""
    from voxelith.plans import flagship, segment_files as job
    from voxelith.plans.views import fold_weights

    source, out = new_path(spark, "images"), new_path(spark, "labels")
    _images(spark, sf_dir, source)
    load = flagship.linear_model(fold_weights(spark, sf_dir, 2, 3), 3)
    report = job.segment_folder(spark, source, out, load, flagship.TEST)
    volumes, voxels, _ = job.read_folder(spark, out)
    back = geometry.to_canonical(voxels)
    name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    of = volumes.select("vol", name("path").alias("name")).withColumnRenamed("vol", "new")
    known = _vol(report).select("vol", "status", name("out_path").alias("name")).join(of, "name")
    return back.withColumnRenamed("vol", "new").join(known, "new").select("vol", "status", "z", "y", "x", F.col("val").cast("int").alias("label"))
