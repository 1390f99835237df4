"""Voxels as Parquet, in folders of volumes: the sink that grows beyond one file a volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def bucket(vol, buckets: int):
    return F.pmod(F.xxhash64(vol), F.lit(buckets)).cast("int")


def write(voxels: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """`voxels` (vol, z and others) below `path`, a folder for each bucket of volumes, sorted by volume and plane.

    Rows are dealt by bucket and plane, so a very large volume is written by many tasks; a reader that filters by the bucket of its
    volume (see read()) opens one folder, and Parquet's row groups are skipped by vol and z.
    """
    rows = voxels.withColumn("bucket", bucket("vol", buckets))
    rows.repartition("bucket", "z").sortWithinPartitions("bucket", "vol", "z").write.partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str, vol: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """What write() wrote, or one volume of it."""
    rows = spark.read.parquet(path)
    if vol is not None:
        rows = rows.filter((F.col("bucket") == bucket(F.lit(vol).cast("long"), buckets)) & (F.col("vol") == vol))
    return rows.drop("bucket")
