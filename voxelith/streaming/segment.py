"""Segmentation of files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from voxelith.plans.flagship import Plan
from voxelith.plans.segment_files import segment_files


def stream_segment(spark: SparkSession, folder: str, out: str, report: str, checkpoint: str, load: Callable, plan: Plan, suffix: str = ".nii.gz", files_at_once: int = 1000) -> StreamingQuery:
    """Files that appear in `folder` are segmented into `out`, each once; a run handles what is there and stops.

    Rows of segment_files.segment_files() go to Parquet at `report`, a folder for each batch of at most `files_at_once` files. A batch that is
    repeated after a failure writes the same files and the same folder again, so every file counts once; a damaged file has its
    reason and holds up nothing.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_at_once).load(folder)

    def batch(rows: DataFrame, number: int) -> None:
        segment_files(rows, out, load, plan, suffix).write.mode("overwrite").parquet(f"{report}/batch={number}")

    return files.select("path").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
