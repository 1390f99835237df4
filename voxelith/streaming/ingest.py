"""New files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from voxelith.operators import geometry
from voxelith.sources import nifti


def stream_headers(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Headers and status of files that appear in `folder`, appended to Parquet at `out`, each file once; a run handles what is there and stops.

    A damaged file gives a row with its reason, so that the stream passes it. Contents never enter a row: a task reads the first
    bytes of each of its files.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    names = [x.split()[0] for x in nifti.HEADER.split(", ")]

    def parse(frames):
        import pandas as pd

        for f in frames:
            yield pd.DataFrame([nifti.read_header(p) for p in f["path"]], columns=names).astype({"n_bytes": "Int64"})

    rows: DataFrame = geometry.header_status(files.select("path").mapInPandas(parse, nifti.HEADER))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
