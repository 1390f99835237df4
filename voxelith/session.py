"""Session helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each Spark application, so that jobs do not depend on the workers' path."""
    sc = spark.sparkContext
    if getattr(sc, "_voxelith_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="voxelith-code-"), "voxelith.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(path)
    sc._voxelith_shipped = True


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one in local tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='voxelith-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has used."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
