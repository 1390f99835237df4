"""Volumes, headers, labels and jobs as views of the given tables. The texts run unchanged in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.session import ship_code

VIEWS = {
    "vox": """SELECT vol, z, y, x,
       CASE WHEN (z-4)*(z-4) + (y-5)*(y-5) + (x-7)*(x-7) <= 9 + 7*(vol % 2) THEN o_totalprice / 1000 ELSE CAST(0 AS DOUBLE) END AS val
FROM (SELECT CAST(floor(o_orderkey / 1500) AS BIGINT) AS vol, CAST(floor((o_orderkey % 1500) / 150) AS INT) AS z,
             CAST(floor((o_orderkey % 150) / 15) AS INT) AS y, CAST(o_orderkey % 15 AS INT) AS x, o_totalprice FROM orders) t""",
    "volmeta": """SELECT vol, 10 AS nz, 10 AS ny, 15 AS nx,
       CAST(1.0 AS DOUBLE) + CAST(0.25 AS DOUBLE) * (vol % 3) AS sz, CAST(1.0 AS DOUBLE) AS sy, CAST(0.8 AS DOUBLE) AS sx
FROM (SELECT DISTINCT CAST(floor(o_orderkey / 1500) AS BIGINT) AS vol FROM orders) t""",
    "lab": """SELECT CAST(floor(o_orderkey / 1500) AS BIGINT) AS vol, CAST(floor((o_orderkey % 1500) / 150) AS INT) AS z,
       CAST(floor((o_orderkey % 150) / 15) AS INT) AS y, CAST(o_orderkey % 15 AS INT) AS x, CAST(o_custkey % 18 AS INT) AS ref,
       CAST(CASE WHEN o_orderkey % 10 = 0 THEN (o_custkey + 1) % 18 ELSE o_custkey % 18 END AS INT) AS pred
FROM orders""",
    "hdr": """SELECT p_partkey AS vol, 4 + p_size % 3 AS n0, 5 AS n1, 6 AS n2,
       CASE WHEN d0=0 THEN g0*s0 ELSE t END AS a00, CASE WHEN d1=0 THEN g1*s1 ELSE t END AS a01, CASE WHEN d2=0 THEN g2*s2 ELSE t END AS a02, CAST(-p_size AS DOUBLE) AS a03,
       CASE WHEN d0=1 THEN g0*s0 ELSE t END AS a10, CASE WHEN d1=1 THEN g1*s1 ELSE t END AS a11, CASE WHEN d2=1 THEN g2*s2 ELSE t END AS a12, CAST(p_size AS DOUBLE) AS a13,
       CASE WHEN d0=2 THEN g0*s0 ELSE t END AS a20, CASE WHEN d1=2 THEN g1*s1 ELSE t END AS a21, CASE WHEN d2=2 THEN g2*s2 ELSE t END AS a22, CAST(0 AS DOUBLE) AS a23
FROM (SELECT p_partkey, p_size, CAST(0.5 AS DOUBLE) + p_size / CAST(50 AS DOUBLE) AS s0, CAST(1.0 AS DOUBLE) AS s1, CAST(1.5 AS DOUBLE) AS s2,
             CAST(0.05 AS DOUBLE) * (p_partkey % 3) AS t, 1 - 2 * CAST(floor(p_partkey / 6) % 2 AS INT) AS g0,
             1 - 2 * CAST(floor(p_partkey / 12) % 2 AS INT) AS g1, 1 - 2 * CAST(floor(p_partkey / 24) % 2 AS INT) AS g2, d0, d1, d2
      FROM part JOIN (VALUES (0,0,1,2),(1,0,2,1),(2,1,0,2),(3,1,2,0),(4,2,0,1),(5,2,1,0)) AS m(k,d0,d1,d2) ON p_partkey % 6 = k) q""",
    "rawhdr": """SELECT p_partkey AS vol, CASE WHEN p_partkey % 50 = 0 THEN 540 ELSE 348 END AS sizeof_hdr,
       CASE WHEN p_partkey % 37 = 0 THEN 'bad' WHEN p_partkey % 2 = 0 THEN 'n+1' ELSE 'ni1' END AS magic,
       CASE WHEN p_partkey % 41 = 0 THEN 2 WHEN p_partkey % 43 = 0 THEN 4 ELSE 3 END AS ndim, CASE WHEN p_partkey % 86 = 0 THEN 7 ELSE 1 END AS dim4,
       4 + p_size % 3 AS n0, 5 AS n1, 6 AS n2,
       CASE p_partkey % 9 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 16 WHEN 4 THEN 64 WHEN 5 THEN 256 WHEN 6 THEN 512 WHEN 7 THEN 768 ELSE 128 END AS datatype,
       CASE p_partkey % 9 WHEN 0 THEN 8 WHEN 1 THEN 16 WHEN 2 THEN 32 WHEN 3 THEN 32 WHEN 4 THEN 64 WHEN 5 THEN 8 WHEN 6 THEN 16 WHEN 7 THEN 32 ELSE 24 END AS bitpix,
       CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 352 END AS vox_offset, CASE WHEN p_partkey % 53 = 0 THEN 400 ELSE 4096 END AS n_bytes,
       CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS sform_code, CASE WHEN p_partkey % 3 = 1 THEN 1 ELSE 0 END AS qform_code,
       CASE WHEN p_size = 50 THEN CAST(1 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) * (p_size % 5) END AS qb,
       CASE WHEN p_size = 50 THEN CAST(0 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) * (p_size % 4) END AS qc,
       CASE WHEN p_size = 50 THEN CAST(0 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) * (p_size % 3) END AS qd,
       CASE WHEN p_partkey % 4 = 0 THEN -1 ELSE 1 END AS qfac, CAST(p_partkey % 3 AS DOUBLE) AS scl_slope, CAST(p_partkey % 2 AS DOUBLE) AS scl_inter,
       CAST(p_size % 4 AS DOUBLE) - CAST(1 AS DOUBLE) AS p0, CAST(1.5 AS DOUBLE) AS p1, CAST(2 AS DOUBLE) AS p2,
       CAST(-p_size AS DOUBLE) AS o0, CAST(p_size AS DOUBLE) AS o1, CAST(3 AS DOUBLE) AS o2
FROM part""",
    "jobs": """SELECT o_orderkey AS job_id,
       CASE o_custkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '0,2,4' WHEN 2 THEN 'all' ELSE 'custom_9.onnx,,1' END AS folds,
       concat('scan_', CAST(o_orderkey AS VARCHAR(20)), CASE o_custkey % 5 WHEN 0 THEN '.nii.gz' WHEN 1 THEN '.NII' WHEN 2 THEN '.jnii' WHEN 3 THEN '.BNII' ELSE '.img' END) AS path
FROM orders""",
    "types": """SELECT event_id, CASE event_type WHEN 'error' THEN 'Convolution3D' WHEN 'signup' THEN 'Pooling3D' ELSE event_type END AS op_type, value AS wall
FROM events""",
}
_TABLE = {"vox": "orders", "volmeta": "orders", "lab": "orders", "hdr": "part", "rawhdr": "part", "jobs": "orders", "types": "events"}

FOLDS, CLASSES = 3, 18


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    table = _TABLE[name]
    text = VIEWS[name].replace(f"FROM {table}", "FROM {source}")
    return spark.sql(text, source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, fold, logits: 18 numbers of each vector for each of three folds."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1))).alias("fold"), "embedding", "label")
    part = F.transform(F.slice("embedding", F.col("fold") * CLASSES + 1, CLASSES), lambda v: v.cast("double"))
    return e.select("vec_id", "fold", part.alias("logits"), "label")


def fold_weights(spark: SparkSession, sf_dir: str, folds: int, classes: int) -> list[tuple[int, list[float], list[float]]]:
    """(fold, w, b) of the linear scorer: numbers of vectors 0 and 1, two rows of the table."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id in (0, 1)").select("vec_id", "embedding")
    v = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in e.collect()}
    return [(f, v[0][f * CLASSES : f * CLASSES + classes], v[1][f * CLASSES : f * CLASSES + classes]) for f in range(folds)]
