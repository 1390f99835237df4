"""The corpus pipeline: quality, near duplicates, leaks, mixing, token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelith.llm import decontam, mixing, quality, setjoin, tokenfile
from voxelith.session import new_path, ship_code

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of this input, accepts."""
    return quality.accepted(docs, _table(spark, sf_dir, "labels")).select(*DOCUMENT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word Jaccard similarity 0.75 or more."""
    ship_code(spark)
    return setjoin.one_of_each(docs).select(*DOCUMENT)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.without_leaks(docs, _table(spark, sf_dir, "benchmark")).select(*DOCUMENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    ship_code(spark)
    return mixing.mixed(docs).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*DOCUMENT)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; a row for each document as read back from them."""
    import public_tokenizers

    ship_code(spark)
    return tokenfile.read(tokenfile.write(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: The classifier, the retrieval and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what the one before kept; each result is written as Parquet and read back."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
