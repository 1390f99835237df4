"""Queries op1 to op13 and the pipeline over the given tables, and their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from voxelith.llm import decontam, fillmiddle, html_text, linededup, media, mixing, nearest, pii, quality, queries_sql, secrets, setjoin, tokenfile, veccodes
from voxelith.session import ship_code


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_main_text(pages).withColumn("n_chars", F.length("text").cast("long"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenfile.read(tokenfile.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.copy_classes(media.rendered(table(spark, sf_dir, "embeddings")))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.similar_components(table(spark, sf_dir, "documents"))


def _joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base, spans = F.col("base"), F.col("spans")
    return found.select("doc_id", *(_count(base, k) for k in pii.KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.without_repeated_lines(table(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    base, spans = F.filter("spans", lambda s: s["base"]), F.col("spans")
    return found.select("doc_id", *(_count(base, r.kind) for r in secrets.RULES if r.base), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = veccodes.compress(table(spark, sf_dir, "embeddings"))
    coded = veccodes.with_label_errors(coded)
    return coded.select("vec_id", "code", "error", "label_error", F.lit(veccodes.digest(books)).alias("codebooks_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fillmiddle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = fillmiddle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_source_mixing": op2_source_mixing,
    "op3_media_copies": op3_media_copies,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_token_files": op5_token_files,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_pii": op7_pii,
    "op8_line_dedup": op8_line_dedup,
    "op9_secret_scans": op9_secret_scans,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_vector_codes": op12_vector_codes,
    "op13_fill_in_middle": op13_fill_in_middle,
    "pipeline": corpus_pipeline.run,
}
SQL: dict[str, str] = {"op2_source_mixing": queries_sql.OP2, "op4_ngram_jaccard_join": queries_sql.OP4, "op8_line_dedup": queries_sql.OP8, "op12_vector_codes": queries_sql.OP12, "op13_fill_in_middle": queries_sql.OP13}
