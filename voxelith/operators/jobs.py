"""Job tables: folds and file formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expand_folds(jobs: DataFrame, suffix: str = "_fp16.onnx", strict: bool = True) -> DataFrame:
    """job_id, pos, model: one row for each entry of a comma-separated fold list.

    Empty entries are dropped, `all` is 0 to 4, an empty list is fold 0; a digit names fold_<digit><suffix>. Other whole numbers
    are no folds: they end the job with a message, or give a null model with `strict` off. Anything else is a file's name.
    """
    spec = F.when(F.trim("folds") == "all", "0,1,2,3,4").when(F.trim("folds") == "", "0").otherwise(F.col("folds"))
    items = F.filter(F.split(spec, ","), lambda s: s != "")
    model = F.when(F.col("item").rlike("^[0-9]$"), F.concat(F.lit("fold_"), "item", F.lit(suffix)))
    refused = F.raise_error(F.concat(F.lit("folds are 0 to 9, not "), "item")).cast("string") if strict else F.lit(None).cast("string")
    model = model.when(F.col("item").rlike(r"^[+-]?[0-9]+(\.[0-9]*)?$"), refused).otherwise(F.col("item"))
    return jobs.select("job_id", F.posexplode(items).alias("pos", "item")).select("job_id", "pos", model.alias("model"))


def file_format(path: Column) -> Column:
    """jnii, bnii or nii by the path's ending, whatever its case."""
    return F.when(F.lower(path).endswith(".jnii"), "jnii").when(F.lower(path).endswith(".bnii"), "bnii").otherwise("nii")


def is_image(path: Column) -> Column:
    """Whether the ending is one that strict callers accept."""
    return F.lower(path).rlike(r"\.(nii(\.gz)?|jnii|bnii)$")
