"""From scores to classes. `logits` is one array a voxel, never a row a channel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Target bin of each of the 18 classes, and the bin that stands for background.
MERGE_18_TO_6 = (5, 0, 1, 2, 2, 0, 0, 0, 0, 0, 0, 0, 0, 3, 4, 3, 4, 0)
AIR = 5

#: Id, label, name, source label, red, green, blue, alpha.
LABELS_18 = (
    (0, "Background", "Background", "Background", 0.0, 0.0, 0.0, 0.0),
    (1, "GM", "Cerebral gray matter", "GM", 0.7, 0.7, 0.7, 1.0),
    (2, "WM", "Cerebral white matter", "WM", 0.95, 0.95, 0.95, 1.0),
    (3, "CSF", "Cerebrospinal fluid", "CSF", 0.0, 0.6, 0.9, 1.0),
    (4, "CSFv", "Ventricular cerebrospinal fluid", "CSFv", 0.0, 0.3, 0.7, 1.0),
    (5, "CerebellumGM", "Cerebellar gray matter", "CerGM", 0.55, 0.55, 0.55, 1.0),
    (6, "Thalamus", "Thalamus", "Thal", 0.8, 0.4, 0.3, 1.0),
    (7, "Pallidum", "Globus pallidus", "Pal", 0.95, 0.6, 0.1, 1.0),
    (8, "Putamen", "Putamen", "Put", 0.7, 0.2, 0.2, 1.0),
    (9, "Caudate", "Caudate nucleus", "Caud", 0.95, 0.85, 0.2, 1.0),
    (10, "Accumbens", "Nucleus accumbens", "Accu", 0.55, 0.35, 0.2, 1.0),
    (11, "Amygdala", "Amygdala", "Amyg", 0.45, 0.85, 0.45, 1.0),
    (12, "Hippocampus", "Hippocampus", "Hippo", 0.15, 0.55, 0.2, 1.0),
    (13, "Dura", "Dura mater", "Dura", 0.7, 0.6, 0.4, 1.0),
    (14, "Vascular", "Blood vessels", "Vascular", 0.8, 0.05, 0.05, 1.0),
    (15, "Skull", "Skull", "Skull", 0.9, 0.85, 0.55, 1.0),
    (16, "Head", "Extracranial soft tissue", "Head", 0.95, 0.75, 0.65, 1.0),
    (17, "Anomalies", "Anomalies", "Anomalies", 1.0, 0.0, 1.0, 1.0),
)
LABELS_6 = (
    (0, "GM", "Gray matter", None, 0.7, 0.7, 0.7, 1.0),
    (1, "WM", "White matter", None, 0.95, 0.95, 0.95, 1.0),
    (2, "CSF", "Cerebrospinal fluid", None, 0.0, 0.6, 0.9, 1.0),
    (3, "Bone", "Bone", None, 0.9, 0.85, 0.55, 1.0),
    (4, "Soft", "Soft tissue", None, 0.95, 0.75, 0.65, 1.0),
    (5, "Air", "Air", None, 0.0, 0.0, 0.0, 0.0),
)


def label_table(spark: SparkSession) -> DataFrame:
    """class_set, id, label, name, src_label, rgba for the two known class sets; other sets have no table."""
    rows = [(s, i, a, b, c, [r, g, bl, al]) for s, t in (("tissue18", LABELS_18), ("tissue6", LABELS_6)) for i, a, b, c, r, g, bl, al in t]
    return spark.createDataFrame(rows, "class_set string, id int, label string, name string, src_label string, rgba array<double>")


def ensemble_mean(rows: DataFrame, keys: Sequence[str], classes: int) -> DataFrame:
    """Mean of the folds' logits, before any softmax."""
    return rows.groupBy(*keys).agg(F.array(*(F.avg(F.col("logits")[c]) for c in range(classes))).alias("logits"))


def argmax(logits: Column) -> Column:
    """Position of the first largest entry."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Entries over the temperature, less the largest, exponentiated and normalised."""
    if temperature <= 0:
        raise ValueError("the temperature must be above 0")
    e = exponentials(F.transform(logits, lambda v: v / temperature) if temperature != 1.0 else logits)
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def exponentials(logits: Column) -> Column:
    return F.transform(logits, lambda v: F.exp(v - F.array_max(logits)))


def merge(p: Column, bins: Sequence[int] = MERGE_18_TO_6) -> Column:
    """Sums over each target bin; nothing is normalised again."""
    own = [[c for c, b in enumerate(bins) if b == k] for k in range(max(bins) + 1)]
    return F.array(*(sum((p[c] for c in cs[1:]), p[cs[0]]) if cs else F.lit(0.0) for cs in own))


def merged_argmax(logits: Column, bins: Sequence[int] = MERGE_18_TO_6) -> Column:
    """The bin with the largest total probability, which need not hold the most probable class."""
    return argmax(merge(exponentials(logits), bins))


def remap(label: Column, bins: Sequence[int] = MERGE_18_TO_6) -> Column:
    """Target bin of a label that is already decided."""
    return F.element_at(F.array(*(F.lit(b) for b in bins)), label + 1)


def named(labels: DataFrame, table: DataFrame, class_set: str) -> DataFrame:
    """`labels` with label name, full name, source label and colour; unknown labels keep nulls."""
    t = F.broadcast(table.filter(F.col("class_set") == class_set).select(F.col("id").alias("label"), F.col("label").alias("token"), "name", "src_label", "rgba"))
    return labels.join(t, "label", "left")


def nonfinite(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with an entry that is not a finite number, counted by `keys`, and whether the group has to be set aside."""
    bad = F.exists("logits", lambda v: F.isnan(v) | (F.abs(v) == float("inf")) | v.isNull())
    return rows.groupBy(*keys).agg(F.sum(bad.cast("long")).alias("bad_rows"), F.max(bad).alias("quarantine"))
