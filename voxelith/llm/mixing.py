"""Mixing sources to target weights with hash-threshold histograms.

A document's place in its source's order is a hash of its id. Words are summed by source and hash bucket;
the bucket in which a budget is used up is the only one looked at more closely, at the next 12 bits of the
hash, until the order is resolved. What remains is one hash threshold for each source, so the documents are
filtered in one pass, without a sort and without a row number, and reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelith.llm.common import small, stored, word_count

#: Bits of the hash and of one level's bucket.
HASH_BITS, LEVEL_BITS = 36, 12
#: Sources at most whose thresholds are broadcast; beyond that they are joined.
SOURCES_MAX = 100_000


def place(doc_id: Column) -> Column:
    """The first 36 bits of the md5 of the id's text; a null id counts as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(totals: DataFrame, weights: Sequence[int], share: float, repeat: int) -> DataFrame:
    """source, source_size, target. Sources by code point, null last, weigh `weights`, repeating.

    Targets share `share` of all sizes by weight; none is above `repeat` times its source's size. Capped
    sources are a prefix of the order by size per weight, so one pass of running sums finds them. There is
    one row for each source here.
    """
    ordered = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1).cast("long")
    w = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    until, frm = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    steps = ordered.withColumn("weight", weight).withColumn("cap", repeat * F.col("source_size")).withColumns(
        {"budget": share * F.sum("source_size").over(everything), "capped_before": F.coalesce(F.sum("cap").over(until), F.lit(0)), "weight_left": F.sum("weight").over(frm)}
    )
    level = (F.col("budget") - F.col("capped_before")) / F.col("weight_left")
    steps = steps.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    final = F.max(F.when(~F.col("capped"), F.struct(-F.col("capped_before"), F.col("level")))).over(everything)["level"]
    return steps.withColumn("final", final).select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """source, source_size, target, base, below: each document is taken `base` times, and once more if its place is under `below`."""
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("base", base).withColumn("rest", F.col("target") - F.col("base") * F.col("source_size"))
    open_, prefix = goals.withColumn("prefix", F.lit(0).cast("long")), F.lit(0).cast("long")
    for left in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        prefix = F.shiftright(F.col("place"), left + LEVEL_BITS)
        bucket = F.shiftright(F.col("place"), left)
        inside = sizes.alias("s").join(small(open_.select(F.col("source").alias("source_"), F.col("prefix").alias("prefix_")), SOURCES_MAX), F.col("s.source").eqNullSafe(F.col("source_")) & (prefix == F.col("prefix_")))
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0)))
        hit = sums.alias("h").join(open_.alias("o"), F.col("h.source").eqNullSafe(F.col("o.source")) & (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("h.words")))
        open_ = stored(hit.select("o.source", "source_size", "target", "base", (F.col("rest") - F.col("before")).alias("rest"), F.col("bucket").alias("prefix"), "h.words"), "boundary")
    below = open_.select(F.col("source").alias("source_"), (F.col("prefix") + F.when(2 * F.col("rest") >= F.col("words"), 1).otherwise(0)).alias("below"))
    return goals.join(below, F.col("source").eqNullSafe(F.col("source_")), "left").select("source", "source_size", "target", "base", F.coalesce("below", F.lit(0)).alias("below"))


def mixed(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, repeat: int = 2) -> DataFrame:
    """`docs` (doc_id, text, source and others) with size, source_size, target and copies of every row.

    size counts words between ASCII white space (null text: 0). copies is how often the mix takes the
    document, at most `repeat`; a source's taken words come as near to its target as whole documents allow.
    Rows of one doc_id share one place in the order and are taken alike. Null sources are one source, last;
    an empty table gives an empty result. Columns of docs with the new names are replaced.
    """
    added = ("size", "source_size", "target", "copies")
    docs = docs.drop(*added)
    sizes = stored(docs.select("source", word_count(F.col("text")).alias("size"), place(F.col("doc_id")).alias("place")), "sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    limits = stored(thresholds(sizes, stored(targets(totals, weights, share, repeat), "targets")), "thresholds")
    limits = small(limits.withColumnRenamed("source", "source_"), SOURCES_MAX)
    out = docs.join(limits, docs["source"].eqNullSafe(F.col("source_")), "left")
    # where a target is `repeat` times its source's size, nothing is left for a further copy, not even of an empty text
    copies = F.least(F.col("base") + F.when(place(docs["doc_id"]) < F.col("below"), 1).otherwise(0), F.lit(repeat))
    return out.select(*[docs[c] for c in docs.columns], word_count(docs["text"]).alias("size"), "source_size", "target", copies.cast("int").alias("copies"))
