"""Connected components of a table of links, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelith.llm.common import drop_stored, gathered


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node of a link; comp is the smallest node that it reaches.

    Each round hooks every node to the smallest node within two steps, follows the hooks to their ends,
    and contracts the links to those ends; it stops when no link between different nodes is left. Grouped
    minima are combined before they are shuffled and joins are plain equi-joins, so a node with very many
    links is no single task's work. Each round's table goes to the shared folder.
    """
    edges = gathered(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "edges")
    total = gathered(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("comp", F.col("node")), "components")
    while edges.head(1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        one = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        near = both.join(one.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("m").alias("m"))
        hooks = gathered(one.join(near.withColumnRenamed("m", "m2"), "u").select("u", F.least("m", "m2").alias("p")), "hooks")
        while True:  # hooks only go to smaller nodes, so this ends at the roots
            nxt = gathered(hooks.alias("x").join(hooks.alias("y"), F.col("x.p") == F.col("y.u")).select(F.col("x.u").alias("u"), F.col("y.p").alias("p"), (F.col("y.p") != F.col("x.p")).alias("moved")), "hooks")
            drop_stored(hooks)
            hooks = nxt
            if not hooks.filter("moved").head(1):
                break
        to = hooks.select("u", F.col("p").alias("pv"))
        nxt_edges = gathered(edges.join(hooks.select("u", "p"), "u").join(to.withColumnRenamed("u", "v"), "v").select(F.col("p").alias("u"), F.col("pv").alias("v")).filter("u <> v").distinct(), "edges")
        nxt_total = gathered(total.join(hooks.select(F.col("u").alias("comp"), "p"), "comp", "left").select("node", F.coalesce("p", "comp").alias("comp")), "components")
        drop_stored(edges, total, hooks)
        edges, total = nxt_edges, nxt_total
    drop_stored(edges)
    return total
