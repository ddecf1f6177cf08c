"""Connected components by alternating stars, for graphs whose hubs may touch a third of all edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from namequarry.session import Files, work_dir, written


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least neighbour of u or u itself.

    The minimum is aggregated map-side, one row a node; joining it back is a sort-merge join, in which adaptive
    execution splits the partition of a hub over several tasks.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return edges.join(least, "u")


def component_stars(edges: DataFrame) -> DataFrame:
    """(u, v) for every node u of the bigint edges (u, v) that isn't the smallest of its component; v is that smallest node.

    Large and small stars alternate until nothing changes, in a number of rounds that is logarithmic in the size of a
    component, chains included. Each round is one table written to the shared folder, which also counts its changes, so
    lineage stays short, a lost executor costs one round, and no job only looks whether to go on. Self-loops and
    edges with a null end are left out; an empty table gives no row.
    """
    spark = edges.sparkSession
    root = work_dir(spark, "components")
    files = Files(spark, root)
    links = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links, step = written(links, f"{root}/round=0"), 0
    while True:
        step += 1
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # c: whether the edge was changed; if none is, every node had one link, to a node without links down
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") != F.col("u")).alias("c"))
        large = large.groupBy("u", "v").agg(F.max("c").alias("c"))
        small = _with_least(large).select("u", "v", "m", (F.col("c") | (F.col("v") != F.col("m"))).alias("c"))
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))
        small = small.select("c", F.inline(ends)).where("u <> v").groupBy("u", "v").agg(F.max("c").alias("c"))
        seen = Observation()
        links = written(small.observe(seen, F.max(F.col("c").cast("int")).alias("changed")).select("u", "v"), f"{root}/round={step}")
        if step > 1:
            files.delete(f"{root}/round={step - 2}")
        if not seen.get["changed"]:
            return links


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the bigint edges (u, v); label is the smallest node of its component.

    Self-loops give their node its own label; null ends are left out; an empty table gives no label.
    """
    whole = edges.where("u is not null and v is not null")
    nodes = whole.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(component_stars(whole), F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("label"))
