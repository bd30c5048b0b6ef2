"""Self-referencing hierarchies (JOIN-13): paths from the root, in few rounds at any depth.

Pointer doubling: every node knows an ancestor, how far it is and the names in between. In a round each node takes its
ancestor's ancestor, so the known distance doubles, and a chain of d levels takes about log2(d) rounds of one join each.
A node is done when its ancestor is a root, or is done itself. As a tree has nodes at every depth up to its
greatest, a round in which no node gets done is the end: what is left lies on or below a cycle and never meets a root.
Rounds are written to the checkpoint folder, so the plan stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def hierarchy_paths(nodes: DataFrame, node: str = "id", parent: str = "parent_id", name: str = "name",
                    sep: str = "/") -> DataFrame:
    """(node, parent, root, depth, path, cyclic) for every node. Node ids are unique.

    Nodes whose parent is missing are roots. Nodes that no root reaches are returned too, marked, without root,
    depth and path.
    """
    checkpoint_dir(nodes.sparkSession)
    n = nodes.select(F.col(node).alias("_n"), F.col(parent).alias("_p"), F.col(name).cast("string").alias("_name"))
    ids = n.select(F.col("_n").alias("_up")).distinct()
    # a root has its name as path; another node starts with its parent, one level up, and its own name in between
    roots = (n.withColumn("_up", F.col("_p")).join(ids, "_up", "left_anti")
             .select("_n", "_p", F.col("_n").alias("_up"), F.lit(0).alias("_far"), F.col("_name").alias("_path")).checkpoint())
    open_nodes = (n.withColumn("_up", F.col("_p")).join(ids, "_up", "left_semi")
                  .select("_n", "_p", "_up", F.lit(1).alias("_far"), F.col("_name").alias("_path")).checkpoint())
    done = [roots]
    while not open_nodes.isEmpty():
        fresh, open_nodes = _doubled(done, open_nodes, sep)
        if fresh.isEmpty():
            break
        done.append(fresh)
    shown = done[0]
    for d in done[1:]:
        shown = shown.unionByName(d)
    shown = shown.withColumn("_c", F.lit(False)).unionByName(
        open_nodes.select("_n", "_p").withColumn("_c", F.lit(True)), allowMissingColumns=True)
    return shown.select(F.col("_n").alias(node), F.col("_p").alias(parent), F.col("_up").alias("root"),
                        F.col("_far").alias("depth"), F.col("_path").alias("path"), F.col("_c").alias("cyclic"))


def _doubled(done: list[DataFrame], open_nodes: DataFrame, sep: str) -> tuple[DataFrame, DataFrame]:
    """One round: (nodes that got done, those still open, with twice the distance)."""
    known = open_nodes.withColumn("_done", F.lit(False))
    for d in done:
        known = known.unionByName(d.withColumn("_done", F.lit(True)))
    above = known.select(F.col("_n").alias("_up"), F.col("_up").alias("_up2"), F.col("_far").alias("_far2"),
                         F.col("_path").alias("_path2"), "_done")
    step = (open_nodes.join(above, "_up")
            .select("_n", "_p", F.col("_up2").alias("_up"), (F.col("_far") + F.col("_far2")).alias("_far"),
                    F.concat("_path2", F.lit(sep), "_path").alias("_path"), "_done").checkpoint())
    return step.filter("_done").drop("_done"), step.filter(~F.col("_done")).drop("_done")
