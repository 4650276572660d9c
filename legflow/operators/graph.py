"""Connected components of an edge table, without bringing edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legflow.session import ensure_checkpoint_dir


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour below it, shortens
    the resulting trees by pointer jumping, and contracts the edges; edges
    inside one tree go.  Rounds end when no edge is left, so there is no cap.
    Minima are combined before the shuffle, and joins read written tables, so
    a node with very many edges is split by adaptive skew handling.  Null
    ends and loops give no edge; an empty table gives an empty result.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    edges = (edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
             .distinct().checkpoint())
    roots = None
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = (both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
                  .select("node", F.least("node", "low").alias("root")).checkpoint())
        moved = True
        while moved:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            longer = parent.join(up, "root").select(
                "node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")).checkpoint()
            moved = bool(longer.filter("moved").take(1))
            parent = longer.select("node", "root")
        if roots is None:
            roots = parent
        else:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
            roots = roots.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")).checkpoint()
        left = parent.select(F.col("node").alias("u"), F.col("root").alias("a"))
        right = parent.select(F.col("node").alias("v"), F.col("root").alias("b"))
        edges = (edges.join(left, "u").join(right, "v").filter("a <> b")
                 .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct().checkpoint())
    if roots is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots
