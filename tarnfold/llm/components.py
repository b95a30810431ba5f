"""Connected components of a link table, by star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, stored


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """Every node hands its larger (or else its smaller) neighbours to the smallest node that it knows.

    The least neighbours are stored before they are joined, so that the join's sides are plain shuffles: those Spark
    can split where one node has very many neighbours, which it can't if it has to aggregate in the same stage.
    Returns the new edges and that table.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = stored(least, "least")
    met = both.join(least, "u")
    if large:
        return met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b"), least
    out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct(), least


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node has one edge to a root, and no root one to another: then every component is a star."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out")), F.struct(F.col("b").alias("node"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.count_if(F.col("out") == 0).alias("in"))
    return nodes.where((F.col("out") > 1) | (F.col("out") == 1) & (F.col("in") > 0)).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node but the roots, from links (a, b), a stored table; the root is the least node.

    Ends when stars are left; it takes about log(n) steps.
    """
    edges = links.select("a", "b").where("a <> b")  # read twice
    while True:
        for large in (True, False):
            new, least = _star(edges, large)
            new = stored(new, "links")
            released(least)
            released(edges)
            edges = new
        if _stars_only(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
