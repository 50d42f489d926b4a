"""Connected components of a table of links, by alternating large and small stars."""

from pyspark.sql import DataFrame, functions as F

from logloom.session import cut_lineage


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on (a, b) with a > b."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
    large = (
        both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()
    )
    least = large.groupBy("a").agg(F.min("b").alias("least"))
    met = large.join(least, "a")
    return (
        met.select("a", F.col("least").alias("b"))
        .union(met.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")))
        .distinct()
    )


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one root and no root hangs on another node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs")).union(edges.select("b", F.lit(0)))
    node = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.count("*").alias("n"))
    return node.where("hangs > 1 OR hangs = 1 AND n > 1").isEmpty()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from every node of ``links`` (a, b); roots too.

    Links may repeat, go either way or join a node with itself. Nodes are of any type with an order. No links, no rows.
    """
    edges = cut_lineage(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    for _ in range(rounds):
        if _settled(edges):
            break
        edges = cut_lineage(_stars(edges))
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
