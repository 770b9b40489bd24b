"""Connected components of links, by alternating stars (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselight.session import new_path


def _written(rows: DataFrame, name: str) -> DataFrame:
    """The rows from a table in the shared folder: lineage ends there."""
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours, and its smaller ones, hung on its least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = large.filter("u > v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    small = down.join(least, "u")
    return (
        small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node; a component is named by its least node.

    ``links`` (a, b) may repeat, go either way and hold loops. Rounds are about
    the logarithm of the longest path; each ends in a table in the shared folder.
    A node with very many links is a hot join key on one side only, which
    adaptive execution splits; minima are combined before the shuffle.
    """
    edges = links.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    edges, seen = _written(edges.distinct(), "links"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        edges = _written(_star(edges), "stars")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
