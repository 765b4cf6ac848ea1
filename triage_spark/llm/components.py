"""Connected components of a table of links, by alternating large and small stars.

Each round links every node's larger neighbours to its least neighbour (large
star), then its smaller ones (small star), until nothing changes; a number of rounds that
grows with the square of the logarithm of the longest chain.  Least neighbours are partial aggregates and
go back by joins, so a node with very many links is split like any skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage_spark.llm.common import saved


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("u")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    moved = down.join(least, F.col("a") == F.col("u")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of ``links`` (a, b: long); only nodes with a link to another."""
    links = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    n, moved = links.count(), True
    while n and moved:
        last, before = links, n
        links = saved(_small_star(_large_star(last)), "links")
        n = links.count()
        # Both hold distinct links: as many, and none that the last round did not have, are the same ones.
        moved = n != before or not links.join(last, ["a", "b"], "left_anti").isEmpty()
    # Only stars are left: each node points to its root.
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
