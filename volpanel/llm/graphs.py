"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.llm.frames import cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b): the least node that it reaches.

    Alternating large and small stars: every node's larger neighbours, then its smaller
    ones, move to its least neighbour, until nothing changes.  Minima are partial
    aggregates, and a hub is a skewed join, which Spark splits; only two numbers a round
    come to the driver.
    """
    edges = cut(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where((F.col("b") > F.col("a")) & (F.col("b") != F.col("m"))).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        new = cut(small.select("e.a", "e.b").where(F.col("a") != F.col("b")).distinct())
        after = _mark(new)
        if after == mark:
            break
        edges, mark = new, after
    roots = new.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return new.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
