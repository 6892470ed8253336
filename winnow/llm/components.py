"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm._common import discard, materialise

SPLIT = 1_000_000  # links from which least ends are written before they are joined


def _mark(edges: DataFrame) -> tuple:
    """The number of ``edges`` and the sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """From (a, b), undirected, to (node, component): the smallest node that each node reaches.

    Only nodes that have a link to another come out. Each round is a shuffle of the
    links, and rounds grow with the logarithm of the longest path. A node's least end is
    aggregated before the shuffle; from ``SPLIT`` links on it is written, so that the join that follows is
    one of two plain shuffles, in which Spark splits a node with very many links. Rounds end when
    number and hash sum of the links stay. Null ends and links from a node to itself are ignored; repeated links count once.
    """
    edges = materialise(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(edges)
    while True:
        apart = materialise if mark[0] >= SPLIT else lambda df: df
        made = []
        # a link's first end is the larger one in all rounds; each link is read once for both of its ends
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        least = apart(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = edges.toDF("b", "a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        made.append(least)
        large = apart(large.distinct())
        least = apart(large.groupBy("a").agg(F.min("b").alias("m")))
        made += [large, least]
        near = large.join(least, "a")
        small = near.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after = materialise(small)
        for done in (edges, *(made if mark[0] >= SPLIT else [])):
            discard(done)
        edges, before, mark = after, mark, _mark(after)
        if mark == before:
            roots = edges.select(F.col("b").alias("node")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
