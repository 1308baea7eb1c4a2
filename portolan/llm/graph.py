"""Connected components of links as Spark joins and groupings."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import settled

#: Edges that one file of a round holds.
EDGES_PER_FILE = 200_000


def _rounds(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a, b) with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the smallest node it is connected with.

    Alternates large-star and small-star steps until the edges stop changing, a
    number of rounds that grows with the logarithm of a component's size. Edges
    are checkpointed between rounds, in as many files as they fill and not in one
    for every shuffle partition. A node with very many links is reduced by partial
    aggregation, and its rows of a join are split by Spark's skew handling. Links of
    a node to itself and repeated links change nothing.
    """
    edges = settled(
        links.filter("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct()
    )
    state = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")))
    before = edges.select(state.alias("s")).first().s
    while before[0]:
        # a round has about as many edges as the one before, or fewer
        edges = settled(_rounds(edges).coalesce(ceil(before[0] / EDGES_PER_FILE)))
        now = edges.select(state.alias("s")).first().s
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
