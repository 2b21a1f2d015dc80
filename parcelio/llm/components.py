"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelio.llm.shared import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    least = _both_ways(edges).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    upwards = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return upwards.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """As many edges as before: the one to the least node stays, the others go from their lower end to it."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def _settled(edges: DataFrame) -> bool:
    """Whether every upper end has one lower end, which is no upper end: then a round changes nothing."""
    upper = edges.select(F.col("u").alias("node"), F.col("v").alias("lower"))
    lower = edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("lower"))
    # A node is a lower end where `lower` is null.
    nodes = upper.unionAll(lower).groupBy("node").agg(F.min("lower").alias("lo"), F.max("lower").alias("hi"), F.max(F.col("lower").isNull()).alias("below"))
    return not nodes.agg(F.max(F.expr("lo < hi OR (below AND lo IS NOT NULL)"))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """`node`, `label` for every node of `links` (`a`, `b`): the least node it reaches.

    Edges with a null end or two equal ends are ignored; repeats and both
    directions are fine; no edges give no rows. Every node ends with one edge
    to its label, after a number of rounds that grows with the logarithm of the
    longest path; links that are stars around their least nodes need none. Each
    round is written to the shared folder, as are the labels. The driver keeps
    a record of every task, so a round has few exchanges, and a grouping of the
    ends, not one more round, tells when all is done. A node with very many
    edges is only ever reduced by `min` (combined before the shuffle) and
    joined back, where adaptive execution can split it.
    """
    edges = links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")
    )
    while not _settled(edges):
        edges = written(_small_star(_large_star(edges)), "stars")
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("label")))
    return written(ends.groupBy("node").agg(F.min("label").alias("label")), "labels")
