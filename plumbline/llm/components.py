"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.workspace import keep, keep_result


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _to_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (b, m) for the edges (a, b): m is a's least neighbour. A vertex with very many
    neighbours is a skewed join key, which Spark splits."""
    return edges.join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).filter("a != b")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _to_least(both.filter("b > a"), least)


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = _to_least(edges, least)
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (id, component) for every vertex of edges (a, b): component is the least id reachable.

    Alternates large-star and small-star until the edges are stars around the
    least vertices; the number of rounds grows with the logarithm of the vertices.
    """

    def rounds() -> DataFrame:
        e = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
        before = None
        while True:
            mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
            if mark == before:
                break
            before = mark
            e = keep(_small_star(_large_star(e)), "edges")
        stars = e.select(F.col("a").alias("id"), F.col("b").alias("component"))
        return stars.unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())

    return keep_result(edges.sparkSession, rounds, "components")
