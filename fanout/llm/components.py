"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so no component is gathered anywhere. A hub's neighbours are
reduced on the map side; the join that hands a node's minimum to its neighbours is a plain equi-join that
adaptive execution splits when one node is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanout.llm.shared import discard, swept, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (
        both.join(least, "a")
        .filter(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .filter("a <> b")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come as (larger, smaller)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame):
    with swept(edges.sparkSession):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, root) for every id that has a link to another one; the root is the component's least id.

    Loops, repeated and reversed links count once. An empty table gives an empty one.
    """
    edges = written(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), "edges"
    )
    state = _state(edges)
    while True:
        before, edges = edges, written(_small_star(_large_star(edges)), "edges")
        discard(before)
        after = _state(edges)
        if after == state:
            break
        state = after
    members = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return members.union(roots)
