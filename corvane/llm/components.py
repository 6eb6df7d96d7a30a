"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import stage


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    # edges point from the larger to the smaller end
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    linked = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return linked.unionAll(low.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """``node root`` for every node of an edge: root is the least node of its component.

    ``edges`` has two columns of numbers; self-loops, nulls and repeated edges don't matter.
    Each round is written to the shared folder, so lineage stays short and no round is lost.
    """
    a, b = edges.columns
    e = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = stage(e.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    seen = None
    for _ in range(limit):
        e = stage(_small_star(_large_star(e).distinct()).distinct(), "stars")
        now = e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint")), F.sum("b")).first()
        if tuple(now) == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = tuple(now)
    raise RuntimeError(f"components did not settle in {limit} rounds")
