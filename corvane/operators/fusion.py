"""Reciprocal-rank fusion and weighting by information density."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def fuse(rankings: dict[str, DataFrame], pool: int, weights: dict[str, float] | None = None, rrf_k: int = RRF_K) -> DataFrame:
    """``query_id ord score sources rank``: the sum of weight / (60 + rank) over the rankings.

    Ties keep the order of first appearance: earlier ranking first, then rank within it.
    """
    union = None
    for i, (method, r) in enumerate(rankings.items()):
        part = r.select(
            "query_id", "ord", F.lit(i).alias("pos"), F.lit(method).alias("method"), "rank", F.lit(float((weights or {}).get(method, 1.0))).alias("weight")
        )
        union = part if union is None else union.unionAll(part)
    fused = union.groupBy("query_id", "ord").agg(
        F.sum(F.col("weight") / (rrf_k + F.col("rank"))).alias("score"),
        F.min(F.struct("pos", "rank")).alias("first"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "method"))), lambda x: x["method"]).alias("sources"),
    )
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "first")
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= pool).drop("first")


def reweigh(fused: DataFrame, weights: DataFrame) -> DataFrame:
    """Multiply fused scores by the chunk weights (``ord weight``) and rank again, stably."""
    scored = fused.join(weights, "ord").withColumn("score", F.col("score") * F.col("weight"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "rank")
    return scored.withColumn("new_rank", F.row_number().over(w)).drop("rank", "weight").withColumnRenamed("new_rank", "rank")
