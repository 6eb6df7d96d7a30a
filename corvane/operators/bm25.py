"""Okapi BM25 for batches of queries, per scope.

A scope is a code base with its own statistics (here: a project). Terms are exploded once;
document lengths, document frequencies and the mean idf are aggregates with map-side
combining; queries meet the chunks of their scope in blocks (``corvane.operators.blocks``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import tokenize
from corvane.operators import blocks
from corvane.session import stage


@dataclass(frozen=True)
class BM25:
    """Constants of the Okapi variant: idf may be negative, then a share of the mean replaces it."""

    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


def terms(chunks: DataFrame) -> DataFrame:
    """``scope ord tokens`` of every chunk, over name, context and text."""
    text = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("context", F.lit("")), F.coalesce("text", F.lit("")))
    return chunks.select(F.col("project_id").alias("scope"), "ord", tokenize(text).alias("tokens"))


def postings(tokens: DataFrame) -> DataFrame:
    """``scope ord term dl tf``. Tokens partitioned by ``ord`` stay where they are."""
    rows = tokens.select("scope", "ord", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return rows.groupBy("scope", "ord", "term", "dl").agg(F.count("*").alias("tf"))


def lengths(tokens: DataFrame) -> DataFrame:
    """``scope ord dl``, documents without a term included."""
    return tokens.select("scope", "ord", F.size("tokens").alias("dl"))


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id scope term qtf`` of queries with columns ``query_id scope text``."""
    return (
        queries.select("query_id", "scope", F.explode(tokenize(F.col("text"))).alias("term"))
        .groupBy("query_id", "scope", "term")
        .agg(F.count("*").alias("qtf"))
    )


def idf(post: DataFrame, length: DataFrame, p: BM25) -> DataFrame:
    """``scope term idf`` with the floor for terms in more than half of the documents."""
    size = length.groupBy("scope").agg(F.count("*").alias("n"))
    df = post.groupBy("scope", "term").agg(F.count("*").alias("df")).join(size, "scope")
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    df = df.withColumn("raw", raw)
    mean = df.groupBy("scope").agg(F.avg("raw").alias("mean_idf"))
    return df.join(mean, "scope").select("scope", "term", F.when(F.col("raw") < 0, p.epsilon * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))


def asked(queries: DataFrame, provider: str = "md5") -> DataFrame:
    """``query_id scope key`` of queries (``query_id scope text``) with their counts; queries of one ``key`` have the same terms."""
    t = queries.select("query_id", "scope", tokenize(F.col("text")).alias("tokens"))
    t = t.select("query_id", "scope", F.array_join(F.sort_array("tokens"), " ").alias("key"), F.array().cast("array<string>").alias("also"), "tokens")
    return stage(blocks.counted(t, provider), "asked")


def weighted(asked: DataFrame, weights: DataFrame, length: DataFrame) -> DataFrame:
    """``asked`` with the terms that occur in its scope, their ``weights``, and the scope's ``avgdl``."""
    mean = length.groupBy("scope").agg(F.avg("dl").alias("avgdl"))
    once = asked.select("scope", "key", "terms", "tfs").dropDuplicates(["scope", "key"])
    each = once.select("scope", "key", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("scope", "key", F.col("t.terms").alias("term"), F.col("t.tfs").alias("qtf"))
    each = each.join(weights, ["scope", "term"]).groupBy("scope", "key").agg(F.sort_array(F.collect_list(F.struct("term", (F.col("qtf") * F.col("idf")).alias("w")))).alias("t"))
    each = each.join(mean, "scope").select("scope", "key", F.col("t.term").alias("terms"), F.col("t.w").alias("weights"), "avgdl")
    return stage(asked.drop("terms", "tfs").join(each, ["scope", "key"], "left"), "query-terms")


def search(queries: DataFrame, tokens: DataFrame, k: int, p: BM25 | None = None) -> DataFrame:
    """``query_id ord score rank``: the best ``k`` with a positive score; ties go to the smaller ``ord``."""
    p = p or BM25()
    c = tokens.select("scope", "ord", F.size("tokens").alias("dl"), F.lit(1.0).alias("weight"), F.array().cast("array<string>").alias("also"), "tokens")
    q = weighted(asked(queries), idf(postings(tokens), lengths(tokens), p), lengths(tokens))
    return blocks.ranked(q, blocks.counted(c), k, ("bm25",), (p.k1, p.b)).select("query_id", "ord", "score", "rank")


def top(scored: DataFrame, k: int) -> DataFrame:
    """Rank by score within a query and keep the best ``k``."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
