"""Facets: directories that the pool of an ambiguous query falls into.

A directory is cut into its children while it covers more than a share of the pool. As counts
shrink downwards, the directories selected are exactly those whose parent exceeds the share
(or that have no parent): one explode, one aggregate, one self-join, no recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import ancestors, directory, facet_directory
from corvane.session import stage

POOL, MIN_CHUNKS, COVERAGE, LIMIT, SAMPLE = 300, 3, 0.25, 5, 3


def facets(pool: DataFrame, chunks: DataFrame, limit: int = LIMIT, coverage: float = COVERAGE, min_chunks: int = MIN_CHUNKS) -> DataFrame:
    """``query_id directory chunks best_rank symbols children facet_rank`` of a candidate pool (``query_id ord rank``).

    A pool that carries ``location`` and ``name`` of its chunks isn't joined with them.
    """
    rows = pool if {"location", "name"} <= set(pool.columns) else pool.join(chunks.select("ord", "location", "name"), "ord")
    rows = rows.select("query_id", "rank", "name", facet_directory(F.col("location")).alias("dir"))
    # a pool has far fewer directories than chunks, and what follows is about directories
    dirs = rows.groupBy("query_id", "dir").agg(F.count("*").alias("n"), F.min("rank").alias("best"), F.collect_list(F.struct("rank", "name")).alias("items"))
    dirs = stage(dirs, "pool-directories")  # read four times below
    total = dirs.groupBy("query_id").agg(F.sum("n").alias("total"))
    up = dirs.select("query_id", "n", "best", "dir", F.explode(ancestors(F.col("dir"))).alias("node"))
    under = up.groupBy("query_id", "node").agg(F.sum("n").alias("under"), F.min("best").alias("best_rank"))
    parents = under.select("query_id", F.col("node").alias("parent"), F.col("under").alias("parent_under"))
    selected = (
        under.withColumn("parent", directory(F.col("node")))
        .join(total, "query_id")
        .join(parents, ["query_id", "parent"], "left")
        .filter(F.col("parent_under").isNull() | (F.col("parent_under") > F.floor(F.col("total") * coverage)))
        .select("query_id", "node", "best_rank")
    )
    selected = stage(selected, "facet-nodes")
    # every directory goes to its deepest selected ancestor; of those, the deepest has most characters
    depth = up.select("query_id", "dir", "node").join(selected.select("query_id", "node"), ["query_id", "node"]).groupBy("query_id", "dir").agg(F.max(F.length("node")).alias("depth"))
    own = dirs.join(depth, ["query_id", "dir"]).withColumn("node", F.expr("left(dir, depth)"))
    below = F.when(F.col("dir") != F.col("node"), F.split_part(F.expr("substring(dir, length(node) + 2)"), F.lit("/"), F.lit(1)))
    grouped = own.groupBy("query_id", "node").agg(
        F.sum("n").alias("chunks"),
        F.array_sort(F.collect_set(below)).alias("children"),
        F.array_distinct(F.transform(F.array_sort(F.flatten(F.collect_list("items"))), lambda x: x["name"])).alias("symbols"),
    )
    out = grouped.filter(F.col("chunks") >= min_chunks).join(selected, ["query_id", "node"])
    w = Window.partitionBy("query_id").orderBy(F.desc("chunks"), "best_rank", "node")
    out = out.withColumn("facet_rank", F.row_number().over(w)).filter(F.col("facet_rank") <= limit)
    return out.withColumnRenamed("node", "directory")


def label() -> Column:
    """What a facet is shown as: directory, count and a few names."""
    more = F.size("children") - SAMPLE
    names = F.when(
        F.size("children") > 0,
        F.concat(F.lit(" — "), F.array_join(F.slice("children", 1, SAMPLE), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise("")),
    ).when(F.size("symbols") > 0, F.concat(F.lit(" — "), F.array_join(F.slice("symbols", 1, SAMPLE), ", ")))
    return F.concat("directory", F.lit(" · "), F.col("chunks").cast("string"), F.lit(" parça"), F.coalesce(names, F.lit("")))


def refined_query(base: Column) -> Column:
    """The query extended by the facet's own words, each once whatever its case."""
    extra = F.when(F.size("children") > 0, F.slice("children", 1, SAMPLE)).otherwise(F.slice("symbols", 1, SAMPLE))
    words = F.concat(F.array(base, F.element_at(F.split("directory", "/"), -1)), extra)
    kept = F.aggregate(
        words,
        F.array().cast("array<string>"),
        lambda out, x: F.when(F.exists(out, lambda y: F.lower(y) == F.lower(x)), out).otherwise(F.array_append(out, x)),
    )
    return F.array_join(kept, " ")


def within(hits: DataFrame, chunks: DataFrame, directories: DataFrame, k: int) -> DataFrame:
    """of a ranking, the first ``k`` at or below a directory (``query_id directory``)."""
    d = facet_directory(F.col("location"))
    rows = hits if "location" in hits.columns else hits.join(chunks.select("ord", "location"), "ord")
    rows = rows.join(directories, "query_id")
    rows = rows.filter((d == F.col("directory")) | F.startswith(d, F.concat("directory", F.lit("/"))))
    w = Window.partitionBy("query_id", "directory").orderBy("rank")
    return rows.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)
