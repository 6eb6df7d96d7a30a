"""List expansion: steps that append to the head of a ranking and never remove from it.

The sequential "first of each path not yet there" loops have closed forms: a path is absent
from the head exactly if its best rank lies beyond it, so each step is one or two windows.
Stages keep the columns ``query_id pos ord path score stage``; paths are those of one scope,
carried as ``scope``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import RELATIVE_IMPORT, directory, resolve_relative_import
from corvane.session import stage

SCAN, FILE_SLOTS, DIRECTORY_SLOTS, REFERENCE_SLOTS, MAX_USERS, HUB_USERS, STRONG_FILES = 60, 4, 2, 2, 5, 25, 2

_COLS = ["query_id", "scope", "ord", "path", "score", "stage", "at"]


def with_paths(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """A ranking with the ``scope`` and ``path`` of its chunks, where it doesn't carry them already."""
    if {"scope", "path"} <= set(ranked.columns):
        return ranked
    return ranked.join(chunks.select("ord", F.col("project_id").alias("scope"), "path"), "ord")


def _first(df: DataFrame, partition: list[str], order: list, n: int, out: str = "slot") -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)


def head(ranked: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of a ranking with paths (``query_id scope ord path score rank``)."""
    return ranked.filter(F.col("rank") <= k).select("query_id", "scope", "ord", "path", "score", F.lit(0).alias("stage"), F.col("rank").alias("at"))


def unseen_files(ranked: DataFrame, k: int, slots: int = FILE_SLOTS, scan: int = SCAN) -> DataFrame:
    """The first chunk of each path whose best rank lies in (k, scan], at most ``slots``."""
    best = F.min("rank").over(Window.partitionBy("query_id", "scope", "path"))
    new = ranked.withColumn("m", best).filter((F.col("rank") == F.col("m")) & (F.col("m") > k) & (F.col("m") <= scan))
    new = _first(new, ["query_id"], ["rank"], slots)
    return new.select("query_id", "scope", "ord", "path", "score", F.lit(1).alias("stage"), F.col("slot").alias("at"))


def sibling_files(ranked: DataFrame, selected: DataFrame, slots: int = DIRECTORY_SLOTS, scan: int = SCAN) -> DataFrame:
    """New files from directories that hold two or more distinct selected files."""
    files = selected.select("query_id", "scope", "path").distinct()
    strong = files.groupBy("query_id", "scope", directory(F.col("path")).alias("dir")).agg(F.count("*").alias("n")).filter(F.col("n") >= STRONG_FILES)
    pool = ranked.filter(F.col("rank") <= scan).withColumn("dir", directory(F.col("path")))
    new = pool.join(files, ["query_id", "scope", "path"], "left_anti").join(strong, ["query_id", "scope", "dir"], "left_semi")
    new = _first(new, ["query_id", "scope", "path"], ["rank"], 1, "nth")
    new = _first(new, ["query_id"], ["rank"], slots)
    return new.select("query_id", "scope", "ord", "path", "score", F.lit(2).alias("stage"), F.col("slot").alias("at"))


def relative_imports() -> Column:
    """Dots and name of every relative import in a ``text``."""
    return F.arrays_zip(
        F.regexp_extract_all("text", F.lit(RELATIVE_IMPORT), F.lit(1)).alias("dots"), F.regexp_extract_all("text", F.lit(RELATIVE_IMPORT), F.lit(2)).alias("name")
    )


def import_edges(chunks: DataFrame) -> DataFrame:
    """``scope importer target`` of relative imports between files that have a module chunk.

    Chunks without their texts have a column ``imports`` instead.
    """
    modules = chunks.filter(F.col("kind") == "module")
    found = F.col("imports") if "imports" in chunks.columns else relative_imports()
    raw = modules.select(F.col("project_id").alias("scope"), F.col("path").alias("importer"), F.explode(found).alias("i"))
    edges = raw.select("scope", "importer", resolve_relative_import(F.col("importer"), F.col("i.dots"), F.col("i.name")).alias("target"))
    known = modules.select(F.col("project_id").alias("scope"), F.col("path").alias("target")).distinct()
    return edges.filter("target is not null and target <> importer").join(known, ["scope", "target"], "left_semi").distinct()


def module_chunks(chunks: DataFrame) -> DataFrame:
    """``scope path ord`` of each file's module chunk, the last one where there are several."""
    return chunks.filter(F.col("kind") == "module").groupBy(F.col("project_id").alias("scope"), "path").agg(F.max("ord").alias("ord"))


def referencing_files(selected: DataFrame, edges: DataFrame, modules: DataFrame, slots: int = REFERENCE_SLOTS, max_users: int = MAX_USERS) -> DataFrame:
    """Files that import a selected file which few files import, in the order of the selection."""
    users = edges.groupBy("scope", "target").agg(F.count("*").alias("users")).filter(F.col("users").between(1, max_users))
    chosen = selected.groupBy("query_id", "scope", "path").agg(F.min(F.struct("stage", "at")).alias("place"))
    hit = chosen.join(edges.withColumnRenamed("target", "path"), ["scope", "path"]).join(users.select("scope", F.col("target").alias("path")), ["scope", "path"])
    hit = hit.select("query_id", "scope", F.col("importer").alias("path"), "place")
    hit = hit.join(chosen.select("query_id", "scope", "path"), ["query_id", "scope", "path"], "left_anti")
    new = hit.groupBy("query_id", "scope", "path").agg(F.min("place").alias("place"))
    new = _first(new, ["query_id"], ["place", "path"], slots).join(modules, ["scope", "path"])
    return new.select("query_id", "scope", "ord", "path", F.lit(0.0).alias("score"), F.lit(3).alias("stage"), F.col("slot").alias("at"))


def imported_files(
    selected: DataFrame,
    edges: DataFrame,
    modules: DataFrame,
    closeness: DataFrame | Callable[[DataFrame], DataFrame],
    shims: DataFrame,
    slots: int,
    hub_users: int = HUB_USERS,
) -> DataFrame:
    """Files that selected files import, without hubs and re-export modules, closest first.

    ``closeness``: ``query_id ord cosine``, or what gives it for the pairs that are in question; ``shims``: ``scope path`` of re-export modules.
    """
    hubs = edges.groupBy("scope", "target").agg(F.count("*").alias("users")).filter(F.col("users") > hub_users).select("scope", F.col("target").alias("path"))
    chosen = selected.select("query_id", "scope", "path").distinct()
    hit = chosen.join(edges.withColumnRenamed("importer", "path"), ["scope", "path"]).select("query_id", "scope", F.col("target").alias("path")).distinct()
    hit = hit.join(chosen, ["query_id", "scope", "path"], "left_anti").join(hubs, ["scope", "path"], "left_anti").join(shims, ["scope", "path"], "left_anti")
    new = hit.join(modules, ["scope", "path"])
    if callable(closeness):
        new = stage(new, "imported")
        closeness = closeness(new.select("query_id", "ord"))
    new = new.join(closeness, ["query_id", "ord"], "left")
    new = _first(new, ["query_id"], [F.desc_nulls_last("cosine"), "path"], slots)
    return new.select("query_id", "scope", "ord", "path", F.lit(0.0).alias("score"), F.lit(4).alias("stage"), F.col("slot").alias("at"))


def numbered(stages: list[DataFrame]) -> DataFrame:
    """The stages one after the other, with their final positions."""
    union = stages[0].select(*_COLS)
    for s in stages[1:]:
        union = union.unionByName(s.select(*_COLS))
    w = Window.partitionBy("query_id").orderBy("stage", "at")
    return union.withColumn("pos", F.row_number().over(w))
