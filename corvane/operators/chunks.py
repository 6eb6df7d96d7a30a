"""The chunk table: cleaning, counting, looking up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T

#: price of embedding a million tokens, characters in a token, share of chunks in percent
EMBED_PRICE, CHARS_PER_TOKEN, HYBRID_FROM = 0.18, 4, 20


def latest(chunks: DataFrame) -> DataFrame:
    """One row per ``ord``: the one indexed last."""
    w = Window.partitionBy("ord").orderBy(F.desc_nulls_last("indexed_at"), "content_hash")
    return chunks.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def count_by_kind(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("kind").agg(F.count("*").alias("chunks"))


def top_files(chunks: DataFrame, n: int = 10) -> DataFrame:
    """Files with most chunks; ties in order of first appearance."""
    by = chunks.groupBy("project_id", "path").agg(F.count("*").alias("chunks"), F.min("ord").alias("first_ord"))
    return by.orderBy(F.desc("chunks"), "first_ord").limit(n)


def text_length(chunks: DataFrame) -> DataFrame:
    """Number of chunks and mean text length, in whole characters."""
    total = F.coalesce(F.sum(F.length("text")), F.lit(0))
    return chunks.agg(F.count("*").alias("chunks"), F.expr("coalesce(sum(length(text)), 0) div greatest(count(1), 1)").alias("mean_chars"), total.alias("chars"))


def index_status(chunks: DataFrame) -> DataFrame:
    """Per project: chunks, files and the kinds with their counts, sorted by name."""
    kinds = chunks.groupBy("project_id", "kind").agg(F.count("*").alias("n"))
    listed = kinds.groupBy("project_id").agg(
        F.sum("n").alias("chunks"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", F.col("n").cast("string")))), ", ").alias("kinds")
    )
    files = chunks.groupBy("project_id").agg(F.countDistinct("path").alias("files"))
    return listed.join(files, "project_id")


def composition(chunks: DataFrame) -> DataFrame:
    """Per project: chunks of code, tests and documents, and their whole percentages (half to even)."""
    role = (
        F.when((F.col("kind") == "section") | F.lower("path").endswith(".md"), "doc").when(F.col("path").rlike(T.TEST_PATH), "test").otherwise("code")
    )
    c = chunks.withColumn("role", role).groupBy("project_id").agg(
        F.count("*").alias("total"), *(F.count_if(F.col("role") == r).alias(r) for r in ("code", "test", "doc"))
    )
    return c.withColumns({f"{r}_pct": F.bround(100 * F.col(r) / F.col("total"), 0).cast("int") for r in ("code", "test", "doc")})


def language_signal(chunks: DataFrame) -> DataFrame:
    """Per project: percentage of chunks with Turkish letters, and the search mode it suggests."""
    hit = F.count_if(F.col("text").rlike(T.TURKISH_LETTERS))
    s = chunks.groupBy("project_id").agg(F.bround(100 * hit / F.count("*"), 0).cast("int").alias("turkish_pct"))
    return s.withColumn("suggested_mode", F.when(F.col("turkish_pct") >= HYBRID_FROM, "hybrid").otherwise("vector"))


def missing_vectors(chunks: DataFrame, vectors: DataFrame, provider: str) -> DataFrame:
    """Distinct content hashes without a vector of the provider."""
    have = vectors.filter((F.col("provider") == provider) & F.col("vec").isNotNull()).select("content_hash")
    return chunks.select("content_hash").distinct().join(have, "content_hash", "left_anti")


def embedding_cost(chunks: DataFrame, vectors: DataFrame, provider: str) -> DataFrame:
    """What embedding the missing chunks takes; a repeated hash counts once."""
    have = vectors.filter((F.col("provider") == provider) & F.col("vec").isNotNull()).select("content_hash").distinct().withColumn("there", F.lit(1))
    size = F.length("text") + F.length(F.coalesce("context", F.lit("")))
    each = chunks.groupBy("content_hash").agg(F.max(size).alias("size")).join(have, "content_hash", "left")
    chars = F.coalesce(F.sum(F.when(F.col("there").isNull(), F.col("size"))), F.lit(0))
    tokens = chars / F.lit(CHARS_PER_TOKEN)
    return each.agg(
        F.count("*").alias("total"),
        F.count("there").alias("cached"),
        F.count_if(F.col("there").isNull()).alias("missing"),
        chars.alias("characters"),
        F.bround(tokens, 0).cast("bigint").alias("tokens"),
        F.bround(tokens / 1e6 * EMBED_PRICE, 4).alias("cost"),
    )


def grep(chunks: DataFrame, needle: str, limit: int | None = None) -> DataFrame:
    """Chunks whose name or text contains a string, whatever its case, in index order."""
    q = needle.lower()
    hit = F.lower("name").contains(q) | F.lower("text").contains(q)
    out = chunks.filter(hit)
    return out.orderBy("ord").limit(limit) if limit is not None else out


def lookup(chunks: DataFrame, locations: DataFrame) -> DataFrame:
    """The first chunk at each of the given locations (columns of ``locations``: project_id, location)."""
    hit = chunks.join(locations.distinct(), ["project_id", "location"])
    w = Window.partitionBy("project_id", "location").orderBy("ord")
    return hit.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The new rows, and the old ones whose key isn't among them."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"))
