"""End-to-end search of a batch of queries.

``Index`` holds the tables a search needs; the candidates of a query are found, fused and weighed in
one task, chunk texts never travel with a ranking, and the result of the candidate stage is
written once because three expansion steps read it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property, partial
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import TYPE_ONLY_WEIGHT, chunk_weight, is_reexport
from corvane.operators import blocks, bm25, expand, fusion, vector
from corvane.session import stage

MODES = ("bm25", "vector", "hybrid")
HASHED = ("hash", "md5")


def resolve_mode(mode: str | None, provider: str) -> str:
    """An explicit mode, else hybrid for hashed vectors and vector for all others."""
    if mode in MODES:
        return mode
    if mode not in (None, "auto"):
        raise ValueError(f"unknown mode {mode!r}, expected one of {MODES}")
    return "hybrid" if provider in HASHED else "vector"


class Reranker(Protocol):
    """Scores documents for a query; the higher the better."""

    name: str

    def score(self, query: str, documents: list[str]) -> list[float]: ...


@dataclass(frozen=True)
class SearchConfig:
    k: int = 5
    mode: str | None = "hybrid"
    pool: int | None = None
    weights: dict[str, float] = field(default_factory=dict)
    weigh_chunks: bool = True
    demote_reexports: bool = False
    file_slots: int = expand.FILE_SLOTS
    directory_slots: int = expand.DIRECTORY_SLOTS
    reference_slots: int = expand.REFERENCE_SLOTS
    import_slots: int = 0
    bm25: bm25.BM25 = bm25.BM25()

    @property
    def pool_size(self) -> int:
        size = self.pool or max(4 * self.k, 20)
        return max(size, expand.SCAN) if self.file_slots > 0 else size


class MissingVectors(ValueError):
    """Chunks without a stored vector can't be searched by one."""


class Index:
    """Derived tables of a clean chunk table (one row per ``ord``).

    ``rows``, a chunk each without its text, and the ``idf`` are what a persisted index holds;
    each is written once, when a step first asks for it. Texts are read for that and never again
    by a ranking. ``provider`` is a hashed embedder (``md5``, ``hash``) or the name of one whose
    vectors are ``stored`` (``provider content_hash vec``); then every chunk must have one.
    """

    def __init__(self, chunks: DataFrame, provider: str = "md5", stored: DataFrame | None = None):
        if provider not in HASHED and stored is None:
            raise MissingVectors(f"provider {provider!r} needs stored vectors")
        self.chunks = chunks
        self.provider = provider
        self.stored = stored

    @cached_property
    def rows(self) -> DataFrame:
        """The chunks with the counts of their terms and buckets, lengths, weights and imports instead of texts.

        Terms are those of name, context and text; hashed is what is embedded: context, blank line and text.
        """
        text = F.concat_ws("\n\n", F.coalesce("context", F.lit("")), F.coalesce("text", F.lit("")))
        meta = self.chunks.select(
            "ord", F.col("project_id").alias("scope"), "kind", "path", "name", "location",
            chunk_weight(F.col("kind"), F.col("text")).alias("weight"),
            ((F.col("kind") == "module") & is_reexport(F.coalesce("text", F.lit("")))).alias("shim"),
            F.when(F.col("kind") == "module", expand.relative_imports()).alias("imports"),
            bm25.tokenize(F.coalesce("name", F.lit(""))).alias("also"), bm25.tokenize(text).alias("tokens"),
        )
        meta = meta.withColumn("dl", F.size("also") + F.size("tokens"))
        return stage(blocks.counted(meta, self.provider), "rows", keep=True)

    @property
    def docs(self) -> DataFrame:
        """The chunks without their texts, with lengths and weights."""
        return self.rows.select("ord", F.col("scope").alias("project_id"), "kind", "path", "name", "location", "dl", "weight", "shim")

    @property
    def postings(self) -> DataFrame:
        """``scope ord term dl tf``."""
        each = self.rows.select("scope", "ord", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
        return each.select("scope", "ord", F.col("t.terms").alias("term"), "dl", F.col("t.tfs").cast("bigint").alias("tf"))

    @cached_property
    def idf(self) -> DataFrame:
        """``scope term idf`` with the default constants."""
        return stage(bm25.idf(self.postings, self.lengths(), bm25.BM25()), "idf", keep=True)

    @cached_property
    def dense(self) -> DataFrame:
        """``ord scope vec`` of stored vectors; refuses an index that isn't embedded whole."""
        rows = stage(vector.stored(self.chunks, self.stored, self.provider), "dense", keep=True)
        missing = rows.filter("vec is null").agg(F.count_distinct("content_hash"), F.count("*")).first()
        if missing[1]:
            raise MissingVectors(f"{missing[1]} chunks ({missing[0]} contents) have no vector of {self.provider}")
        return rows

    @property
    def vectors(self) -> DataFrame:
        """``scope ord buckets weights``: hashed unit vectors."""
        norm = F.sqrt(F.aggregate("counts", F.lit(0.0), lambda s, x: s + x * x))
        return self.rows.filter(F.size("buckets") > 0).select("scope", "ord", "buckets", F.transform("counts", lambda x: x / norm).alias("weights"))

    def lengths(self) -> DataFrame:
        return self.docs.select(F.col("project_id").alias("scope"), "ord", "dl")

    def weights(self, demote: bool = False) -> DataFrame:
        weight = F.when(F.col("shim"), TYPE_ONLY_WEIGHT).otherwise(F.col("weight")) if demote else F.col("weight")
        return self.docs.select("ord", weight.alias("weight"))

    def ranked(
        self, queries: DataFrame, k: int, methods: tuple[str, ...], p: bm25.BM25 | None = None, how: blocks.Fusion | None = None,
        demote: bool = False, carry: tuple[str, ...] = (),
    ) -> DataFrame:
        """The best ``k`` by BM25 or hashed vectors, or by both and fused; see ``blocks.ranked``."""
        p = p or bm25.BM25()
        q = bm25.asked(queries, self.provider)
        if "bm25" in methods:
            q = bm25.weighted(q, self.idf if p == bm25.BM25() else bm25.idf(self.postings, self.lengths(), p), self.lengths())
        rows = self.rows.withColumn("weight", F.when(F.col("shim"), TYPE_ONLY_WEIGHT).otherwise(F.col("weight"))) if demote else self.rows
        return blocks.ranked(q, rows, k, methods, (p.k1, p.b), how, carry)

    def bm25(self, queries: DataFrame, k: int, p: bm25.BM25 | None = None) -> DataFrame:
        return self.ranked(queries, k, ("bm25",), p).select("query_id", "ord", "score", "rank")

    def query_vectors(self, queries: DataFrame) -> DataFrame:
        """Hashed vectors of the queries."""
        t = bm25.query_terms(queries).withColumnRenamed("qtf", "tf")
        return stage(vector.hashed(t, ["query_id", "scope"], self.provider), "query-vectors")

    def hashed(self, queries: DataFrame, k: int) -> DataFrame:
        return self.ranked(queries, k, ("vector",)).select("query_id", "ord", "score", "rank")

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """R2: vector ranking; with a stored provider ``queries`` carry their own ``vec``."""
        if self.provider in HASHED:
            return self.hashed(queries, k)
        norm = F.sqrt(F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
        unit = F.transform(F.col("vec").cast("array<double>"), lambda x: x / norm)
        return vector.cosine_topk(queries.select("query_id", "scope", F.when(norm > 0, unit).alias("qvec")), self.dense, k)

    def closeness(self, queries: DataFrame, pairs: DataFrame) -> DataFrame:
        """``query_id ord cosine`` of stated pairs."""
        if self.provider in HASHED:
            return vector.sparse_cosine(pairs, self.query_vectors(queries), self.vectors)
        q = queries.select("query_id", F.col("vec").cast("array<double>").alias("q"))
        both = pairs.distinct().join(self.dense.select("ord", "vec"), "ord").join(q, "query_id")
        norm = F.sqrt(vector.dot("q", "q"))
        return both.select("query_id", "ord", F.round(F.try_divide(vector.dot("vec", "q"), norm), 9).alias("cosine")).filter("cosine > 0")

    def shims(self) -> DataFrame:
        return self.docs.filter("shim").select(F.col("project_id").alias("scope"), "path").distinct()

    @cached_property
    def edges(self) -> DataFrame:
        return stage(expand.import_edges(self.rows.withColumnRenamed("scope", "project_id")), "edges", keep=True)


def candidates(queries: DataFrame, index: Index, config: SearchConfig, carry: tuple[str, ...] = ("path",)) -> DataFrame:
    """``query_id ord score sources rank`` of the pool, fused and weighed; without stored vectors also ``scope`` and what is to ``carry``."""
    mode = resolve_mode(config.mode, index.provider)
    pool = config.pool_size
    if index.provider in HASHED or mode == "bm25":
        how = blocks.Fusion(pool, config.weights, config.weigh_chunks)
        return index.ranked(queries, pool, ("bm25", "vector") if mode == "hybrid" else (mode,), config.bm25, how, config.demote_reexports, carry)
    rankings: dict[str, DataFrame] = {}
    if mode in ("bm25", "hybrid"):
        rankings["bm25"] = index.bm25(queries, pool, config.bm25)
    if mode in ("vector", "hybrid"):
        rankings["vector"] = index.nearest(queries, pool)
    fused = fusion.fuse(rankings, pool, config.weights)
    return fusion.reweigh(fused, index.weights(config.demote_reexports)) if config.weigh_chunks else fused


def rerank(queries: DataFrame, ranked: DataFrame, chunks: DataFrame, reranker: Reranker) -> DataFrame:
    """Scores of the whole pool by a reranker, which joins the sources; ties keep their order."""
    texts = chunks.select("ord", F.concat_ws("\n\n", F.coalesce("context", F.lit("")), F.coalesce("text", F.lit(""))).alias("document"))
    rows = ranked.join(texts, "ord").join(queries.select("query_id", F.col("text").alias("query")), "query_id")

    def one(pdf):
        pdf = pdf.sort_values("rank")
        pdf["score"] = reranker.score(pdf["query"].iloc[0], pdf["document"].tolist())
        pdf = pdf.sort_values("score", ascending=False, kind="stable")
        pdf["rank"] = range(1, len(pdf) + 1)
        pdf["sources"] = [[*s, "rerank"] for s in pdf["sources"]]
        return pdf[["query_id", "ord", "score", "sources", "rank"]]

    kind = ranked.schema["query_id"].dataType.simpleString()
    return rows.groupBy("query_id").applyInPandas(one, f"query_id {kind}, ord bigint, score double, sources array<string>, rank int")


def expanded(
    ranked: DataFrame, index: Index, config: SearchConfig, closeness: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """``query_id pos ord path score stage`` of the head and all expansion stages.

    What one stage selects is read by the next ones, and is small: it is written in between.
    """
    r = stage(expand.with_paths(ranked.filter(F.col("rank") <= max(config.k, expand.SCAN)), index.docs), "ranked-paths")
    stages = [expand.head(r, config.k)]
    if config.file_slots:
        stages.append(expand.unseen_files(r, config.k, config.file_slots))
    if config.directory_slots:
        stages = [stage(expand.numbered(stages), "selected")]
        stages.append(expand.sibling_files(r, stages[0], config.directory_slots))
    if config.reference_slots or config.import_slots:
        modules = expand.module_chunks(index.docs)
        stages = [stage(expand.numbered(stages), "selected")]
        if config.reference_slots:
            stages.append(expand.referencing_files(stages[0], index.edges, modules, config.reference_slots))
        if config.import_slots and closeness is not None:
            chosen = expand.numbered(stages) if len(stages) > 1 else stages[0]
            stages.append(expand.imported_files(chosen, index.edges, modules, closeness, index.shims(), config.import_slots))
    return expand.numbered(stages)


def search(queries: DataFrame, index: Index, config: SearchConfig | None = None, reranker: Reranker | None = None) -> DataFrame:
    """Hits of every query: ``query_id pos ord path score stage sources``.

    ``queries``: ``query_id scope text`` (and ``vec`` for a stored provider). Scores are the fused ones in every mode; chunks that
    an import link added have score 0 and the source ``reference``.
    """
    config = config or SearchConfig()
    ranked = stage(candidates(queries, index, config), "ranked")
    if reranker is not None:
        ranked = stage(rerank(queries, ranked, index.chunks, reranker), "reranked")
    closeness = partial(index.closeness, queries) if config.import_slots else None
    hits = expanded(ranked, index, config, closeness)
    known = ranked.select("query_id", "ord", "sources")
    sources = F.when(F.col("stage") >= 3, F.array(F.lit("reference"))).otherwise(F.col("sources"))
    return hits.join(known, ["query_id", "ord"], "left").withColumn("sources", sources)


def plain(config: SearchConfig) -> SearchConfig:
    """The same search without any expansion."""
    return replace(config, file_slots=0, directory_slots=0, reference_slots=0, import_slots=0)
