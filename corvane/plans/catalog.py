"""Catalogue of named queries over a directory of tables.

Every query runs over its whole tables. A scope of search is a project: questions are asked of
the code base they belong to, all of them in one job.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane import schema
from corvane.functions import text as T
from corvane.functions.stats import wilson
from corvane.operators import blocks, bm25, chunks as chunk_ops, citations, evaluate, expand, extract, facets, vector
from corvane.plans import answer, search
from corvane.session import fingerprint, on_release, scratch_path, stage
from corvane.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
K = 8
CONFIG = search.SearchConfig(k=K)


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_ops.latest(_read(spark, sf, "chunks"))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return stage(evaluate.clean_questions(_read(spark, sf, "questions")), "questions")


def _batch(q: DataFrame) -> DataFrame:
    return q.select(F.col("id").alias("query_id"), F.col("project_id").alias("scope"), F.col("question").alias("text"))


_indexes: dict[tuple[str, str, str, str], search.Index] = {}
on_release(lambda spark: [_indexes.pop(k) for k in list(_indexes) if k[0] == spark.sparkContext.applicationId])


def _index(spark: SparkSession, sf: str, name: str = "chunks", chunks: Query = _chunks) -> search.Index:
    """The index of a directory's chunks: built once in an application for the files that are there, searched many times."""
    now = fingerprint(spark, f"{sf}/chunks.parquet")
    key = (spark.sparkContext.applicationId, sf, name, now)
    if key not in _indexes:
        for old in [k for k in _indexes if k[:3] == key[:3]]:
            del _indexes[old]
        _indexes[key] = search.Index(chunks(spark, sf))
    return _indexes[key]


def index_build(spark, sf):
    """Builds the index of a directory anew; rows per table."""
    for key in [k for k in _indexes if k[:3] == (spark.sparkContext.applicationId, sf, "chunks")]:
        del _indexes[key]
    index = _index(spark, sf)
    count = lambda df, name, n=F.count("*"): df.agg(F.lit(name).alias("part"), n.alias("entries"))
    parts = [count(index.docs, "docs"), count(index.postings, "postings"), count(index.idf, "terms")]
    parts += [count(index.vectors, "vectors", F.sum(F.size("buckets"))), count(index.edges, "edges")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def _ranking(df: DataFrame) -> DataFrame:
    return df.select("query_id", "ord", F.round("score", 6).alias("score"), "rank")


# --- scalars -------------------------------------------------------------------------------


def tokenize_terms(spark, sf):
    t = bm25.terms(_chunks(spark, sf))
    return t.select("ord", F.array_join("tokens", " ").alias("terms"), F.size("tokens").alias("n"))


def doc_term_counts(spark, sf):
    post = bm25.postings(bm25.terms(_chunks(spark, sf)))
    return post.groupBy("scope", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def chunk_weight(spark, sf):
    return _chunks(spark, sf).select("ord", T.chunk_weight(F.col("kind"), F.col("text")).alias("weight"))


def content_hash(spark, sf):
    h = T.content_hash(F.col("context"), F.col("text"))
    return _chunks(spark, sf).select("ord", h.alias("computed"), F.col("content_hash").eqNullSafe(h).alias("same"))


def narrow_query(spark, sf):
    return _questions(spark, sf).select("id", T.narrow(F.col("question")).alias("narrowed"))


def numbered_snippet(spark, sf):
    c = _chunks(spark, sf).filter("text is not null and start_line is not null")
    return c.select("ord", T.numbered(F.col("text"), F.col("start_line")).alias("body"), T.snippet(F.col("text")).alias("head"))


def token_cost(spark, sf):
    d = _read(spark, sf, "documents").select("doc_id", "lang", "text").distinct().filter("text is not null")
    s = d.groupBy("lang").agg(F.sum(F.length("text")).alias("fresh"), F.count("*").alias("n"))
    return s.select("lang", "fresh", F.round(T.token_cost(F.col("fresh"), F.col("n"), F.col("n"), F.col("n")), 6).alias("cost"))


# --- the chunk table -----------------------------------------------------------------------


def stats_by_kind(spark, sf):
    return chunk_ops.count_by_kind(_chunks(spark, sf))


def stats_top_files(spark, sf):
    return chunk_ops.top_files(_chunks(spark, sf))


def stats_text_length(spark, sf):
    return chunk_ops.text_length(_chunks(spark, sf))


def index_status(spark, sf):
    return chunk_ops.index_status(_chunks(spark, sf))


def composition(spark, sf):
    return chunk_ops.composition(_chunks(spark, sf))


def language_signal(spark, sf):
    return chunk_ops.language_signal(_chunks(spark, sf))


def missing_vectors(spark, sf):
    """Contents without a vector, for every provider."""
    c, v = _chunks(spark, sf), _read(spark, sf, "vectors")
    return _per_provider(v, lambda p: chunk_ops.missing_vectors(c, v, p).select(F.lit(p).alias("provider"), "content_hash"))


def cost_estimate(spark, sf):
    """What embedding the missing chunks takes, for every provider."""
    c, v = _chunks(spark, sf), _read(spark, sf, "vectors")
    return _per_provider(v, lambda p: chunk_ops.embedding_cost(c, v, p).withColumn("provider", F.lit(p)))


def _per_provider(vectors, part):
    """Union over the names of the providers, of which there are few."""
    out = None
    for p in sorted(r[0] for r in vectors.select("provider").filter("provider is not null").distinct().collect()):
        out = part(p) if out is None else out.unionByName(part(p))
    return out


def grep_substring(spark, sf):
    return chunk_ops.grep(_chunks(spark, sf), "ledger").select("ord", "location")


def chunk_lookup(spark, sf):
    """First chunk of every location."""
    c = _chunks(spark, sf).filter("location is not null")
    return chunk_ops.lookup(c, c.select("project_id", "location")).select("project_id", "location", "ord", "name")


def cache_upsert(spark, sf):
    """Merge of the two providers' keys, the first one winning."""
    v = _read(spark, sf, "vectors").filter("content_hash is not null")
    part = lambda p: v.filter(F.col("provider") == p).groupBy("content_hash").agg(F.max(F.when(F.col("vec").isNotNull(), F.size("vec"))).alias("d"))
    return chunk_ops.upsert(part("hash"), part("lokal"), ["content_hash"])


def project_upsert(spark, sf):
    """One registration per project id: the one with most chunks, with its slug and resolved mode."""
    p = _read(spark, sf, "projects")
    w = Window.partitionBy("id").orderBy(F.desc_nulls_last("chunks"), F.desc_nulls_last("added"), "repo")
    mode = F.when(F.col("mode").isin(*search.MODES), F.col("mode")).when(F.col("provider") == "hash", "hybrid").otherwise("vector")
    one = p.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return one.select("id", T.slug(F.col("name")).alias("slug"), "repo", "chunks", "files", mode.alias("mode"))


def enrich_context_join(spark, sf):
    """Each chunk's context extended by the docstring known for its content, hashed anew."""
    c = _chunks(spark, sf)
    s = c.filter("docstring is not null").select("content_hash", F.col("docstring").alias("sentence"))
    e = answer.enrich(c, s)
    return e.select("ord", "content_hash", F.col("llm_context").isNotNull().alias("enriched"))


# --- extraction ----------------------------------------------------------------------------


def extract_sections(spark, sf):
    """Sections of the documents, read as Markdown files: where each begins, its trail of headings, its parent."""
    d = _read(spark, sf, "documents").filter("text is not null")
    files = d.select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content")).distinct()
    found = extract.chunks_of(extract.extract(files)).filter(F.col("text").rlike(r"^#{1,6}\s") & (F.col("name") != extract.UNTITLED))
    # of a section in several parts the first one begins with its heading
    title = F.regexp_extract(F.split_part("text", F.lit("\n"), F.lit(1)), r"^#{1,6}\s+(.*)$", 1)
    first = found.filter(F.trim(title) == F.element_at(F.split("name", " > "), -1))
    return first.select(F.regexp_replace("path", r"\.md$", "").cast("bigint").alias("doc_id"), "start_line", "name", "parent").distinct()


def extract_part_sizes(spark, sf):
    """Parts of all sections: how many hold several lines, are blank, or exceed the limit without being a single line."""
    d = _read(spark, sf, "documents").filter("text is not null")
    files = d.select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content")).distinct()
    found = extract.chunks_of(extract.extract(files)).withColumn("several", F.col("end_line") > F.col("start_line"))
    return found.agg(
        F.count_if(F.col("several") & (F.length("text") > extract.SECTION_LIMIT)).alias("too_long"),
        F.count_if(F.trim("text") == "").alias("blank"),
        F.count_distinct("path").alias("documents"),
    )


def _function_files(spark, sf):
    """Each function's text as a file of its own, a definition at the margin, as delivered."""
    c = _chunks(spark, sf).filter("kind = 'function' and text is not null")
    return c.select("ord", F.concat(F.lit("f"), F.col("ord").cast("string"), F.lit(".py")).alias("path"), F.col("text").alias("content"))


def extract_functions(spark, sf):
    """What the syntax tree says of every function's text: name, lines, signature's head, docstring, hash of its label and text."""
    files = _function_files(spark, sf)
    found = extract.chunks_of(extract.extract(files.select("path", "content"))).filter("kind = 'function' and part <= 1")
    first = found.groupBy("path").agg(F.min_by(F.struct("name", "start_line", "end_line", "context", "text", "content_hash"), "part").alias("f"))
    return files.join(first, "path").select("ord", "f.name", "f.start_line", "f.end_line", "f.context", "f.content_hash")


def extract_errors(spark, sf):
    """Files that can't be parsed are rows, and the rest goes on: functions with a broken line behind them."""
    files = _function_files(spark, sf).withColumn("content", F.when(F.col("ord") % 2 == 0, F.concat("content", F.lit("\ndef (:\n"))).otherwise(F.col("content")))
    found = extract.extract(files.select("path", "content"))
    return found.groupBy((F.col("error").isNotNull()).alias("failed")).agg(F.count_distinct("path").alias("files"))


def hit_payload(spark, sf):
    """What a client is shown of the best hits: place, kind, name, score, methods, numbered text under its header."""
    index, q = _index(spark, sf), _batch(_questions(spark, sf))
    hits = search.search(q, index, search.SearchConfig(k=3, mode="bm25")).filter("stage = 0")
    c = index.chunks.select("ord", "kind", "name", "location", "text", "start_line")
    block = citations.rendered(F.col("kind"), F.col("name"), F.col("location"), F.coalesce("text", F.lit("")), F.coalesce("start_line", F.lit(1)))
    return hits.join(c, "ord").select("query_id", "pos", "location", "kind", "name", F.bround("score", 4).alias("score"), F.array_join("sources", ",").alias("sources"), block.alias("block"))


# --- ranking -------------------------------------------------------------------------------


def bm25_topk(spark, sf):
    index = _index(spark, sf)
    return _ranking(index.bm25(_batch(_questions(spark, sf)), 20))


def hash_embed_topk(spark, sf):
    index, q = _index(spark, sf), _batch(_questions(spark, sf))
    return _ranking(index.hashed(q, 20))


def blake_embed_topk(spark, sf):
    """As ``hash_embed_topk`` with the exchangeable BLAKE2b buckets."""
    index, q = search.Index(_chunks(spark, sf), "hash"), _batch(_questions(spark, sf))
    return _ranking(index.hashed(q, 20))


def _embeddings(spark, sf):
    e = _read(spark, sf, "embeddings")
    return e, e.select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vec"))


def vector_topk(spark, sf):
    e, v = _embeddings(spark, sf)
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return _ranking(vector.cosine_topk(q, v, 10))


def vector_label_recall(spark, sf):
    e, v = _embeddings(spark, sf)
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    top = vector.cosine_topk(q, v, 10)
    labels = e.select("vec_id", "label")
    both = top.join(labels.withColumnRenamed("vec_id", "query_id"), "query_id").join(
        labels.select(F.col("vec_id").alias("ord"), F.col("label").alias("hit_label")), "ord"
    )
    return both.groupBy("label").agg(F.count("*").alias("hits"), F.round(F.avg((F.col("label") == F.col("hit_label")).cast("int")), 6).alias("same_label"))


def _embedded(spark, sf, provider):
    """The chunks with a usable vector of the provider: those that its searches can run over."""
    have = vector.usable(_read(spark, sf, "vectors"), provider).select("content_hash")
    return _chunks(spark, sf).join(have, "content_hash", "left_semi")


def _dense_search(spark, sf, provider="lokal"):
    """Index over stored vectors, and every hundredth chunk as a query with its name and vector."""
    index = search.Index(stage(_embedded(spark, sf, provider), "embedded"), provider, _read(spark, sf, "vectors"))
    asked = index.dense.filter("ord % 100 = 0").select("ord", "vec").join(index.docs.select("ord", "project_id", "name"), "ord")
    q = asked.select(F.col("ord").cast("string").alias("query_id"), F.col("project_id").alias("scope"), F.coalesce("name", F.lit("")).alias("text"), "vec")
    return index, stage(q, "dense-queries")


def dense_topk(spark, sf):
    index, q = _dense_search(spark, sf)
    return _ranking(index.nearest(q, 20))


def search_dense(spark, sf):
    """The whole search in the mode that stored vectors resolve to."""
    index, q = _dense_search(spark, sf)
    return _hits_of(search.search(q, index, search.SearchConfig(k=5, mode=None)))


def search_dense_hybrid(spark, sf):
    index, q = _dense_search(spark, sf)
    return _hits_of(search.search(q, index, search.SearchConfig(k=5, mode="hybrid", weights={"bm25": 0.5})))


def dense_refusals(spark, sf):
    """Per provider and project: contents that keep a search over stored vectors from running."""
    c, v = _chunks(spark, sf), _read(spark, sf, "vectors")

    def one(p):
        rows = vector.stored(c, v, p).groupBy(F.col("scope").alias("project_id"))
        return rows.agg(F.count_distinct("content_hash").alias("contents"), F.count_distinct(F.when(F.col("vec").isNull(), F.col("content_hash"))).alias("missing")).withColumn("provider", F.lit(p))

    return _per_provider(v, one)


def _fused(spark, sf, weigh):
    index, q, pool = _index(spark, sf), _batch(_questions(spark, sf)), CONFIG.pool_size
    return index.ranked(q, pool, ("bm25", "vector"), how=blocks.Fusion(pool, weigh=weigh))


def _with_sources(df):
    return df.select("query_id", "ord", F.round("score", 6).alias("score"), F.array_join("sources", ",").alias("sources"), "rank")


def rrf_hybrid(spark, sf):
    return _with_sources(_fused(spark, sf, False))


def rrf_weighted(spark, sf):
    return _with_sources(_fused(spark, sf, True))


def _hits_of(hits):
    return hits.select("query_id", "pos", "ord", "path", F.round("score", 6).alias("score"), "stage")


def search_bm25(spark, sf):
    return _hits_of(search.search(_batch(_questions(spark, sf)), _index(spark, sf), search.SearchConfig(k=5, mode="bm25")))


def expand_full(spark, sf):
    return _hits_of(search.search(_batch(_questions(spark, sf)), _index(spark, sf), CONFIG))


class ShortestFirst:
    """Stands in for a reranking service where its result is checked against SQL: the shorter a document, the better."""

    name = "shortest"

    def score(self, query: str, documents: list[str]) -> list[float]:
        return [-float(len(d)) for d in documents]


def rerank_pool(spark, sf):
    """The whole pool of every question in a reranker's order."""
    index, q = _index(spark, sf), _batch(_questions(spark, sf))
    ranked = stage(search.candidates(q, index, search.SearchConfig(k=5, mode="bm25", file_slots=0)), "ranked")
    return _with_sources(search.rerank(q, ranked, index.chunks, ShortestFirst()))


# --- expansion -----------------------------------------------------------------------------


def _slots(df):
    return df.select("query_id", "ord", "path", F.col("at").alias("slot"))


def _linked(spark, sf):
    """The chunks in fewer directories, their modules importing one another.

    The tables' own relative imports lead nowhere and their files seldom share a directory. Here a
    file keeps its first directory and its name, and each module imports the next one of its
    directory and the first one, so that there are siblings, users and hubs.
    """
    c = _chunks(spark, sf).withColumn("path", F.regexp_replace("path", "^([^/]+)/(?:.*/)?([^/]+)$", "$1/$2"))
    stem = F.regexp_extract("path", r"([^/]+)\.py$", 1)
    by = Window.partitionBy("project_id", T.directory(F.col("path")), F.col("kind")).orderBy("path", "ord")
    c = c.withColumn("following", F.lead(stem).over(by)).withColumn("hub", F.first(stem).over(by))
    line = lambda name: F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("\nfrom ."), name, F.lit(" import x"))).otherwise("")
    text = F.concat(F.coalesce("text", F.lit("")), line(F.col("following")), line(F.col("hub")))
    return c.withColumn("text", F.when(F.col("kind") == "module", text).otherwise(F.col("text"))).drop("following", "hub")


def _linked_index(spark, sf):
    return _index(spark, sf, "linked", _linked)


def _ranked_paths(spark, sf):
    index = _linked_index(spark, sf)
    ranked = stage(search.candidates(_batch(_questions(spark, sf)), index, CONFIG), "ranked")
    return index, stage(expand.with_paths(ranked, index.docs), "ranked-paths")


def expand_unseen_files(spark, sf):
    return _slots(expand.unseen_files(_ranked_paths(spark, sf)[1], K))


def expand_sibling_dirs(spark, sf):
    _, r = _ranked_paths(spark, sf)
    return _slots(expand.sibling_files(r, expand.numbered([expand.head(r, K), expand.unseen_files(r, K)])))


def _selected(r):
    first = [expand.head(r, K), expand.unseen_files(r, K)]
    return stage(expand.numbered([*first, expand.sibling_files(r, expand.numbered(first))]), "selected")


def expand_references(spark, sf):
    index, r = _ranked_paths(spark, sf)
    return _slots(expand.referencing_files(_selected(r), index.edges, expand.module_chunks(index.docs)))


def expand_imports(spark, sf):
    index, r = _ranked_paths(spark, sf)
    q = _batch(_questions(spark, sf))
    close = partial(index.closeness, q)
    return _slots(expand.imported_files(_selected(r), index.edges, expand.module_chunks(index.docs), close, index.shims(), 2))


def expand_linked(spark, sf):
    """The whole search with all expansion steps, imported files among them, over linked modules."""
    config = search.SearchConfig(k=K, import_slots=2)
    return _hits_of(search.search(_batch(_questions(spark, sf)), _linked_index(spark, sf), config))


def import_edges(spark, sf):
    return expand.import_edges(_linked(spark, sf))


# --- facets --------------------------------------------------------------------------------


def _narrowed(questions):
    """The narrowed questions, each text of a scope asked once, and whose it is: ``query_id scope text``, ``query_id asker``."""
    each = questions.select(F.col("id").alias("asker"), F.col("project_id").alias("scope"), T.narrow(F.col("question")).alias("text"))
    each = stage(each.withColumn("query_id", F.min("asker").over(Window.partitionBy("scope", "text"))), "narrowed")
    return each.filter("query_id = asker").select("query_id", "scope", "text"), each.select("query_id", "asker")


def _for_askers(found, askers):
    """What was found for a text, for each who asked it."""
    return found.join(askers, "query_id").drop("query_id").withColumnRenamed("asker", "query_id")


def _facets(spark, sf, q=None):
    index, questions = _index(spark, sf), _questions(spark, sf)
    q = _batch(questions) if q is None else q
    pool = stage(search.candidates(q, index, search.SearchConfig(k=K, pool=facets.POOL), ("location", "name")).select("query_id", "ord", "rank", "location", "name"), "pool")
    return index, pool, stage(facets.facets(pool, index.docs), "facets")


def facet_clusters(spark, sf):
    f = _facets(spark, sf)[-1]
    three = lambda c: F.array_join(F.slice(c, 1, 3), ",")
    return f.select(
        "query_id", "directory", "chunks", "best_rank", three("symbols").alias("symbols"), three("children").alias("children"),
        F.size("children").alias("children_total"), "facet_rank", facets.label().alias("label"),
    )


def facet_query_terms(spark, sf):
    q, askers = _narrowed(_questions(spark, sf))
    refined = _facets(spark, sf, q)[-1].join(q, "query_id").select("query_id", "facet_rank", facets.refined_query(F.col("text")).alias("refined"))
    return _for_askers(refined, askers).select("query_id", "facet_rank", "refined")


def facet_search_within(spark, sf):
    index, pool, f = _facets(spark, sf)
    first = f.filter("facet_rank = 1").select("query_id", "directory")
    return facets.within(pool, index.docs, first, K).select("query_id", "ord", "pos")


def facet_measure(spark, sf):
    """Narrowed questions: found as they are, by a facet that covers a file, by the best refined query."""
    questions = _questions(spark, sf)
    q, askers = _narrowed(questions)
    index, _, f = _facets(spark, sf, q)
    j = evaluate.judgments(questions).withColumnRenamed("question_id", "query_id")
    plain = _for_askers(search.search(q, index, CONFIG).select("query_id", "path").distinct(), askers).join(j, ["query_id", "path"], "left_semi").select("query_id").distinct()
    # a facet covers a file if it is one of the file's directories
    above = j.select("query_id", F.explode(T.ancestors(T.directory(F.col("path")))).alias("directory"))
    menu = _for_askers(f.select("query_id", "directory"), askers).join(above, ["query_id", "directory"], "left_semi").select("query_id").distinct()
    key = F.concat_ws("#", "query_id", F.col("facet_rank").cast("string")).alias("key")
    refined = stage(f.join(q, "query_id").select("query_id", key, "scope", facets.refined_query(F.col("text")).alias("text")), "refined")
    again = search.search(refined.select(F.col("key").alias("query_id"), "scope", "text"), index, CONFIG).select(F.col("query_id").alias("key"), "path")
    again = _for_askers(again.join(refined.select("key", "query_id"), "key").select("query_id", "path").distinct(), askers)
    ceiling = again.join(j, ["query_id", "path"], "left_semi").select("query_id").union(plain).distinct()
    out = None
    for name, hits in (("plain", plain), ("menu", menu), ("ceiling", ceiling)):
        part = questions.select(F.col("id").alias("query_id"), "split").join(hits.withColumn("hit", F.lit(1)), "query_id", "left")
        part = part.groupBy("split").agg(F.lit(name).alias("measure"), F.count("*").alias("n"), F.count("hit").alias("hits"))
        out = part if out is None else out.unionByName(part)
    low, high = wilson(F.col("hits"), F.col("n"))
    return out.select("split", "measure", "n", "hits", F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


# --- evaluation ----------------------------------------------------------------------------


def question_split(spark, sf):
    q = _questions(spark, sf)
    return q.groupBy("split").agg(
        F.count("*").alias("questions"), F.sum(F.size("expect_files")).alias("files"), F.count_if(F.size("expect_symbols") > 0).alias("with_symbols")
    )


def _results(spark, sf):
    index, q = _index(spark, sf), _questions(spark, sf)
    hits = stage(search.search(_batch(q), index, CONFIG).select("query_id", "pos", "ord", "path"), "hits")
    return evaluate.per_question(q, hits, index.docs.select("ord", "name"))


def eval_per_question(spark, sf):
    return _results(spark, sf).select(
        "question_id", "split", "set_name", "expected", "returned", "rank", "symbols_found", "found", F.round("coverage", 6).alias("coverage")
    )


def eval_report(spark, sf):
    return evaluate.report(_results(spark, sf))


def eval_by_split(spark, sf):
    return evaluate.report(_results(spark, sf), ["split"])


def eval_by_set(spark, sf):
    return evaluate.report(_results(spark, sf), ["set_name"])


def smoke_sample(spark, sf):
    index = _index(spark, sf)
    return evaluate.smoke_sample(index.docs.drop("weight"), index.weights())


def smoke_test(spark, sf):
    index = _index(spark, sf)
    sample = stage(evaluate.smoke_sample(index.docs.drop("weight"), index.weights()), "sample")
    q = sample.select(F.col("ord").cast("string").alias("query_id"), F.col("project_id").alias("scope"), F.col("name").alias("text"))
    hits = search.search(q, index, CONFIG).join(index.docs.select("ord", "location"), "ord")
    return evaluate.smoke_report(sample, hits.select("query_id", "location"))


# --- citations and answers -----------------------------------------------------------------


def _cited(spark, sf):
    docs = _read(spark, sf, "documents").filter("text is not null")
    return citations.answer_citations(docs.select(F.col("doc_id").alias("answer_id"), F.col("source").alias("scope"), "text").distinct())


def extract_citations(spark, sf):
    return _cited(spark, sf).select(F.col("answer_id").alias("doc_id"), "n", "citation")


def _files(chunks):
    end = F.greatest(F.coalesce("end_line", "start_line"), F.col("start_line"))
    return chunks.filter("path is not null").groupBy(F.col("project_id").alias("scope"), "path").agg(F.max(end).alias("n_lines"))


def cited_files(spark, sf):
    """Distinct cited files of every document, sorted."""
    d = _read(spark, sf, "documents").filter("text is not null").select("doc_id", "text").distinct()
    return d.select("doc_id", F.array_join(T.cited_files(T.citations(F.col("text"))), ",").alias("files")).filter("files <> ''")


def token_totals(spark, sf):
    """Sums per field of the documents' counts, as usage is summed over answers."""
    d = _read(spark, sf, "documents").filter("text is not null").select("doc_id", "text").distinct()
    usage = F.create_map(F.lit("characters"), F.length("text"), F.lit("lines"), F.size(T.lines(F.col("text"))))
    return evaluate.token_totals(d.select(usage.alias("usage")))


def jsonl_round_trip(spark, sf):
    """The chunk table written as JSON lines and read back: rows, texts and nulls per kind."""
    c = _chunks(spark, sf).select(*[x.split()[0] for x in schema.CHUNKS.split(", ")])
    path = scratch_path(spark, "jsonl")
    tables.write_jsonl(c, path)
    back = tables.read_jsonl(spark, path)
    return back.groupBy("kind").agg(
        F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"), F.count("signature").alias("signatures"), F.count_distinct("text").alias("texts"),
        F.sum("end_line").alias("end_lines"),
    )


def verify_citations(spark, sf):
    """The documents' citations against the files of the project they are about."""
    files = _files(_chunks(spark, sf))
    return citations.verify(_cited(spark, sf), files, files).drop("scope")


def source_window(spark, sf):
    """Source around the first line of every chunk."""
    c = _chunks(spark, sf)
    at = c.filter("start_line is not null").select("project_id", "path", F.col("start_line").alias("line")).distinct()
    return citations.source_window(at, citations.source_lines(c)).select("project_id", "path", "line", "line_no", "text")


def answer_metrics(spark, sf):
    """Answers that cite the first line of each expected file of their project."""
    q, files = _questions(spark, sf), _files(_chunks(spark, sf))
    refs = q.select(F.col("id").alias("question_id"), F.col("project_id").alias("scope"), F.explode("expect_files").alias("path"))
    known = refs.join(files.select("scope", "path", F.lit(True).alias("there")), ["scope", "path"], "left").withColumn("citation", F.concat("path", F.lit(":1")))
    answers = known.groupBy("question_id").agg(
        F.collect_list("citation").alias("citations"), F.collect_list(F.when(F.col("there").isNull(), F.col("citation"))).alias("unverified")
    )
    return evaluate.answer_report(q, answers)


def queries() -> dict[str, Query]:
    fns = [
        tokenize_terms, doc_term_counts, chunk_weight, content_hash, narrow_query, numbered_snippet, token_cost,
        stats_by_kind, stats_top_files, stats_text_length, index_status, composition, language_signal, missing_vectors, cost_estimate,
        grep_substring, chunk_lookup, cache_upsert, project_upsert, enrich_context_join,
        extract_sections, extract_part_sizes, extract_functions, extract_errors, hit_payload,
        index_build, bm25_topk, hash_embed_topk, blake_embed_topk, vector_topk, vector_label_recall, dense_topk, search_dense, search_dense_hybrid, dense_refusals, rrf_hybrid, rrf_weighted, search_bm25, expand_full,
        expand_unseen_files, expand_sibling_dirs, expand_references, expand_imports, expand_linked, import_edges,
        facet_query_terms, facet_search_within, facet_measure,
        question_split, eval_per_question, eval_report, eval_by_split, eval_by_set, smoke_sample, smoke_test,
        extract_citations, cited_files, token_totals, jsonl_round_trip, rerank_pool, verify_citations, source_window, answer_metrics,
    ]
    return {f.__name__: f for f in fns} | {"facets": facet_clusters}


def oracle_sql() -> dict[str, str]:
    from corvane.plans.oracle import oracle_sql as sql

    return sql()
