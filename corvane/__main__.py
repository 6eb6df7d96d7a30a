"""Command line: ``python -m corvane index|embed|search|ask|eval|contextualize|grep|stats|scan|status``."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import snippet
from corvane.operators import chunks as chunk_ops
from corvane.operators import citations, evaluate, facets
from corvane.plans import answer, context, projects, providers, report
from corvane.plans.agent import ask_with_tools
from corvane.plans.search import HASHED, MODES, Index, SearchConfig, candidates, resolve_mode, search
from corvane.schema import VECTORS
from corvane.session import session
from corvane.sources.tables import VersionedTable, index_tree, read_questions
from corvane.sources.tree import EXCLUDES, read_tree


def _search_options(s: argparse.ArgumentParser) -> None:
    s.add_argument("--mode", choices=MODES)
    s.add_argument("--pool", type=int)
    s.add_argument("--bm25-weight", type=float, default=1.0)
    s.add_argument("--vector-weight", type=float, default=1.0)
    s.add_argument("--no-chunk-weight", action="store_true")
    s.add_argument("--diversity-slots", type=int, default=4)
    s.add_argument("--directory-slots", type=int, default=2)
    s.add_argument("--reference-slots", type=int, default=2)
    s.add_argument("--rerank", default="none")
    _embedding_options(s)


def _embedding_options(s: argparse.ArgumentParser) -> None:
    s.add_argument("--provider", default="md5")
    s.add_argument("--model")
    s.add_argument("--vectors", default="data/vectors", help="folder of the stored vectors")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corvane", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: _with(sub.add_parser(name), args)
    s = add("index", "root", "out")
    s.add_argument("--no-docs", action="store_true")
    s.add_argument("--exclude", action="append", default=[])
    _embedding_options(add("embed", "index"))
    s = add("search", "index", "query")
    s.add_argument("-k", "-n", "--limit", dest="k", type=int, default=5)
    s.add_argument("--lines", type=int, default=6)
    s.add_argument("--facets", action="store_true")
    _search_options(s)
    s = add("ask", "index", "query")
    s.add_argument("--repo", default=".")
    s.add_argument("--context", dest="k", type=int, default=8)
    s.add_argument("--answerer", required=True, help="module:attribute of a model with turn(messages)")
    _search_options(s)
    s = add("eval", "index", "questions")
    s.add_argument("-k", type=int, default=8)
    s.add_argument("--split", default="all")
    s.add_argument("--label", default="baseline")
    s.add_argument("--limit", type=int, default=0)
    s.add_argument("--runs", default="runs")
    s.add_argument("--repo", default=".")
    s.add_argument("--answerer", help="also measure answers of this model (module:attribute)")
    _search_options(s)
    s = add("contextualize", "index", "out")
    s.add_argument("--repo", default=".")
    s.add_argument("--sentences", default="data/sentences")
    s.add_argument("--describer", required=True, help="module:attribute of a Describer")
    s = add("grep", "index", "needle")
    s.add_argument("-n", "--limit", type=int, default=20)
    add("stats", "index")
    s = add("scan", "root", "out")
    s.add_argument("--no-docs", action="store_true")
    _embedding_options(s)
    _embedding_options(add("status", "index"))
    return p


def _with(s: argparse.ArgumentParser, args: tuple[str, ...]) -> argparse.ArgumentParser:
    for a in args:
        s.add_argument(a)
    return s


def _named(place: str):
    """The object that ``module:attribute`` names."""
    module, _, attribute = place.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("project_id", F.lit("index"))


def _vectors(spark: SparkSession, a: argparse.Namespace) -> VersionedTable:
    return VersionedTable(spark, a.vectors, VECTORS, ["provider", "content_hash"])


def _config(a: argparse.Namespace) -> SearchConfig:
    return SearchConfig(
        k=a.k, mode=resolve_mode(a.mode, a.provider), pool=a.pool, weights={"bm25": a.bm25_weight, "vector": a.vector_weight}, weigh_chunks=not a.no_chunk_weight,
        file_slots=a.diversity_slots, directory_slots=a.directory_slots, reference_slots=a.reference_slots,
    )


def _searcher(spark: SparkSession, a: argparse.Namespace, queries: DataFrame) -> tuple[DataFrame, Index, DataFrame]:
    """(chunks, index, queries with what the provider needs)."""
    chunks = _chunks(spark, a.index)
    if a.provider in HASHED:
        return chunks, Index(chunks, a.provider), queries
    service = providers.embedder(a.provider, a.model)
    table = VersionedTable(spark, f"{a.vectors}-queries", providers.QUERY_VECTORS, ["provider", "query_key"])
    return chunks, Index(chunks, service.name, _vectors(spark, a).read()), providers.with_query_vectors(queries, service, table)


def _lines(spark: SparkSession, root: str) -> DataFrame:
    files = read_tree(spark, root).unionByName(read_tree(spark, root, docs=True)).filter("content is not null")
    text = files.select(F.lit("index").alias("project_id"), "path", F.lit(1).alias("start_line"), F.col("content").cast("string").alias("text"))
    return citations.source_lines(text).withColumnRenamed("project_id", "scope")


def _verified(spark: SparkSession, root: str, chunks: DataFrame, lines: DataFrame, answers: DataFrame) -> DataFrame:
    files = lines.groupBy("scope", "path").agg(F.max("line_no").alias("n_lines"))
    indexed = chunks.select(F.col("project_id").alias("scope"), "path").distinct()
    return answer.checked(answers, files, indexed)


def run(a: argparse.Namespace, spark: SparkSession) -> None:
    one = lambda text: spark.createDataFrame([("q", "index", text)], "query_id string, scope string, text string")
    if a.command == "index":
        chunks, errors = index_tree(spark, a.root, EXCLUDES | set(a.exclude))
        (chunks.filter("source <> 'doc'") if a.no_docs else chunks).write.mode("overwrite").parquet(a.out)
        for r in errors.collect():
            print(r.message)
    elif a.command == "embed":
        service = providers.embedder(a.provider, a.model)
        chunks, table = _chunks(spark, a.index), _vectors(spark, a)
        missing = chunk_ops.missing_vectors(chunks, table.read(), service.name)
        table.upsert(answer.embed_missing(missing, chunks, service))
        print(f"{table.read().filter(F.col('provider') == service.name).count()} vectors of {service.name}")
    elif a.command == "search":
        chunks, index, q = _searcher(spark, a, one(a.query))
        if a.facets:
            pool = candidates(q, index, SearchConfig(**{**_config(a).__dict__, "pool": facets.POOL}))
            f = facets.facets(pool, index.docs)
            f.orderBy("facet_rank").select("directory", "chunks", facets.label().alias("label"), facets.refined_query(F.lit(a.query)).alias("query")).show(truncate=False)
            return
        hits = search(q, index, _config(a), providers.reranker(a.rerank)).join(chunks.select("ord", "location", "name", "text"), "ord")
        hits.orderBy("pos").select("pos", "location", "name", F.round("score", 4).alias("score"), snippet(F.col("text"), a.lines).alias("text")).show(100, truncate=False)
    elif a.command == "ask":
        chunks, index, q = _searcher(spark, a, one(a.query))
        lines = _lines(spark, a.repo)
        answers = ask_with_tools(q, index, chunks, lines, _named(a.answerer), _config(a))
        for r in answers.join(_verified(spark, a.repo, chunks, lines, answers).withColumnRenamed("question_id", "answer_id"), "answer_id").collect():
            print(r["text"], *(f"unverified: {c}" for c in r["unverified"]), sep="\n")
    elif a.command == "eval":
        q = read_questions(spark, a.questions, a.split).withColumn("set_name", F.lit(a.questions)).withColumn("project_id", F.lit("index"))
        q = evaluate.clean_questions(q.orderBy("id").limit(a.limit) if a.limit else q)
        chunks, index, batch = _searcher(spark, a, q.select(F.col("id").alias("query_id"), F.lit("index").alias("scope"), F.col("question").alias("text")))
        results = evaluate.per_question(q, search(batch, index, _config(a), providers.reranker(a.rerank)).select("query_id", "pos", "ord", "path"), index.docs.select("ord", "name"))
        tables, answers = {"report": evaluate.report(results), "retrieval": results}, None
        if a.answerer:
            lines = _lines(spark, a.repo)
            given = ask_with_tools(batch, index, chunks, lines, _named(a.answerer), _config(a))
            made = given.select(F.col("answer_id").alias("question_id"), F.expr("json_array_length(tool_calls)").alias("tools"))
            answers = _verified(spark, a.repo, chunks, lines, given).join(made, "question_id")
            tables |= {"answers": answers, "answer_report": evaluate.answer_report(q, answers)}
        print(report.report_text(a.label, q, results, answers))
        print(report.save_run(a.runs, a.label, tables))
    elif a.command == "contextualize":
        chunks = _chunks(spark, a.index)
        files = read_tree(spark, a.repo).unionByName(read_tree(spark, a.repo, docs=True)).select(F.lit("index").alias("project_id"), "path", F.col("content").cast("string").alias("content"))
        out, failures = context.contextualize(chunks, files, _named(a.describer), context.sentence_table(spark, a.sentences))
        out.drop("project_id").write.mode("overwrite").parquet(a.out)
        for r in failures.collect():
            print(r["error"])
    elif a.command == "grep":
        chunk_ops.grep(_chunks(spark, a.index), a.needle, a.limit).select("location", "kind", "name").show(a.limit, truncate=False)
    elif a.command == "stats":
        chunk_ops.count_by_kind(_chunks(spark, a.index)).show()
        chunk_ops.top_files(_chunks(spark, a.index)).show(truncate=False)
    elif a.command == "scan":
        print(projects.scan_preview(spark, a.root, a.out, _vectors(spark, a).read(), a.provider, docs=not a.no_docs))
    else:
        print(projects.Tools(lambda: _chunks(spark, a.index), a.index, a.provider, lambda: _vectors(spark, a).read()).index_status())


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        run(a, session())
    except Exception as e:
        hint = providers.error_hint(e)
        if hint is None:
            raise
        print(f"{e}\n-> {hint}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
