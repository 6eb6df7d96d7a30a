"""Answering: context, model call, citations, verification.

The model is an injected interface; everything around it is a table operation, so answers of a
whole batch of questions are rendered and verified in one job.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.citations import answer_citations, rendered, verify

# What stands around the hits of a prompt.
FOUND, NOTHING, QUESTION = "Aramayla bulunan parçalar:\n\n", "(Arama sonuç vermedi. Tool'larla kodu doğrudan aramayı dene.)", "\n\nSoru: "


class Model(Protocol):
    """Answers one prompt."""

    def answer(self, prompt: str) -> str: ...


class Embedder(Protocol):
    """Turns texts into unit vectors of one length."""

    name: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def prompts(queries: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id prompt``: the numbered hits in order, and the question."""
    c = chunks.select("ord", rendered(F.col("kind"), F.col("name"), F.col("location"), F.col("text"), F.col("start_line")).alias("block"))
    blocks = hits.join(c, "ord").groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]), "\n\n").alias("context")
    )
    context = F.when(F.col("context").isNotNull(), F.concat(F.lit(FOUND), "context")).otherwise(F.lit(NOTHING))
    return queries.join(blocks, "query_id", "left").select("query_id", F.concat(context, F.lit(QUESTION), "text").alias("prompt"))


def ask(queries: DataFrame, hits: DataFrame, chunks: DataFrame, model: Model) -> DataFrame:
    """``answer_id text`` from the model, one call per prompt."""

    def run(batches):
        for pdf in batches:
            pdf["text"] = [model.answer(p) for p in pdf["prompt"]]
            yield pdf.rename(columns={"query_id": "answer_id"})[["answer_id", "text"]]

    kind = queries.schema["query_id"].dataType.simpleString()
    return prompts(queries, hits, chunks).mapInPandas(run, f"answer_id {kind}, text string")


def checked(answers: DataFrame, files: DataFrame, indexed: DataFrame) -> DataFrame:
    """``question_id citations unverified`` of every answer, in the order of citation.

    Tables without a ``scope`` are about one code base.
    """
    one = lambda df: df if "scope" in df.columns else df.withColumn("scope", F.lit(""))
    answers, files, indexed = one(answers), one(files), one(indexed)
    v = verify(answer_citations(answers), files, indexed)
    pick = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["citation"])
    grouped = v.groupBy("answer_id").agg(
        pick(F.struct("n", "citation")).alias("citations"), pick(F.when(~F.col("verified"), F.struct("n", "citation"))).alias("unverified")
    )
    empty = F.array().cast("array<string>")
    return answers.select("answer_id").join(grouped, "answer_id", "left").select(
        F.col("answer_id").alias("question_id"), F.coalesce("citations", empty).alias("citations"), F.coalesce("unverified", empty).alias("unverified")
    )


def embed_missing(missing: DataFrame, chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """``provider content_hash vec`` of hashes without a vector; each distinct hash is embedded once."""
    text = F.concat_ws("\n\n", F.coalesce("context", F.lit("")), F.coalesce("text", F.lit("")))
    todo = chunks.select("content_hash", text.alias("t")).join(missing, "content_hash", "left_semi").groupBy("content_hash").agg(F.min("t").alias("t"))

    def run(batches):
        for pdf in batches:
            pdf["vec"] = embedder.embed(pdf["t"].tolist())
            pdf["provider"] = embedder.name
            yield pdf[["provider", "content_hash", "vec"]]

    return todo.mapInPandas(run, "provider string, content_hash string, vec array<float>")


def enrich(chunks: DataFrame, sentences: DataFrame) -> DataFrame:
    """Append a sentence per chunk (``content_hash sentence``) to its context and hash it anew."""
    from corvane.functions.text import content_hash

    s = sentences.groupBy("content_hash").agg(F.max("sentence").alias("sentence"))
    out = chunks.join(s, "content_hash", "left")
    has = F.col("sentence").isNotNull() & (F.trim("sentence") != "")
    context = F.when(has, F.concat_ws("\n", "context", "sentence")).otherwise(F.col("context"))
    out = out.withColumn("llm_context", F.when(has, F.col("sentence")).otherwise(F.col("llm_context"))).withColumn("context", context)
    return out.withColumn("content_hash", F.when(has, content_hash(F.col("context"), F.col("text"))).otherwise(F.col("content_hash"))).drop("sentence")
