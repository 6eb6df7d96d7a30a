"""Evaluation of retrieval and answers against labelled questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.stats import mean_interval, wilson
from corvane.functions.text import normal_path


def clean_questions(questions: DataFrame) -> DataFrame:
    """One row per id: normalised split, distinct normalised files, distinct non-empty symbols.

    Without a split a question belongs to ``dev``; of rows repeated for an id the one with the
    smallest content counts.
    """
    s = F.lower(F.trim("split"))
    files = F.array_sort(F.array_distinct(F.transform(F.filter("expect_files", lambda f: f.isNotNull() & (F.trim(f) != "")), normal_path)))
    symbols = F.array_sort(F.array_distinct(F.filter(F.coalesce("expect_symbols", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))))
    q = questions.filter("id is not null and question is not null").select(
        "id", "question", files.alias("expect_files"), symbols.alias("expect_symbols"),
        F.when(s.isNull() | (s == ""), "dev").otherwise(s).alias("split"), "set_name", "project_id",
    )
    w = Window.partitionBy("id").orderBy("question", "split", F.array_join("expect_files", ","), F.array_join("expect_symbols", ","), "set_name")
    return q.withColumn("rn", F.row_number().over(w)).filter("rn = 1 and size(expect_files) > 0").drop("rn")


def judgments(questions: DataFrame) -> DataFrame:
    """``question_id path``."""
    return questions.select(F.col("id").alias("question_id"), F.explode("expect_files").alias("path"))


def per_question(questions: DataFrame, hits: DataFrame, names: DataFrame) -> DataFrame:
    """Q5: found, rank, coverage and symbols of every question.

    ``hits``: ``query_id pos ord path``, the expanded list; ``names``: ``ord name``.
    """
    j = judgments(questions)
    files = hits.groupBy(F.col("query_id").alias("question_id"), "path").agg(F.min("pos").alias("pos"))
    matched = j.join(files, ["question_id", "path"], "left").groupBy("question_id").agg(
        F.count("*").alias("expected"), F.count("pos").alias("returned"), F.min("pos").alias("rank")
    )
    asked = questions.select(F.col("id").alias("question_id"), F.explode("expect_symbols").alias("symbol"))
    shown = hits.join(names, "ord").select(F.col("query_id").alias("question_id"), "name")
    # a name matches its symbol whole or by its last parts: an equi-join on the name's suffixes
    parts = F.split("name", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    known = shown.select("question_id", F.explode(suffixes).alias("symbol")).distinct().withColumn("there", F.lit(True))
    symbols = asked.join(known, ["question_id", "symbol"], "left").groupBy("question_id").agg(
        F.bool_and(F.coalesce("there", F.lit(False))).alias("symbols_found")
    )
    return (
        questions.select(F.col("id").alias("question_id"), "split", "set_name")
        .join(matched, "question_id")
        .join(symbols, "question_id", "left")
        .withColumn("found", F.col("returned") > 0)
        .withColumn("coverage", F.col("returned") / F.col("expected"))
    )


def report(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Recall, coverage, MRR and symbol recall with 95 % intervals; symbol recall is null where none was asked."""
    found = F.sum(F.col("found").cast("int"))
    n = F.count("*")
    low, high = wilson(F.col("hits"), F.col("n"))
    clow, chigh = mean_interval(F.col("coverage"), F.col("coverage_var"), F.col("n"))
    raw = results.groupBy(*(by or [])).agg(
        n.alias("n"),
        F.coalesce(found, F.lit(0)).alias("hits"),
        F.coalesce(F.avg("coverage"), F.lit(0.0)).alias("coverage"),
        F.coalesce(F.var_samp("coverage"), F.lit(0.0)).alias("coverage_var"),
        F.coalesce(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), F.lit(0.0)).alias("mrr"),
        F.avg(F.col("symbols_found").cast("int")).alias("symbol_recall"),
    )
    r4 = lambda c: F.round(c, 4)
    return raw.select(
        *(by or []),
        "n",
        r4(F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0)).alias("recall"),
        r4(low).alias("recall_low"),
        r4(high).alias("recall_high"),
        r4(F.col("coverage")).alias("coverage"),
        r4(clow).alias("coverage_low"),
        r4(chigh).alias("coverage_high"),
        r4(F.col("mrr")).alias("mrr"),
        r4(F.col("symbol_recall")).alias("symbol_recall"),
    )


def smoke_sample(chunks: DataFrame, weights: DataFrame, sample: int = 25) -> DataFrame:
    """Per scope, symbols that occur once and aren't put back, at even strides by location."""
    c = chunks.join(weights, "ord").filter(F.col("kind").isin("function", "method", "class") & (F.col("weight") == 1.0))
    same = Window.partitionBy("project_id", "name")
    unique = c.withColumn("same", F.count("*").over(same)).filter("same = 1")
    by = Window.partitionBy("project_id").orderBy("location", "ord")
    size = unique.groupBy("project_id").agg(F.count("*").alias("n"))
    placed = unique.withColumn("rn", F.row_number().over(by)).join(size, "project_id")
    step = F.greatest(F.lit(1), F.expr(f"n div {sample}"))
    taken = placed.filter(((F.col("rn") - 1) % step == 0) & (F.expr(f"(rn - 1) div greatest(1, n div {sample})") < sample))
    return taken.select("project_id", "ord", "name", "location")


def smoke_report(sample: DataFrame, hits: DataFrame) -> DataFrame:
    """Per scope: sampled symbols, found ones (a hit at the same location) and the rate.

    ``hits``: ``query_id location`` with ``query_id`` the sampled ``ord`` as a string.
    """
    good = hits.select(F.col("query_id").cast("bigint").alias("ord"), "location").distinct().withColumn("hit", F.lit(1))
    s = sample.join(good, ["ord", "location"], "left").groupBy("project_id").agg(F.count("*").alias("total"), F.count("hit").alias("found"))
    return s.withColumn("rate", F.round(F.col("found") / F.col("total"), 3))


def per_answer(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Q6: ``question_id hit covered unverified tools`` of every answer."""
    tools = F.col("tools") if "tools" in answers.columns else F.lit(0)
    a = answers.withColumn("tools", tools).join(questions.select(F.col("id").alias("question_id"), "expect_files"), "question_id")
    cited = F.array_distinct(F.transform("citations", lambda c: F.regexp_replace(c, ":[^:]*$", "")))
    shared = F.size(F.array_intersect("expect_files", cited))
    return a.select("question_id", (shared > 0).alias("hit"), (shared / F.size("expect_files")).alias("covered"), F.size("unverified").alias("unverified"), "tools")


def answer_report(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Accuracy, file coverage, citations per answer and unverified citations.

    ``answers``: ``question_id citations unverified``; a question without an answer counts as one
    without citations. Raw cited paths are compared with the expected ones.
    """
    empty = F.array().cast("array<string>")
    q = questions.select(F.col("id").alias("question_id"), "expect_files").join(answers, "question_id", "left")
    cited = F.array_distinct(F.transform(F.coalesce("citations", empty), lambda c: F.regexp_replace(c, ":[^:]*$", "")))
    q = q.withColumn("hit", F.size(F.array_intersect("expect_files", cited)))
    low, high = wilson(F.count_if(F.col("hit") > 0), F.count("*"))
    return q.agg(
        F.count("*").alias("n"),
        F.round(F.coalesce(F.avg((F.col("hit") > 0).cast("int")), F.lit(0.0)), 4).alias("accuracy"),
        F.round(low, 4).alias("accuracy_low"),
        F.round(high, 4).alias("accuracy_high"),
        F.round(F.coalesce(F.avg(F.col("hit") / F.size("expect_files")), F.lit(0.0)), 4).alias("file_coverage"),
        F.round(F.coalesce(F.avg(F.size(F.coalesce("citations", empty))), F.lit(0.0)), 2).alias("citations_per_answer"),
        F.coalesce(F.sum(F.size(F.coalesce("unverified", empty))), F.lit(0)).cast("bigint").alias("unverified"),
    )


def token_totals(answers: DataFrame, usage: str = "usage") -> DataFrame:
    """Sums per field of a map of token counts."""
    return answers.select(F.explode(usage).alias("field", "n")).groupBy("field").agg(F.sum("n").alias("tokens"))
