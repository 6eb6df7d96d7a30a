"""Queries of the training-data operators over a directory of tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm import docpairs, leakage, nearcopies, neighbours, overlap, packing, provenance, segments, sentences
from corvane.operators.vector import cosine_topk, usable
from corvane.session import stage

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b")]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    found = provenance.classify_files(_table(spark, sf, "chunks"), _table(spark, sf, "projects"))
    return found.select("project_id", "path")


def p1_reasons(spark: SparkSession, sf: str) -> DataFrame:
    found = provenance.classify_files(_table(spark, sf, "chunks"), _table(spark, sf, "projects"))
    return found.groupBy("project_id", "reason").agg(F.count("*").alias("files"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    found = overlap.find_overlaps(_table(spark, sf, "questions"))
    return found.filter("eval_id <> train_id").select(*_pair("eval_id", "train_id")).distinct()


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlap_report(_table(spark, sf, "questions"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return nearcopies.near_copy_groups(_table(spark, sf, "chunks")).select("ord", "group_ord")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    near = neighbours.nearest(_table(spark, sf, "vectors"), min_cosine=0.8)
    pair = [F.least("content_hash", "neighbour").alias("hash_a"), F.greatest("content_hash", "neighbour").alias("hash_b")]
    return near.select("provider", *pair).distinct()


def p4_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf, "vectors"))


def p4_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Per provider: whether the five most similar of every hundredth vector are found, against brute force, in nine cases of ten."""
    vectors = _table(spark, sf, "vectors")
    near = stage(neighbours.nearest(vectors), "nearest")
    named = F.xxhash64("content_hash")
    shares = []
    for p in sorted(r[0] for r in vectors.select("provider").filter("provider is not null").distinct().collect()):
        rows = stage(usable(vectors, p).select(named.alias("ord"), "content_hash", "vec"), "usable")
        asked = rows.filter(F.pmod("ord", F.lit(100)) == 0).select(F.col("ord").alias("query_id"), F.col("vec").alias("qvec"))
        true = cosine_topk(asked, rows, 6).filter("query_id <> ord").select("query_id", "ord", "score")
        fifth = true.groupBy("query_id").agg(F.expr("array_sort(collect_list(-score))[least(4, count(*) - 1)]").alias("least"), F.least(F.count("*"), F.lit(5)).alias("n"))
        found = near.filter(F.col("provider") == p).select(named.alias("query_id"), "cosine")
        hits = fifth.join(found, "query_id", "left").groupBy("query_id", "n").agg(F.count_if(F.col("cosine") >= -F.col("least") - 1e-5).alias("hits"))
        shares.append(hits.agg(F.lit(p).alias("provider"), (F.sum(F.least("hits", "n")) >= 0.9 * F.sum("n")).alias("reached")))
    return reduce(DataFrame.unionAll, shares)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return docpairs.pair_documentation(_table(spark, sf, "chunks")).select("ord")


def p5_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return docpairs.pair_documentation(_table(spark, sf, "chunks"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return segments.boundaries(segments.split_oversized(_table(spark, sf, "chunks"))).select("ord", "line_no").distinct()


def p6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return segments.split_oversized(_table(spark, sf, "chunks")).drop("boundaries")


def p6_check(spark: SparkSession, sf: str) -> DataFrame:
    """Per oversized chunk: its text put together again, its first and last line, whether all pieces keep the limits."""
    pieces = segments.split_oversized(_table(spark, sf, "chunks"))
    lines = F.split("text", "\n")
    own = F.array_join(F.slice(lines, F.col("overlap_lines") + 1, F.greatest(F.size(lines) - F.col("overlap_lines"), F.lit(0))), "\n")
    over = F.length(F.array_join(F.slice(lines, 1, F.col("overlap_lines")), "\n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", own.alias("t")))), lambda x: x["t"]), "")
    return pieces.groupBy("ord").agg(
        F.md5(whole).alias("text"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"),
        ((F.max(F.length("text")) <= 1500) & (F.max(over) <= 150)).alias("in_limits"),
    )


def p7_check(spark: SparkSession, sf: str) -> DataFrame:
    """Per document: characters its pieces cover one after the other, and whether it is whole or each of its pieces but the last one full."""
    rows = packing.pack(_table(spark, sf, "documents"))
    by = Window.partitionBy("doc_id").orderBy("piece")
    rows = rows.withColumn("gap", F.col("start_pos") - F.coalesce(F.lag("end_pos").over(by), F.lit(0))).withColumn("last", F.lead("piece").over(by).isNull())
    # a cut within a character is moved back to its start, by three tokens at most
    fits = F.when(F.col("last"), F.col("n_tokens") <= 2048).otherwise(F.col("n_tokens").between(2045, 2048))
    return rows.groupBy("doc_id").agg(F.max("end_pos").alias("chars"), (F.bool_and(F.col("gap") == 0) & F.bool_and(fits)).alias("right"))


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Containers that hold too much, and whether their number is at most a hundredth above the least that could hold all tokens."""
    rows = packing.pack(_table(spark, sf, "documents")).filter("container_id is not null")
    filled = rows.groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return filled.agg(F.count_if(F.col("n") > 2048).alias("overfull"), (F.count("*") <= 1 + 1.01 * F.ceil(F.sum("n") / 2048)).alias("tight"))


def p7_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_table(spark, sf, "documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    found = leakage.find_leaks(_table(spark, sf, "documents"), _table(spark, sf, "eval_passages"))
    return found.select("doc_id", "passage_id")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.split_sentences(_table(spark, sf, "documents"))


def p9_check(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences that overlap, begin or end with white space, reach over a blank line, or hold no letter or digit."""
    docs = _table(spark, sf, "documents").select("doc_id", "text").distinct()
    by = Window.partitionBy("doc_id").orderBy("start_pos", "end_pos")
    rows = sentences.split_sentences(docs).withColumn("gap", F.col("start_pos") - F.lag("end_pos").over(by)).join(docs, "doc_id")
    t = F.expr("substring(text, start_pos + 1, end_pos - start_pos)")
    rows = rows.select("gap", t.alias("t"))
    return rows.agg(
        F.count_if(F.col("gap") < 0).alias("overlapping"),
        F.count_if(F.col("t").rlike(r"^\s|\s$")).alias("ragged"),
        F.count_if(F.col("t").rlike(r"\n[ \t\r]*\n")).alias("across"),
        F.count_if(~F.col("t").rlike(r"[\p{L}\p{N}_]")).alias("wordless"),
    )


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p1_reasons": p1_reasons,
        "p2_found": p2_found,
        "p2_report": p2_report,
        "p3_found": p3_found,
        "p4_found": p4_found,
        "p4_nearest": p4_nearest,
        "p4_recall": p4_recall,
        "p5_found": p5_found,
        "p5_pairs": p5_pairs,
        "p6_found": p6_found,
        "p6_pieces": p6_pieces,
        "p6_check": p6_check,
        "p7_pack": p7_pack,
        "p7_check": p7_check,
        "p7_containers": p7_containers,
        "p8_found": p8_found,
        "p9_found": p9_found,
        "p9_check": p9_check,
    }


def oracle_sql() -> dict[str, str]:
    from corvane.llm.sql import ORACLES

    return dict(ORACLES)
