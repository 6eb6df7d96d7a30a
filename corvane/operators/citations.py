"""Citations: windows of source lines, verification, rendering for a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import citations, lines, numbered

BEFORE, AFTER, MAX_LINES = 6, 12, 400


def answer_citations(answers: DataFrame) -> DataFrame:
    """``answer_id scope n citation path line`` of the distinct citations of every answer, in order.

    ``answers``: ``answer_id scope text``; the scope is the code base that an answer is about.
    """
    rows = answers.select("answer_id", "scope", F.posexplode(citations(F.col("text"))).alias("n", "citation"))
    path = F.regexp_replace("citation", ":[^:]*$", "")
    return rows.withColumn("path", path).withColumn("line", F.expr("try_cast(regexp_extract(citation, '([0-9]+)$', 1) as bigint)"))


def tails(path: Column) -> Column:
    """A path and all its endings behind a slash."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def verify(cited: DataFrame, files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Adds ``target`` and ``verified`` to citations; an answer meets the files of its scope only.

    ``files``: ``scope path n_lines`` of every file; ``indexed``: ``scope path`` of those in the
    index. A path is taken as it stands if there is such a file; else as the only indexed path
    that ends with it; of several, as the only one that the same answer spells out. The line must
    exist. An ending that many paths share is one row with their number, so that a common file
    name multiplies nothing; the paths themselves are met only where an answer spells them out.
    """
    key = ["answer_id", "scope", "n"]
    exact = cited.join(files.select("scope", "path", F.col("n_lines").alias("exact_lines")), ["scope", "path"], "left")
    known = indexed.select("scope", "path").distinct()
    ends = known.select("scope", "path", F.explode(tails(F.col("path"))).alias("tail")).groupBy("scope", "tail").agg(
        F.count("*").alias("all"), F.min("path").alias("one")
    )
    open_ = exact.filter("exact_lines is null").select(*key, F.regexp_replace("path", "^/+", "").alias("tail"))
    matched = open_.join(ends, ["scope", "tail"])
    spelled = cited.filter(F.col("path").contains("/")).select("answer_id", "scope", "path").distinct().join(known, ["scope", "path"], "left_semi")
    named = spelled.select("answer_id", "scope", "path", F.explode(tails(F.col("path"))).alias("tail")).groupBy("answer_id", "scope", "tail").agg(
        F.count("*").alias("few"), F.min("path").alias("named")
    )
    matched = matched.join(named, ["answer_id", "scope", "tail"], "left")
    target = F.when(F.col("all") == 1, F.col("one")).when(F.col("few") == 1, F.col("named"))
    resolved = matched.select(*key, target.alias("by_suffix")).join(
        files.select("scope", F.col("path").alias("by_suffix"), F.col("n_lines").alias("suffix_lines")), ["scope", "by_suffix"], "left"
    )
    out = exact.join(resolved, key, "left")
    out = out.withColumn("target", F.when(F.col("exact_lines").isNotNull(), F.col("path")).when(F.col("suffix_lines").isNotNull(), F.col("by_suffix")))
    total = F.coalesce("exact_lines", "suffix_lines")
    return out.withColumn("verified", F.coalesce(F.col("line").between(F.lit(1), total), F.lit(False))).select(*key, "citation", "target", "verified")


def source_lines(chunks: DataFrame) -> DataFrame:
    """``project_id path line_no text``: the lines of the chunks at their places, each line once."""
    rows = chunks.filter(F.col("text").isNotNull()).select("project_id", "path", F.coalesce("start_line", F.lit(1)).alias("s"), F.posexplode(lines(F.col("text"))).alias("i", "text"))
    return rows.groupBy("project_id", "path", (F.col("s") + F.col("i")).alias("line_no")).agg(F.min("text").alias("text"))


def source_window(cited: DataFrame, lines: DataFrame, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """The lines around each cited line (``project_id path line``), within the file.

    The range is unrolled into the line numbers it holds, so the join is an equi-join.
    """
    wanted = cited.withColumn("line_no", F.explode(F.sequence(F.greatest(F.lit(1), F.col("line") - before), F.col("line") + after)))
    return wanted.join(lines, ["project_id", "path", "line_no"])


def read_lines(lines: DataFrame, path: str, start: int, end: int) -> DataFrame:
    """Numbered lines of a file, at most ``MAX_LINES``."""
    end = min(end, start + MAX_LINES - 1)
    return lines.filter((F.col("path") == path) & F.col("line_no").between(start, end)).orderBy("line_no")


def rendered(kind: Column, name: Column, location: Column, text: Column, start_line: Column) -> Column:
    """A hit as it is put into a prompt."""
    return F.concat(F.lit("--- "), location, F.lit("  ["), kind, F.lit("] "), name, F.lit("\n"), numbered(text, start_line))
