"""Sentences that place a chunk in its file, written by a model and kept in a table.

The chunks of a file stay together in one task, so that a service's prompt cache holds the file's
text while they are described. A sentence is asked for once for each (language, model, content).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.plans.answer import enrich
from corvane.session import stage
from corvane.sources.tables import VersionedTable

# Characters of a file that are sent, and the languages of a sentence.
FILE_CHARS, LANGUAGES = 60_000, ("tr", "en")
#: columns of the table of sentences
SENTENCES = "lang string, model string, content_hash string, sentence string"
_FOUND = "content_hash string, sentence string, error string"


class Fatal(Exception):
    """An error after which no further call makes sense, such as a refused key."""


@dataclass(frozen=True)
class Describer:
    """``call(file_text, chunk)`` gives the sentence of a chunk (a dict with name, path, lines and text)."""

    model: str
    call: Callable[[str, dict], str]
    language: str = "tr"
    transient: tuple = (TimeoutError, ConnectionError)
    trials: int = 4
    wait: float = 1.0

    def __post_init__(self):
        if self.language not in LANGUAGES:
            raise ValueError(f"unknown language {self.language!r}, expected one of {LANGUAGES}")

    def describe(self, text: str, chunk: dict) -> str:
        for trial in range(self.trials):
            try:
                return self.call(text, chunk).strip()
            except self.transient:
                if trial + 1 == self.trials:
                    raise
                time.sleep(self.wait * 2**trial)
        return ""


def sentence_table(spark, path: str) -> VersionedTable:
    """The sentences that are known."""
    return VersionedTable(spark, path, SENTENCES, ["lang", "model", "content_hash"])


def _describe(describer: Describer):
    def run(pdf):
        rows, stopped = [], ""
        for r in pdf.sort_values(["start_line", "content_hash"]).drop_duplicates("content_hash").to_dict("records"):
            if stopped:
                rows.append((r["content_hash"], None, stopped))
                continue
            chunk = {k: r[k] for k in ("path", "name", "start_line", "end_line", "text")}
            try:
                rows.append((r["content_hash"], describer.describe(r["content"], chunk), None))
            except Fatal as e:
                stopped = f"stopped: {e}"
                rows.append((r["content_hash"], None, stopped))
            except describer.transient as e:
                rows.append((r["content_hash"], None, f"{r['path']}: {type(e).__name__}"))
        return type(pdf)(rows, columns=["content_hash", "sentence", "error"])

    return run


def contextualize(chunks: DataFrame, files: DataFrame, describer: Describer, known: VersionedTable) -> tuple[DataFrame, DataFrame]:
    """Q4: (chunks with their sentences, failures ``content_hash error``).

    ``files``: ``project_id path content`` with the text of every file, of which the first
    ``FILE_CHARS`` are sent. Chunks whose file isn't there, and those whose call failed, stay as
    they are; the next run asks for them again. After a fatal error a task asks no more.
    """
    mine = lambda t: t.filter((F.col("lang") == describer.language) & (F.col("model") == describer.model)).select("content_hash", "sentence")
    text = files.filter("content is not null and content <> ''").select("project_id", "path", F.substring("content", 1, FILE_CHARS).alias("content"))
    todo = chunks.filter("content_hash is not null").join(mine(known.read()), "content_hash", "left_anti").join(text, ["project_id", "path"])
    todo = todo.select("project_id", "path", "content_hash", "name", "start_line", "end_line", "text", "content")
    found = stage(todo.groupBy("project_id", "path").applyInPandas(_describe(describer), _FOUND), "sentences")
    new = found.filter("sentence is not null and sentence <> ''").groupBy("content_hash").agg(F.min("sentence").alias("sentence"))
    new = new.withColumn("lang", F.lit(describer.language)).withColumn("model", F.lit(describer.model))
    return enrich(chunks, mine(known.upsert(new))), found.filter("error is not null").select("content_hash", "error")
