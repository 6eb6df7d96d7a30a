"""Incremental indexing: files that arrive are chunked and merged into the index as they come.

An extension of the batch index, not a part of it: a file-arrival stream whose micro-batches
replace the chunks of the files they bring. Replaying a batch after a failure gives the same
state, as the merge is by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from corvane.operators.extract import EXTRACTED, chunks_of, extract
from corvane.sources.tables import VersionedTable

FILES = "path string, content string"
_COLUMNS = EXTRACTED.removesuffix(", error string") + ", live boolean"


def chunk_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, _COLUMNS, ["path", "part"])


def merge(table: VersionedTable, files: DataFrame) -> DataFrame:
    """Replace the chunks of the given files (``path content``); parts a file no longer has are put out."""
    new = chunks_of(extract(files)).withColumn("live", F.lit(True))
    gone = table.read().join(files.select("path").distinct(), "path", "left_semi").join(new.select("path", "part"), ["path", "part"], "left_anti")
    return table.upsert(new.unionByName(gone.withColumn("live", F.lit(False))))


def current(table: VersionedTable) -> DataFrame:
    return table.read().filter("live").drop("live")


def follow(spark: SparkSession, incoming: str, index: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Stream JSON lines of files (``FILES``) from a folder into the chunk table at ``index``."""
    table = chunk_table(spark, index)
    stream = spark.readStream.schema(FILES).json(incoming)
    writer = stream.writeStream.foreachBatch(lambda df, _: merge(table, df)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
