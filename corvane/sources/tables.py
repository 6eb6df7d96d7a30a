"""Readers and writers of the engine's tables on disk."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane import schema
from corvane.operators.chunks import upsert
from corvane.operators.extract import chunks_of, errors_of, extract
from corvane.sources.tree import EXCLUDES, read_tree

_GROUP = 10_000  #: files that share an offset in the order of the walk


def index_tree(spark: SparkSession, root: str, excludes: frozenset[str] | set[str] = EXCLUDES) -> tuple[DataFrame, DataFrame]:
    """(chunks, errors) of a source tree: code in the order of the walk, then documents."""
    code, docs = read_tree(spark, root, excludes=excludes), read_tree(spark, root, docs=True, excludes=excludes)
    files = code.withColumn("doc", F.lit(0)).unionByName(docs.withColumn("doc", F.lit(1)))
    found = extract(files.filter("error is null"))
    places = files.select("path", "doc", "place")
    rows = chunks_of(found).join(places, "path").filter("(doc = 1) = (source = 'doc')")
    # the order of the walk, without gaps: parts are offset by the files before theirs, and files
    # by the groups of files before theirs, so that no task sees a row per file of the whole tree
    sizes = rows.groupBy("doc", "place").agg(F.count("*").alias("n")).withColumn("group", F.expr(f"place div {_GROUP}"))
    to_here = (Window.unboundedPreceding, -1)
    groups = sizes.groupBy("doc", "group").agg(F.sum("n").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy("doc", "group").rowsBetween(*to_here)), F.lit(0))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("doc", "group").orderBy("place").rowsBetween(*to_here)), F.lit(0))
    sizes = sizes.withColumn("within", within).join(groups.withColumn("above", above).drop("n"), ["doc", "group"])
    rows = rows.join(sizes.select("doc", "place", (F.col("above") + F.col("within")).alias("before")), ["doc", "place"])
    rows = rows.withColumn("ord", F.col("before") + F.col("part"))
    ident = F.concat("path", F.lit("::"), "name", F.lit("#"), F.col("start_line").cast("string"))
    chunks = rows.withColumn("id", ident).withColumn("llm_context", F.lit(None).cast("string"))
    errors = errors_of(found).unionByName(files.filter("error is not null").select("path", F.col("error").alias("message")))
    return chunks.select(*[c.split()[0] for c in schema.CHUNKS.split(", ")]), errors


def read_jsonl(spark: SparkSession, path: str, columns: str = schema.CHUNKS) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped, broken ones are an error."""
    return spark.read.schema(columns).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_questions(spark: SparkSession, path: str, split: str = "all") -> DataFrame:
    """Questions of a question-set document; a missing field or a repeated id is an error."""
    doc = spark.read.schema(f"repo string, index string, questions array<struct<{_struct(schema.QUESTIONS)}>>").option("multiLine", True).json(path)
    q = doc.select(F.explode("questions").alias("q")).select("q.*").withColumn("split", F.coalesce("split", F.lit("dev")))
    bad = q.agg(
        F.count_if(F.col("id").isNull() | F.col("question").isNull() | (F.coalesce(F.size("expect_files"), F.lit(0)) < 1)).alias("missing"),
        (F.count("*") - F.countDistinct("id")).alias("repeated"),
    ).first()
    if bad["missing"]:
        raise ValueError(f"{bad['missing']} questions lack id, question or expect_files")
    if bad["repeated"]:
        raise ValueError("ids occur more than once")
    out = q if split == "all" else q.filter(F.col("split") == split)
    if out.limit(1).count() == 0:
        raise ValueError(f"no question in split {split}")
    return out


def _struct(columns: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (c.split(" ", 1) for c in columns.split(", ")))


class VersionedTable:
    """A Parquet table with upserts, on any file system Spark writes to.

    Every state is a folder of its own, which counts once it is complete, so readers never see
    half a write and a failed write leaves the last state as it was. A writer claims the number of
    its state by creating a file that must not be there yet: of two writers at once the second one
    builds on what the first has written. The last ``keep`` states stay for readers still at them.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str, key: list[str], keep: int = 2):
        self.spark, self.path, self.columns, self.key, self.keep = spark, path.rstrip("/"), columns, key, keep
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        self._at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)

    def _states(self) -> list[str]:
        """Names of the complete states, the oldest first."""
        if not self.fs.exists(self._at(self.path)):
            return []
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(self._at(self.path)))
        return [n for n in names if n.startswith("state-") and self.fs.exists(self._at(f"{self.path}/{n}/_SUCCESS"))]

    def read(self) -> DataFrame:
        """The current state; a table never written is empty."""
        done = self._states()
        return self.spark.read.schema(self.columns).parquet(f"{self.path}/{done[-1]}") if done else self.spark.createDataFrame([], self.columns)

    def _create(self, path: str) -> None:
        """Creates a file that must not be there yet."""
        at = self.fs.makeQualified(self._at(path))
        self.fs.mkdirs(at.getParent())
        if self.fs.getScheme() == "file":  # Hadoop's local file system looks first and creates then
            os.close(os.open(at.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        else:
            self.fs.create(at, False).close()

    def _claim(self, wait: float, poll: float = 0.2) -> tuple[int, str]:
        """The number of the next state and its claim, once no other writer holds it."""
        until, failures = time.monotonic() + wait, 0
        while True:
            done = self._states()
            number = int(done[-1].removeprefix("state-")) + 1 if done else 0
            claim = f"{self.path}/claim-{number:08d}"
            try:
                self._create(claim)
                if len(self._states()) == len(done):
                    return number, claim
                self.fs.delete(self._at(claim), False)
            except Exception as e:
                # a claim that is gone by now was another writer's; one that never comes about is an error
                failures = 0 if self.fs.exists(self._at(claim)) else failures + 1
                if failures > 20:
                    raise
                if time.monotonic() > until:
                    raise TimeoutError(f"another writer holds {claim}; remove the file if none is at work") from e
                time.sleep(poll)

    def upsert(self, new: DataFrame, wait: float = 600.0) -> DataFrame:
        """Merge rows by key, the new ones win; of new rows with one key the greatest counts."""
        names = [c.split()[0] for c in self.columns.split(", ")]
        rest = [n for n in names if n not in self.key]
        one = new.select(*names).groupBy(*self.key).agg(F.max(F.struct(*rest)).alias("r")).select(*self.key, "r.*").select(*names)
        number, claim = self._claim(wait)
        target = f"{self.path}/state-{number:08d}"
        try:
            upsert(self.read(), one, self.key).write.mode("overwrite").parquet(target)
        finally:
            self.fs.delete(self._at(claim), False)
        for old in self._states()[: -self.keep]:
            self.fs.delete(self._at(f"{self.path}/{old}"), True)
        return self.read()
