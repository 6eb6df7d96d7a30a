"""Projects: their registry, the preview of a scan, long jobs, and the tools a client is given."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import snippet
from corvane.operators import chunks as chunk_ops
from corvane.plans.search import Index, MissingVectors, SearchConfig, search
from corvane.session import stage
from corvane.sources.tables import index_tree


@dataclass(frozen=True)
class Project:
    id: str
    name: str
    repo: str
    index: str
    provider: str = "hash"
    model: str | None = None
    mode: str | None = None
    chunks: int = 0
    files: int = 0
    added: str = ""
    checks: dict = field(default_factory=dict)


def load_registry(path: str | Path) -> list[Project]:
    """The registered projects; a registry that is missing or broken is empty."""
    names = {f.name for f in fields(Project)}
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))["projects"]
        return [Project(**{k: v for k, v in p.items() if k in names}) for p in found]
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        return []


def save_registry(path: str | Path, projects: list[Project]) -> None:
    """Replaces the registry at once, so that no reader meets half of it."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex[:8]}")
    part.write_text(json.dumps({"projects": [asdict(p) for p in projects]}, ensure_ascii=False, indent=2), encoding="utf-8")
    os.replace(part, path)


def register(path: str | Path, project: Project) -> list[Project]:
    """Adds a project, or puts it in the place of the one with its id, at the end."""
    projects = [p for p in load_registry(path) if p.id != project.id] + [project]
    save_registry(path, projects)
    return projects


def scan_preview(spark: SparkSession, root: str, out: str, vectors: DataFrame, provider: str, docs: bool = True) -> dict:
    """Q8: indexes a tree into ``out`` and tells what it holds and what embedding it would cost."""
    if not os.path.isdir(root):
        raise ValueError(f"no such directory: {root}")
    chunks, errors = index_tree(spark, root)
    if not docs:
        chunks = chunks.filter("source <> 'doc'")
    chunks.write.mode("overwrite").parquet(out)
    chunks = spark.read.parquet(out).withColumn("project_id", F.lit("scan"))
    errors = stage(errors, "errors")
    counts = chunks.agg(F.count("*").alias("chunks"), F.count_distinct("path").alias("files")).first()
    if not counts["chunks"]:
        raise ValueError(f"nothing to index below {root}")
    row = lambda df: df.drop("project_id").first().asDict()
    return {
        "repo": os.path.realpath(root), "index": out, "name": Path(os.path.realpath(root)).name, "provider": provider,
        "files": counts["files"], "chunks": counts["chunks"], "failed": errors.count(), "errors": [r["message"] for r in errors.orderBy("path").limit(5).collect()],
        "composition": row(chunk_ops.composition(chunks)), "language": row(chunk_ops.language_signal(chunks)), "estimate": row(chunk_ops.embedding_cost(chunks, vectors, provider)),
    }


@dataclass
class Job:
    id: str
    kind: str
    state: str = "running"
    done: int = 0
    total: int = 0
    error: str = ""
    result: object = None
    started: float = field(default_factory=time.time)
    ended: float | None = None


class Jobs:
    """Q10: work in the background, each in a Spark job group of its own, the last ``keep`` remembered."""

    def __init__(self, spark: SparkSession, keep: int = 20):
        self.spark, self.keep = spark, keep
        self._jobs: OrderedDict[str, Job] = OrderedDict()
        self._lock = threading.Lock()

    def start(self, kind: str, work: Callable[[Job], object]) -> Job:
        job = Job(uuid.uuid4().hex[:12], kind)
        with self._lock:
            self._jobs[job.id] = job
            while len(self._jobs) > self.keep:
                self._jobs.popitem(last=False)

        def run() -> None:
            self.spark.sparkContext.setJobGroup(job.id, kind, interruptOnCancel=True)
            try:
                job.result, job.state = work(job), "done"
            except Exception as e:
                job.state, job.error = "failed", f"{type(e).__name__}: {e}"
            job.ended = time.time()

        threading.Thread(target=run, daemon=True).start()
        return job

    def get(self, job_id: str) -> Job | None:
        with self._lock:
            return self._jobs.get(job_id)

    def cancel(self, job_id: str) -> None:
        self.spark.sparkContext.cancelJobGroup(job_id)


# What the tools say where there is nothing to show.
NO_HIT, NOT_THERE = "'{}' için sonuç yok.", "{} indekste yok. Önce search_code ile arayın."


class Tools:
    """Q11: the three tools of a client: search, the whole text of a chunk, what the index holds.

    The index is opened at the first call. What keeps it from being searched is told, not raised.
    """

    def __init__(self, open_chunks: Callable[[], DataFrame], where: str, provider: str = "md5", stored: Callable[[], DataFrame] | None = None, config: SearchConfig | None = None):
        self._open, self.where, self.provider, self._stored = open_chunks, where, provider, stored
        self.config = config or SearchConfig()
        self._index: Index | None = None

    def _ready(self) -> Index:
        if self._index is None:
            chunks = self._open()
            if "project_id" not in chunks.columns:
                chunks = chunks.withColumn("project_id", F.lit("index"))
            self._index = Index(chunks, self.provider, self._stored() if self._stored else None)
        return self._index

    def search_code(self, query: str, limit: int = 5, vector: list[float] | None = None) -> str:
        try:
            index = self._ready()
            scopes = index.docs.select(F.col("project_id").alias("scope")).distinct()
            q = scopes.select(F.lit("q").alias("query_id"), "scope", F.lit(query).alias("text"))
            if vector is not None:
                q = q.withColumn("vec", F.lit(vector).cast("array<double>"))
            hits = search(q, index, replace(self.config, k=limit))
            shown = hits.join(index.chunks.select("ord", "location", "kind", "name", snippet(F.col("text")).alias("body")), "ord").orderBy("pos")
            rows = shown.select("location", "kind", "name", "body").collect()
        except MissingVectors as e:
            return str(e)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return f"no index at {self.where}"
            raise
        return "\n\n".join(f"{r['location']}  [{r['kind']}] {r['name']}\n{r['body']}" for r in rows) or NO_HIT.format(query)

    def read_chunk(self, location: str) -> str:
        try:
            r = self._ready().chunks.filter(F.col("location") == location).orderBy("ord").select("location", "kind", "name", "text").limit(1).collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return f"no index at {self.where}"
            raise
        return f"{r[0]['location']}  [{r[0]['kind']}] {r[0]['name']}\n{r[0]['text']}" if r else NOT_THERE.format(location)

    def index_status(self) -> str:
        try:
            chunks = self._ready().chunks
            kinds = chunk_ops.count_by_kind(chunks).orderBy("kind").collect()
            files = chunks.select("path").distinct().count()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return f"no index at {self.where}"
            raise
        listed = ", ".join(f"{r['kind']}: {r['chunks']}" for r in kinds)
        return f"İndeks : {self.where}\nParça  : {sum(r['chunks'] for r in kinds)} ({files} dosya)\nTürler : {listed}\nArama  : {self.provider} / {self.config.mode}"
