"""Embedding and reranking services behind one interface each.

A service is a callable that takes a batch; batching, prefixes, normalisation and waiting out rate
limits are the same for all. Clients are imported only where a service is asked for, so the
engine needs none of them.
"""

from __future__ import annotations

import json
import math
import os
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.sources.tables import VersionedTable

# Batch size, waiting time and trials, and the task prefixes that a model family expects (document, query).
BATCH, WAIT_SECONDS, TRIALS = 32, 25, 8
TASK_PREFIXES = {"nomic-embed-text": ("search_document: ", "search_query: ")}
#: columns of a table of query vectors
QUERY_VECTORS = "provider string, query_key string, vec array<float>"


def retrying(call: Callable, transient: type[BaseException] | tuple, trials: int = TRIALS, wait: float = WAIT_SECONDS, sleep: Callable = time.sleep):
    """Result of ``call``, tried again after ``wait``, 2 * ``wait``, .. seconds; the last error is raised."""
    for trial in range(1, trials + 1):
        try:
            return call()
        except transient:
            if trial == trials:
                raise
            sleep(wait * trial)


def unit(vector: list[float]) -> list[float]:
    """A vector of length one; a zero vector stays."""
    norm = math.sqrt(sum(x * x for x in vector))
    return [x / norm for x in vector] if norm else list(vector)


@dataclass(frozen=True)
class ServiceEmbedder:
    """Embeds texts in batches by ``call(texts, purpose)``; the purpose is ``document`` or ``query``."""

    name: str
    call: Callable[[list[str], str], list[list[float]]]
    prefixes: tuple[str, str] = ("", "")
    batch: int = BATCH
    transient: tuple = ()
    wait: float = WAIT_SECONDS

    def _all(self, texts: list[str], purpose: str) -> list[list[float]]:
        out: list[list[float]] = []
        for s in range(0, len(texts), self.batch):
            part = [self.prefixes[purpose == "query"] + t for t in texts[s : s + self.batch]]
            out += map(unit, retrying(lambda part=part: self.call(part, purpose), self.transient, wait=self.wait))
        return out

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self._all(texts, "document")

    def embed_queries(self, texts: list[str]) -> list[list[float]]:
        return self._all(texts, "query")


@dataclass(frozen=True)
class ServiceReranker:
    """Scores documents by ``call(query, documents)``, one score for each document."""

    name: str
    call: Callable[[str, list[str]], list[float]]
    transient: tuple = ()
    wait: float = WAIT_SECONDS

    def score(self, query: str, documents: list[str]) -> list[float]:
        return retrying(lambda: self.call(query, documents), self.transient, wait=self.wait) if documents else []


def task_prefixes(model: str) -> tuple[str, str]:
    return next((pair for family, pair in TASK_PREFIXES.items() if model.startswith(family)), ("", ""))


def _key(name: str) -> str:
    value = os.environ.get(name)
    if not value:
        raise RuntimeError(f"{name} is not set")
    return value


def _hosted_client():
    import voyageai

    return voyageai.Client(api_key=_key("VOYAGE_API_KEY")), voyageai.error.RateLimitError


def _hosted(model: str | None) -> ServiceEmbedder:
    model = model or "voyage-code-3"
    client, limit = _hosted_client()
    return ServiceEmbedder(f"voyage:{model}", lambda texts, purpose: client.embed(texts, model=model, input_type=purpose).embeddings, transient=(limit,))


def _local(model: str | None) -> ServiceEmbedder:
    model = model or "nomic-embed-text"
    host = os.environ.get("OLLAMA_HOST", "http://localhost:11434").rstrip("/")

    def call(texts: list[str], purpose: str) -> list[list[float]]:
        body = json.dumps({"model": model, "input": texts}).encode()
        with urllib.request.urlopen(urllib.request.Request(f"{host}/api/embed", body, {"Content-Type": "application/json"}), timeout=120) as r:
            return json.loads(r.read())["embeddings"]

    return ServiceEmbedder(f"ollama:{model}", call, task_prefixes(model))


def _hosted_reranker(model: str | None) -> ServiceReranker:
    model = model or "rerank-2.5"
    client, limit = _hosted_client()

    def call(query: str, documents: list[str]) -> list[float]:
        scores = [0.0] * len(documents)
        for r in client.rerank(query=query, documents=documents, model=model, top_k=len(documents)).results:
            scores[r.index] = float(r.relevance_score)
        return scores

    return ServiceReranker(f"voyage:{model}", call, transient=(limit,))


#: services by name; others can be added
EMBEDDERS: dict[str, Callable[[str | None], ServiceEmbedder]] = {"voyage": _hosted, "ollama": _local}
RERANKERS: dict[str, Callable[[str | None], ServiceReranker]] = {"voyage": _hosted_reranker}


def embedder(provider: str, model: str | None = None) -> ServiceEmbedder:
    """T5: the embedder of a name; hashed vectors need none."""
    if provider not in EMBEDDERS:
        raise ValueError(f"unknown provider {provider!r}, expected one of {sorted(EMBEDDERS)}")
    return EMBEDDERS[provider](model)


def reranker(provider: str | None, model: str | None = None) -> ServiceReranker | None:
    """The reranker of a name; ``none`` turns reranking off."""
    if provider in (None, "", "none"):
        return None
    if provider not in RERANKERS:
        raise ValueError(f"unknown reranker {provider!r}, expected none or one of {sorted(RERANKERS)}")
    return RERANKERS[provider](model)


def with_query_vectors(queries: DataFrame, service: ServiceEmbedder, table: VersionedTable) -> DataFrame:
    """``queries`` with ``vec``; only texts that the table (``QUERY_VECTORS``) doesn't hold are embedded, each once."""
    key = F.concat(F.lit("query::"), F.substring(F.sha2(F.col("text"), 256), 1, 16))
    asked = queries.withColumn("query_key", key)
    own = table.read().filter(F.col("provider") == service.name)
    todo = asked.filter("text is not null").select("query_key", "text").dropDuplicates(["query_key"]).join(own, "query_key", "left_anti")

    def run(batches: Iterator):
        for pdf in batches:
            pdf["vec"] = service.embed_queries(pdf["text"].tolist())
            pdf["provider"] = service.name
            yield pdf[["provider", "query_key", "vec"]]

    known = table.upsert(todo.mapInPandas(run, QUERY_VECTORS)).filter(F.col("provider") == service.name)
    return asked.join(known.select("query_key", "vec"), "query_key", "left").drop("query_key")


# What a service's error message says, and what a user can do about it.
HINTS = (
    (("anthropic-workspace-id", "not scoped to a workspace"), "the key belongs to an organisation: make one in a workspace or set ANTHROPIC_WORKSPACE_ID"),
    (("must be a valid workspace ID",), "ANTHROPIC_WORKSPACE_ID is wrong"),
    (("authentication_error", "invalid x-api-key"), "the API key is invalid or revoked"),
    (("credit balance",), "the credit is used up"),
)


def error_hint(error: BaseException) -> str | None:
    """What to do about a service's error, or None where it isn't known."""
    text = str(error)
    return next((hint for marks, hint in HINTS if any(m in text for m in marks)), None)
