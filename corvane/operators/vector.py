"""Vector search: stored dense vectors and hashed term vectors against a stated query set, in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.bm25 import top

BUCKETS = 512


def dot(a: str, b: str):
    """Dot product of two array columns, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, block_bytes: int = 64_000_000) -> DataFrame:
    """``query_id ord score rank`` of unit vectors: columns ``query_id qvec`` against ``ord vec``.

    Where both have a column ``scope``, a query meets only the vectors of its own scope, and a null
    scope none. The stated query set is sent to the workers in blocks of bounded size; each batch
    of vectors is multiplied with a block at once and a partition keeps its best ``k`` per query
    before anything is shuffled. Scores are rounded to nine places; only positive ones count.
    """
    scoped = "scope" in queries.columns and "scope" in vectors.columns
    scope = ["scope"] if scoped else []
    q = queries.select("query_id", *scope, F.col("qvec").cast("array<double>").alias("qvec")).filter("qvec is not null")
    width = q.agg(F.max(F.size("qvec"))).first()[0] or 0
    v = vectors.select(F.col("ord").cast("bigint").alias("ord"), *scope, F.col("vec").cast("array<double>").alias("vec")).filter("vec is not null")
    rows = lambda r: np.array([x[-1] for x in r], dtype=np.float64)
    return _in_blocks(q, v, k, width, block_bytes, scoped, rows, _dense_rows)


def hashed_topk(query_vectors: DataFrame, chunk_vectors: DataFrame, k: int, block_bytes: int = 64_000_000) -> DataFrame:
    """As ``cosine_topk`` for hashed vectors: ``query_id scope buckets weights`` against ``scope ord buckets weights``."""
    q = query_vectors.select("query_id", "scope", "buckets", "weights")
    v = chunk_vectors.select("ord", "scope", "buckets", "weights")

    def rows(r: list) -> np.ndarray:
        m = np.zeros((len(r), BUCKETS))
        for i, x in enumerate(r):
            m[i, x[-2]] = x[-1]
        return m

    return _in_blocks(q, v, k, BUCKETS, block_bytes, True, rows, _sparse_rows)


def _in_blocks(q: DataFrame, v: DataFrame, k: int, width: int, block_bytes: int, scoped: bool, matrix: Callable, reader: Callable) -> DataFrame:
    """The best ``k`` of all blocks of a query set."""
    spark = q.sparkSession
    kind = q.schema["query_id"].dataType.simpleString()
    total = q.count()
    if not total:
        return spark.createDataFrame([], f"query_id {kind}, ord bigint, score double, rank int")
    blocks = 1 + total * width * 8 // block_bytes
    out = None
    for b in range(blocks):
        rows = (q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows] if scoped else None, matrix(rows)))
        part = v.mapInArrow(_multiply(shared, k, kind, reader), f"query_id {kind}, ord bigint, score double")
        out = part if out is None else out.unionAll(part)
    return top(out, k)


def _dense_rows(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the full length, their matrix) of the last column."""
    column = batch.column(batch.num_columns - 1)
    offsets = column.offsets.to_numpy()
    fits = np.flatnonzero(np.diff(offsets) == width)
    flat = column.values.to_numpy(zero_copy_only=False)
    return fits, flat[offsets[fits][:, None] + np.arange(width)] if len(fits) else np.empty((0, width))


def _sparse_rows(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    buckets, weights = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
    n = np.diff(buckets.offsets.to_numpy())
    m = np.zeros((batch.num_rows, width))
    start, stop = buckets.offsets[0].as_py(), buckets.offsets[-1].as_py()
    m[np.repeat(np.arange(batch.num_rows), n), buckets.values.to_numpy(zero_copy_only=False)[start:stop]] = weights.flatten().to_numpy(zero_copy_only=False)
    return np.arange(batch.num_rows), m


def _best(parts: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` per query of (query, ord, score) arrays; ties go to the smaller ``ord``."""
    qi, o, s = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((o, -s, qi))
    qi, o, s = qi[order], o[order], s[order]
    new = np.flatnonzero(np.concatenate(([True], qi[1:] != qi[:-1])))
    place = np.arange(len(qi)) - np.repeat(new, np.diff(np.append(new, len(qi))))
    keep = place < k
    return qi[keep], o[keep], s[keep]


def _multiply(shared, k: int, kind: str, reader: Callable, most: int = 2_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scopes, q = shared.value
        own: dict = {}
        for i, s in enumerate(scopes if scopes is not None else [0] * len(ids)):
            if s is not None:
                own.setdefault(s, []).append(i)
        parts: list[tuple] = []
        held = 0
        for b in batches:
            if not b.num_rows:
                continue
            ords = b.column(0).to_numpy()
            rows, m = reader(b, q.shape[1])
            groups: dict = {}
            if scopes is None:
                groups[0] = np.arange(len(rows))
            else:
                names = b.column(1).to_pylist()
                for j, r in enumerate(rows.tolist()):
                    if names[r] in own:
                        groups.setdefault(names[r], []).append(j)
            for scope, at in groups.items():
                at = np.asarray(at)
                near, mine = ords[rows[at]], np.array(own.get(scope, []), dtype=np.int64)
                for f in range(0, len(mine), 256):
                    part = mine[f : f + 256]
                    s = np.round(q[part] @ m[at].T, 9)
                    good = s > 0
                    if s.shape[1] > k:
                        # ties at the border stay until the ranking by ord
                        good &= s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
                    r, c = np.nonzero(good)
                    parts.append((part[r], near[c], s[r, c]))
                    held += len(r)
            if held > most:
                parts = [_best(parts, k)]
                held = len(parts[0][0])
        if held:
            qi, o, s = _best(parts, k)
            first = pa.array([ids[i] for i in qi.tolist()], pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string())
            yield pa.RecordBatch.from_arrays([first, pa.array(o, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "ord", "score"])

    return run


def usable(vectors: DataFrame, provider: str) -> DataFrame:
    """``content_hash vec`` of a provider: one unit vector per hash, of the provider's usual length.

    Null, truncated and all-zero vectors and such with numbers that aren't finite are left out; of
    several for a hash the smallest counts.
    """
    own = vectors.filter((F.col("provider") == provider) & F.col("content_hash").isNotNull() & F.col("vec").isNotNull())
    own = own.select("content_hash", F.col("vec").cast("array<double>").alias("vec"))
    usual = own.filter(F.size("vec") > 0).groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    whole = own.filter((F.size("vec") == (usual["d"] if usual else -1)) & ~F.exists("vec", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    one = whole.filter(F.exists("vec", lambda x: x != 0)).groupBy("content_hash").agg(F.min("vec").alias("vec"))
    one = one.withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)))
    return one.select("content_hash", F.transform("vec", lambda x: x / F.col("norm")).alias("vec"))


def stored(chunks: DataFrame, vectors: DataFrame, provider: str) -> DataFrame:
    """``ord scope content_hash vec`` of the chunks with the stored vector of their content; null where there is none."""
    return chunks.select("ord", F.col("project_id").alias("scope"), "content_hash").join(usable(vectors, provider), "content_hash", "left")


def md5_bucket(term):
    """Bucket of a term by MD5, computed in the JVM."""
    return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint") % BUCKETS).cast("int")


def blake_buckets(vocabulary: DataFrame) -> DataFrame:
    """``term bucket`` by 8-byte BLAKE2b, big-endian, over the distinct terms only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.column(0).to_pylist()
            n = [int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "big") % BUCKETS for x in t]
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(n, pa.int32())], names=["term", "bucket"])

    return vocabulary.select("term").distinct().mapInArrow(run, "term string, bucket int")


def hashed(term_counts: DataFrame, keys: list[str], provider: str = "md5") -> DataFrame:
    """Unit term-frequency vectors, sparse, as ``keys.. buckets weights`` from ``keys.. term tf``.

    Rows partitioned by ``keys`` are summed and normalised where they are.

    ``provider``: ``md5`` stays in the JVM; ``hash`` is the exchangeable BLAKE2b one, for which
    only the distinct vocabulary visits a Python worker.
    """
    if provider == "md5":
        with_bucket = term_counts.withColumn("bucket", md5_bucket(F.col("term")))
    else:
        with_bucket = term_counts.join(blake_buckets(term_counts), "term")
    summed = with_bucket.groupBy(*keys, "bucket").agg(F.sum("tf").alias("tf"))
    whole = summed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bucket", "tf"))).alias("b"), F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    return whole.select(*keys, F.col("b.bucket").alias("buckets"), F.transform("b.tf", lambda x: x / F.col("norm")).alias("weights"))


def sparse_cosine(pairs: DataFrame, query_vectors: DataFrame, chunk_vectors: DataFrame) -> DataFrame:
    """``query_id ord cosine`` of stated pairs (``query_id ord``) of hashed vectors; only positive ones."""
    q = query_vectors.select("query_id", F.map_from_arrays("buckets", "weights").alias("q"))
    v = chunk_vectors.select("ord", "buckets", "weights")
    both = F.zip_with("buckets", "weights", lambda b, w: w * F.coalesce(F.try_element_at("q", b), F.lit(0.0)))
    cosine = F.round(F.aggregate(both, F.lit(0.0), lambda s, x: s + x), 9)
    return pairs.distinct().join(v, "ord").join(q, "query_id").select("query_id", "ord", cosine.alias("cosine")).filter("cosine > 0")
