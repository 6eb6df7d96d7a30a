"""Problem 4: the k most similar vectors of every vector.

Balanced posting lists: centroids, in proportion to the vectors, come from balanced k-means in two
levels: coarse cells are fitted on a bounded sample, the centroids of each cell by Spark on a
sample of the cell. All of them are compared where that costs less than a best-first walk over a
graph of their nearest neighbours, held in memory; every vector goes to the lists of its nearest
centroids, several if it lies near a border. As all vectors are queries too, the lists that hold a vector are
the lists searched for it. Each list is compared with itself by matrix products; the best k of
all lists of a vector are its neighbours.

With a floor on the cosine, r the distance at the floor, every list within r of the nearest
centroid's distance would hold every pair: of two vectors, the nearest centroid of the one nearer
to its own is within r of that for the other. ``enough`` of them, more with more centroids, hold a pair
at the floor with a probability near 0.999 however many vectors there are. Without a floor, lists
are chosen by number and by the ratio of the distances.

Equal vectors are one entry with their first few keys, so a group of copies costs one row.
Lists that outgrow a task are cut into blocks, and each pair of blocks is a task of its own.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import stage

#: rows read to fit the coarse cells of one provider, rows a task fits centroids on, rows per centroid there
SAMPLE, CELL_SAMPLE, PER_CENTROID = 32_768, 32_768, 64
#: bytes of all centroids and their graph, which every worker holds
CENTROID_BYTES = 256_000_000
_DEGREE, _ENTRIES = 24, 16
#: up to so many centroids all are compared with a vector, beyond the graph is walked
EXACT = 65_536
#: rows of lists in a shuffle, or twice the vectors if that is more
ROUND = 2_000_000
_SEEN = 32_000_000  #: marks of visited centroids held at a time


def balanced_kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors; crowded centroids lose members to their neighbours."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    penalty = np.zeros(k, dtype=np.float32)
    for _ in range(rounds):
        label = np.empty(len(x), dtype=np.int64)
        for s in range(0, len(x), 4096):
            label[s : s + 4096] = np.argmax(x[s : s + 4096] @ c.T - penalty, axis=1)
        size = np.bincount(label, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, label, x)
        empty = size == 0
        total[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
        penalty += np.float32(0.02) * (size / max(1.0, len(x) / k) - 1).clip(-1, 3).astype(np.float32)
        penalty -= penalty.min()
        penalty = np.minimum(penalty, np.float32(0.1))
    return np.ascontiguousarray(c, dtype=np.float32)


class CentroidGraph:
    """Centroids with a neighbour graph; finds the nearest centroids of many vectors at once."""

    def __init__(self, c: np.ndarray, whole: int = 8_192):
        self.c = c
        k = len(c)
        degree = min(_DEGREE, k - 1)
        self.next = np.zeros((k, degree), dtype=np.int32)
        if k <= whole:
            groups = [(np.arange(s, min(s + 1024, k)), np.arange(k)) for s in range(0, k, 1024)]
        else:
            groups = self._cells(c)
        for own, near in groups:
            sim = c[own] @ c[near].T
            sim[own[:, None] == near[None, :]] = -2
            top = np.argpartition(-sim, degree - 1, axis=1)[:, :degree] if degree else np.empty((len(own), 0), int)
            self.next[own] = near[top]
        # entries spread by farthest-first choice
        entries = [0]
        near = c @ c[0]
        for _ in range(min(_ENTRIES, k) - 1):
            entries.append(int(np.argmin(near)))
            near = np.maximum(near, c @ c[entries[-1]])
        self.entries = np.array(sorted(set(entries)))

    @staticmethod
    def _cells(c: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(centroids, those to look for their neighbours in): cells of about a thousand, each with its nearest ones."""
        m = -(-len(c) // 1024)
        middle = balanced_kmeans(c[:: max(1, len(c) // 32_768)], m)
        label = np.concatenate([np.argmax(c[s : s + 4096] @ middle.T, axis=1) for s in range(0, len(c), 4096)])
        members = [np.flatnonzero(label == i) for i in range(m)]
        near = np.argsort(-(middle @ middle.T), axis=1)[:, :8]
        out = []
        for i, own in enumerate(members):
            around = np.concatenate([members[j] for j in near[i]])
            out += [(own[s : s + 1024], around) for s in range(0, len(own), 1024) if len(around) > _DEGREE]
        return out

    def _all(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        sim = q @ self.c.T
        k = sim.shape[1]
        if k < 32 * width:
            ids = np.argpartition(-sim, width - 1, axis=1)[:, :width] if k > width else np.broadcast_to(np.arange(k), sim.shape)
        else:
            # the best are not below the width-th best of the maxima of disjoint groups
            even = k // 32 * 32
            most = np.hstack([sim[:, :even].reshape(len(q), 32, -1).max(axis=1), sim[:, even:]])
            least = -np.partition(-most, width - 1, axis=1)[:, width - 1]
            r, c = np.divmod(np.flatnonzero(sim >= least[:, None]), k)
            order = np.lexsort((-sim[r, c], r))
            first = np.searchsorted(r, np.arange(len(q)))
            ids = c[order][first[:, None] + np.arange(width)]
        found = np.take_along_axis(sim, ids, axis=1)
        order = np.argsort(-found, axis=1)
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(found, order, axis=1)

    def search(self, q: np.ndarray, width: int, beam: int = 24, steps: int = 40, exact: int = EXACT) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines), best first, of up to ``width`` centroids for every row of ``q``."""
        n, k = len(q), len(self.c)
        beam = max(beam, 2 * width)
        steps = max(steps, 2 * beam)
        if k <= max(beam, exact):
            step = max(16, 4_000_000 // k)
            parts = [self._all(q[s : s + step], width) for s in range(0, n, step)]
            return np.concatenate([ids for ids, _ in parts]), np.concatenate([sim for _, sim in parts])
        seen = np.zeros((n, k), dtype=bool)
        rows = np.arange(n)[:, None]
        ids = np.broadcast_to(self.entries, (n, len(self.entries))).astype(np.int32)
        sim = q @ self.c[self.entries].T
        seen[:, self.entries] = True
        open_ = np.ones(ids.shape, dtype=bool)
        for _ in range(steps):
            score = np.where(open_, sim, -3)
            at = np.argmax(score, axis=1)
            if (score[rows[:, 0], at] <= -3).all():
                break
            open_[rows[:, 0], at] = False
            new = self.next[ids[rows[:, 0], at]]
            fresh = ~seen[rows, new]
            seen[rows, new] = True
            s = np.einsum("nkd,nd->nk", self.c[new], q)
            s = np.where(fresh, s, -2).astype(np.float32)
            ids, sim, open_ = np.hstack([ids, new]), np.hstack([sim, s]), np.hstack([open_, fresh])
            if ids.shape[1] > beam:
                keep = np.argpartition(-sim, beam - 1, axis=1)[:, :beam]
                ids, sim, open_ = (np.take_along_axis(z, keep, axis=1) for z in (ids, sim, open_))
        order = np.argsort(-sim, axis=1)[:, :width]
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sim, order, axis=1)


def _clean(batches: Iterator[pa.RecordBatch], dims: dict[str | None, int]) -> Iterator[pa.RecordBatch]:
    names = ["provider", "content_hash", "digest", "v"]
    types = [pa.string(), pa.string(), pa.binary(), pa.binary()]
    for b in batches:
        providers, hashes = b.column(0).to_pylist(), b.column(1).to_pylist()
        column = b.column(2)
        offsets = column.offsets.to_numpy()
        flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
        valid = np.ones(len(column), bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
        rows = []
        for i, (p, h) in enumerate(zip(providers, hashes)):
            if not valid[i] or offsets[i + 1] - offsets[i] != dims.get(p, -1):
                continue
            x = flat[offsets[i] : offsets[i + 1]]
            norm = np.sqrt(x @ x) if np.isfinite(x).all() else 0.0
            if not (norm > 0 and np.isfinite(norm)):
                top = np.abs(x).max() if np.isfinite(x).all() else 0.0
                if top <= 0:
                    continue
                x = x / top
                norm = np.sqrt(x @ x)
            x = x / norm
            digest = xxhash.xxh3_128_digest(repr(p).encode() + np.rint(x * 1e5).astype(np.int32).tobytes())
            rows.append((p, h, digest, x.astype(np.float32).tobytes()))
        cols = zip(*rows) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def enough(centroids: int, floor: float) -> int:
    """Lists of every vector that hold two vectors at the floor together with a probability of 0.999 or near it.

    Measured on 4,000 pairs of random directions, where centroids help least, with 64, 512, 4,096 and
    32,768 centroids: at 0.8 at most 1 missed with 96, 128 and 768 numbers, at most 7 with 24; with
    128 numbers at most 4 at 0.85 and 0.9, 9 at 0.7 and 13 at 0.6.
    """
    return max(8, math.ceil((2 * math.log2(max(centroids, 1)) - 4) * (1 - floor) / 0.2))


def _assign(batches: Iterator[pa.RecordBatch], models, lists: int | None, ratio: float | None, floor: float) -> Iterator[pa.RecordBatch]:
    names = ["rep", "v", "lists"]
    reach = math.sqrt(max(0.0, 2 - 2 * floor))
    for b in batches:
        providers, raws = b.column(0).to_pylist(), b.column(2).to_pylist()
        groups: dict[str | None, list[int]] = {}
        for i, p in enumerate(providers):
            groups.setdefault(p, []).append(i)
        for p, own in groups.items():
            number, graph = models.value[p]
            step = max(16, min(1024, _SEEN // len(graph.c)))
            for s in range(0, len(own), step):
                part = own[s : s + step]
                q = np.frombuffer(b"".join(raws[i] for i in part), dtype=np.float32).reshape(len(part), -1)
                ids, sim = graph.search(q, lists or enough(len(graph.c), floor))
                dist = np.sqrt(np.maximum(2 - 2 * sim, 0))
                far = dist[:, :1] + reach if ratio is None else ratio * dist[:, :1]
                chosen = (dist <= far + 1e-6) & (sim > -1.5)
                keys = (np.int64(number) << 32) + ids[chosen].astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(chosen.sum(axis=1))]).astype(np.int32)
                at = pa.array(part)
                yield pa.RecordBatch.from_arrays(
                    [b.column(1).take(at), b.column(2).take(at), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))], names=names
                )


def _above(m: np.ndarray, floor: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(i, j, cosine) of all pairs i < j at the floor; None if there are more than ``most``.

    The product of the first numbers and that of the lengths of the rest bound a cosine from
    above (Cauchy-Schwarz), so one short product tells which pairs can't reach the floor.
    """
    head = min(m.shape[1], math.ceil(1.9 * (1 - floor) * m.shape[1]))
    short = np.hstack([m[:, :head], np.linalg.norm(m[:, head:], axis=1, keepdims=True)])
    found, number = [], 0
    for s in range(0, len(m), 256):
        r, c = np.divmod(np.flatnonzero(short[s : s + 256] @ short[s:].T >= floor - 1e-5), len(m) - s)
        later = c > r
        r, c = r[later] + s, c[later] + s
        if number + len(r) > most:
            return None
        cosine = np.einsum("ij,ij->i", m[r], m[c])
        kept = cosine >= floor
        found.append((r[kept], c[kept], cosine[kept]))
        number += len(r)
    return tuple(np.concatenate(x) for x in zip(*found))


def _compare(m: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine), i < j: pairs at the floor of which one is among the best ``k`` of the other in this list."""
    sparse = _above(m, floor, 64 * len(m)) if floor >= 0.5 else None
    if sparse:
        i, j, cosine = sparse
        a, b, both = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([cosine, cosine])
        order = np.lexsort((b, -both, a))
        a = a[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        best = np.zeros(len(i), dtype=bool)
        best[order[rank < k] % max(1, len(i))] = True
        return i[best], j[best], cosine[best]
    found = []
    step = max(64, min(1024, 8_000_000 // len(m)))
    for s in range(0, len(m), step):
        sim = m[s : s + step] @ m.T
        sim[np.arange(len(sim)), np.arange(s, s + len(sim))] = -3
        sim[sim < floor] = -3
        busy = np.flatnonzero(sim.max(axis=1) > -3)
        if not len(busy):
            continue
        sim = sim[busy]
        top = np.argpartition(-sim, k - 1, axis=1)[:, :k] if sim.shape[1] > k else np.broadcast_to(np.arange(sim.shape[1]), sim.shape)
        value = np.take_along_axis(sim, top, axis=1)
        r, c = np.nonzero(value > -3)
        i, j = s + busy[r], top[r, c]
        found.append((np.minimum(i, j), np.maximum(i, j), value[r, c]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    i, j, cosine = (np.concatenate(x) for x in zip(*found))
    _, once = np.unique(i * len(m) + j, return_index=True)
    return i[once], j[once], cosine[once]


def _search_lists(batches: Iterator[pa.RecordBatch], k: int, floor: float) -> Iterator[pa.RecordBatch]:
    """Rows (list, rep, v), sorted by list and rep -> (a, b, cosine), a before b, the best ``k`` of each row in its list."""
    now, group = None, []

    def done():
        if sum(len(x) for x, _ in group) < 2:
            return
        reps = pa.concat_arrays([x for x, _ in group])
        m = np.frombuffer(b"".join(v for _, x in group for v in x.to_pylist()), dtype=np.float32).reshape(len(reps), -1)
        i, j, cosine = _compare(m, k, floor)
        if len(i):
            yield pa.RecordBatch.from_arrays([reps.take(pa.array(i)), reps.take(pa.array(j)), pa.array(cosine.astype(np.float64))], names=["a", "b", "cosine"])

    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for s, e in zip(cuts, cuts[1:]):
            if e == s:
                continue
            if keys[s] != now:
                yield from done()
                now, group = keys[s], []
            group.append((batch.column(1).slice(s, e - s), batch.column(2).slice(s, e - s)))
    yield from done()


def dimensions(vectors: DataFrame) -> dict[str | None, int]:
    """The most frequent length per provider, which is its full length."""
    counts = vectors.filter(F.size("vec") > 0).groupBy("provider", F.size("vec").alias("d")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("provider").orderBy(F.desc("n"), F.desc("d"))
    return {r["provider"]: r["d"] for r in counts.withColumn("rn", F.row_number().over(w)).filter("rn = 1").collect()}


def _in_cells(batches: Iterator[pa.RecordBatch], coarse) -> Iterator[pa.RecordBatch]:
    for b in batches:
        providers, raws = b.column(0).to_pylist(), b.column(1).to_pylist()
        numbers, cells = [], []
        for p, raw in zip(providers, raws):
            number, c = coarse.value[p]
            numbers.append(number)
            cells.append(int(np.argmax(c @ np.frombuffer(raw, dtype=np.float32))))
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(cells, pa.int32()), pa.array(raws, pa.binary())], names=["number", "cell", "v"])


def _fit_cell(pdf):
    x = np.frombuffer(b"".join(pdf["v"].sort_values()), dtype=np.float32).reshape(len(pdf), -1)
    k = min(len(x), max(1, round(float(pdf["share"].iloc[0]) * len(x))))
    c = balanced_kmeans(x, k)
    return type(pdf)({"number": pdf["number"].iloc[0], "v": [r.tobytes() for r in c]})


def fit_centroids(reps: DataFrame, dims: dict[str | None, int], target: int) -> dict[str | None, tuple[int, CentroidGraph]]:
    """{provider: (its number, graph of its centroids)}, about one centroid for ``target`` vectors.

    ``reps``: ``provider rep v``. Lists grow beyond ``target`` only where all centroids together
    would exceed ``CENTROID_BYTES``, and with the root of the vectors beyond some 10 million.
    """
    spark = reps.sparkSession
    counts = sorted(((r[0], r[1]) for r in reps.groupBy("provider").count().collect()), key=str)
    if not counts:
        return {}
    total = sum(n for _, n in counts)
    # comparing a vector with all centroids should not cost more than comparing it with its lists
    target = max(target, math.isqrt(max(n for _, n in counts) // 160), -(-total * 4 * (max(dims.values()) + _DEGREE) // CENTROID_BYTES))
    coarse = {}
    part = F.pmod(F.xxhash64("rep"), F.lit(1_000_000))
    for number, (provider, n) in enumerate(counts):
        own = reps.filter(F.col("provider").eqNullSafe(provider))
        sample = own.filter(part < int(1_000_000 * min(1.0, 1.5 * SAMPLE / n))).select("rep", "v").orderBy(F.xxhash64("rep", F.lit(1))).limit(SAMPLE).collect()
        x = np.frombuffer(b"".join(bytes(r[1]) for r in sample), dtype=np.float32).reshape(-1, dims[provider])
        cells = max(1, min(math.isqrt(-(-n // target)), 1_024, len(x)))
        coarse[provider] = (number, balanced_kmeans(x, cells))
    shared = spark.sparkContext.broadcast(coarse)
    rate = min(1.0, PER_CENTROID / target)
    chosen = reps.filter(F.pmod(F.xxhash64("rep", F.lit(2)), F.lit(1_000_000)) < int(1_000_000 * rate)).select("provider", "v")
    chosen = stage(chosen.mapInArrow(partial(_in_cells, coarse=shared), "number int, cell int, v binary"), "cells")
    # a crowded cell is fitted in several tasks, each on its share of the sample
    size = chosen.groupBy("number", "cell").agg((F.count("*") / CELL_SAMPLE).cast("int").alias("more"))
    split = chosen.join(size, ["number", "cell"]).withColumn("part", F.pmod(F.xxhash64("v"), F.col("more") + 1))
    split = split.withColumn("share", F.lit(1.0 / (target * rate)))
    fine = split.groupBy("number", "cell", "part").applyInPandas(_fit_cell, "number int, v binary").collect()
    models = {}
    for provider, (number, c) in coarse.items():
        own = sorted(bytes(r["v"]) for r in fine if r["number"] == number)
        x = np.frombuffer(b"".join(own), dtype=np.float32).reshape(-1, dims[provider]) if own else c
        models[provider] = (number, CentroidGraph(np.ascontiguousarray(x)))
    return models


def nearest(
    vectors: DataFrame,
    *,
    k: int = 5,
    min_cosine: float = -1.0,
    lists: int | None = None,
    ratio: float | None = None,
    target: int = 256,
    block: int = 32_768,
) -> DataFrame:
    """``provider content_hash neighbour cosine rank``: the ``k`` most similar of every vector.

    Needs ``provider content_hash vec``; further columns are ignored. Usable are vectors of the
    provider's full (most frequent) length, finite and not all zero; others, and null hashes,
    have no neighbours and are none. Vectors are compared within a provider (a null provider is
    one). Of several usable vectors under one key the one with the least digest counts; ties go
    to the smaller hash; an empty table gives no rows. ``min_cosine`` leaves out weaker ones.
    ``lists`` and ``ratio`` bound the lists of a vector by number and by distance; by default they
    follow from ``min_cosine`` if that is 0.5 or more, else they are 16 and 1.5.
    """
    if min_cosine < 0.5:
        lists, ratio = lists or 16, ratio or 1.5
    spark = vectors.sparkSession
    dims = dimensions(vectors)
    src = vectors.filter(F.col("content_hash").isNotNull()).select("provider", "content_hash", F.col("vec").cast("array<float>").alias("vec"))
    clean = src.mapInArrow(partial(_clean, dims=dims), "provider string, content_hash string, digest binary, v binary")
    keyed = clean.groupBy("provider", "content_hash").agg(F.min(F.struct("digest", "v")).alias("m")).select("provider", "content_hash", "m.*")
    keyed = stage(keyed, "vectors")
    classes = keyed.groupBy("digest").agg(F.min("content_hash").alias("first"), F.count("*").alias("copies"))
    # an entry is named by provider and first key: hashes of two providers may be equal
    name = F.concat_ws("\x00", F.coalesce("provider", F.lit("\x01")), "first").alias("rep")
    members = keyed.select("provider", "digest", "content_hash").join(classes, "digest")
    members = stage(members.select("provider", name, "content_hash", "copies"), "members")
    reps = keyed.join(classes, "digest").filter("content_hash = first").select("provider", name, "v")
    models = fit_centroids(reps, dims, target)
    if not models:
        return spark.createDataFrame([], "provider string, content_hash string, neighbour string, cosine double, rank int")
    shared = spark.sparkContext.broadcast(models)
    rows = stage(reps.mapInArrow(partial(_assign, models=shared, lists=lists, ratio=ratio, floor=min_cosine), "rep string, v binary, lists array<bigint>"), "lists")
    n, copies = rows.agg(F.count("*"), F.sum(F.size("lists"))).first()
    # lists are shuffled in rounds, so the copies of all vectors are never on disk together
    rounds = -(-copies // max(ROUND, 2 * n))
    size = stage(rows.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("size")), "sizes")
    crowded = size.filter(F.col("size") > block).limit(1).count()
    found = []
    for i in range(rounds):
        here = F.filter("lists", lambda x: F.pmod(F.xxhash64(x), F.lit(rounds)) == i)
        work = rows.select("rep", "v", F.explode(here if rounds > 1 else F.col("lists")).alias("list"))
        # the sizes are joined only where a list must be cut: behind a join on ``list`` Spark takes the
        # repartition below for redundant, and may read the join's shuffle in another order
        if crowded:
            half = block // 2
            work = work.join(size, "list").withColumn("parts", F.when(F.col("size") > block, (F.col("size") / half).cast("int") + 1).otherwise(1))
            work = work.withColumn("own", F.pmod(F.xxhash64("rep"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            work = work.withColumn("list", F.xxhash64("list", F.least("own", "other"), F.greatest("own", "other")))
        work = work.select("list", "rep", "v").repartition("list").sortWithinPartitions("list", "rep")
        pairs = work.mapInArrow(partial(_search_lists, k=k, floor=min_cosine), "a string, b string, cosine double")
        pairs = pairs.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
        if rounds > 1:
            pairs = stage(pairs, "round")
            gc.collect()  # Spark deletes a round's shuffle when nothing refers to it
            spark._jvm.System.gc()
        found.append(pairs)
    pairs = found[0] if rounds == 1 else reduce(DataFrame.unionAll, found).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    pairs = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "cosine").select("p.*", "cosine")
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    pairs = stage(pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank"), "pairs")
    # back from entries to keys: of an entry, its first k + 1 keys can be among anyone's best
    few = members.withColumn("rn", F.row_number().over(Window.partitionBy("rep").orderBy("content_hash"))).filter(F.col("rn") <= k + 1)
    few = few.select("rep", F.col("content_hash").alias("neighbour"))
    others = members.join(pairs.withColumnRenamed("a", "rep"), "rep").select("provider", "content_hash", F.col("b").alias("rep"), "cosine")
    others = others.join(few, "rep").select("provider", "content_hash", "neighbour", "cosine")
    copies = members.filter("copies > 1").join(few, "rep").filter("content_hash <> neighbour").select("provider", "content_hash", "neighbour", F.lit(1.0).alias("cosine"))
    w = Window.partitionBy("provider", "content_hash").orderBy(F.desc("cosine"), "neighbour")
    return others.unionAll(copies).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

