"""Ranking of a batch of queries against the chunks of their scope, in blocks.

Queries and chunks of a scope meet in one task, the queries first: what is shuffled is every chunk
once for each block of its scope's queries, never a pair of a query and a chunk. A task reads the
chunks as a stream, scores a batch against all queries of the block by matrix products, and keeps
the best of every query; a block's rankings are fused and weighed where they were made. Queries
of the same terms are ranked once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b, md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, RRF_K = 512, 60
#: queries of a block, queries scored at once, terms of so large a share of pairs are multiplied as a matrix
BLOCK, AT_ONCE, DENSE_SHARE = 4096, 512, 0.02
COUNTED = "terms array<string>, tfs array<int>, buckets array<int>, counts array<int>"
_BUCKET: dict[str, Callable[[bytes], int]] = {
    "md5": lambda x: int.from_bytes(md5(x).digest()[:4], "big") % BUCKETS,
    "hash": lambda x: int.from_bytes(blake2b(x, digest_size=8).digest(), "big") % BUCKETS,
}


def _count(row: np.ndarray, code: np.ndarray, rows: int, codes: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets by row, codes, sums), the codes of a row once each in their order."""
    key, at = np.unique(row * max(codes, 1) + code, return_inverse=True)
    n = np.bincount(at, weight, len(key)).astype(np.int32)
    return np.searchsorted(key, np.arange(rows + 1) * max(codes, 1)).astype(np.int32), key % max(codes, 1), n


def counted(tokens: DataFrame, provider: str = "md5") -> DataFrame:
    """Columns ``also`` and ``tokens`` (arrays of terms) replaced by counts.

    ``terms tfs`` are the terms of both arrays, ``buckets counts`` the hashed ones of ``tokens``, each once a row.
    """
    rest = [c for c in tokens.columns if c not in ("also", "tokens")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema if f.name in rest)
    of = _BUCKET[provider if provider in _BUCKET else "md5"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            n = b.num_rows
            flat, rows = [], []
            for name in ("tokens", "also"):
                column = b.column(b.schema.get_field_index(name))
                flat.append(column.flatten().cast(pa.string()))
                rows.append(np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)))
            words = pa.chunked_array(flat).combine_chunks().dictionary_encode()
            code, names = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
            at, c, tf = _count(np.concatenate(rows), code, n, len(names))
            terms = pa.ListArray.from_arrays(pa.array(at, pa.int32()), names.take(pa.array(c)))
            for x in names.to_pylist():
                if x not in known:
                    known[x] = of(x.encode())
            bucket = np.array([known[x] for x in names.to_pylist()], dtype=np.int64)
            own = code[: len(rows[0])]
            bat, bc, bn = _count(rows[0], bucket[own] if len(own) else own, n, BUCKETS)
            if len(known) > 1_000_000:
                known.clear()
            lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v, pa.int32())) for o, v in ((at, tf), (bat, bc), (bat, bn))]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), terms, *lists], names=[*rest, "terms", "tfs", "buckets", "counts"])

    return tokens.select(*rest, "also", "tokens").mapInArrow(run, f"{kinds}, {COUNTED}")


@dataclass(frozen=True)
class Fusion:
    """How rankings become one: weights by method, size of the pool, whether chunk weights count."""

    pool: int
    weights: dict[str, float] = field(default_factory=dict)
    weigh: bool = True


def ranked(
    queries: DataFrame, chunks: DataFrame, k: int, methods: tuple[str, ...], constants: tuple[float, float] = (1.5, 0.75),
    fusion: Fusion | None = None, carry: tuple[str, ...] = (), block: int = BLOCK,
) -> DataFrame:
    """``query_id ord score rank``: the best ``k`` of one method; with ``fusion`` also ``sources``, all methods as one ranking.

    ``queries``: ``query_id scope key``, for BM25 ``terms weights avgdl``, for vectors ``buckets counts``; those of one
    ``key`` in a scope are alike. ``chunks``: ``scope ord dl weight terms tfs buckets counts`` and what is to ``carry``
    along with a rank. Scores are rounded to nine places, only positive ones count, ties go to the smaller ``ord``.
    """
    queries, chunks = queries.filter("scope is not null"), chunks.filter("scope is not null")
    kind = queries.schema["query_id"].dataType.simpleString()
    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema}
    # bounded by the batch: a scope of more than one block has at least as many queries
    sizes = queries.groupBy("scope").agg(F.count_distinct("key").alias("n")).filter(F.col("n") > block).collect()
    n = F.lit(1)
    for s, size in sizes:
        n = F.when(F.col("scope") == s, 1 + size // block).otherwise(n)
    no = lambda t: F.lit(None).cast(t)
    q = queries.select(
        "scope", F.pmod(F.xxhash64("key"), n).cast("int").alias("block"), F.lit(0).alias("side"), "query_id", "key", no("bigint").alias("ord"), no("int").alias("dl"),
        (F.col("avgdl") if "avgdl" in queries.columns else no("double")).alias("weight"),
        *((F.col(c) if c in queries.columns else no(t)).alias(c) for c, t in (("terms", "array<string>"), ("weights", "array<double>"), ("tfs", "array<int>"), ("buckets", "array<int>"), ("counts", "array<int>"))),
        *(no(kinds[c]).alias(c) for c in carry),
    )
    used = {"terms": "bm25", "tfs": "bm25", "buckets": "vector", "counts": "vector"}
    c = chunks.select(
        "scope", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"), F.lit(1).alias("side"), no(kind).alias("query_id"), no("string").alias("key"), F.col("ord").cast("bigint").alias("ord"), F.col("dl").cast("int").alias("dl"),
        "weight", *((no("array<double>") if x == "weights" else F.col(x) if used[x] in methods else no("array<string>" if x == "terms" else "array<int>")).alias(x) for x in ("terms", "weights", "tfs", "buckets", "counts")),
        *carry,
    )
    both = q.unionByName(c).repartition("scope", "block").sortWithinPartitions("scope", "block", "side")
    more = ["sources array<string>"] * bool(fusion) + [f"`{x}` {kinds[x]}" for x in carry]
    return both.mapInArrow(_in_task(k, methods, constants, fusion, carry), ", ".join([f"query_id {kind}, scope string, ord bigint, score double, rank int", *more]))


def _in_task(k: int, methods: tuple[str, ...], constants: tuple[float, float], fusion: Fusion | None, carry: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, None
        for b in batches:
            if not b.num_rows:
                continue
            scope = b.column(0).dictionary_encode()
            where = np.stack([scope.indices.to_numpy(zero_copy_only=False), b.column(1).to_numpy(), b.column(2).to_numpy()])
            cuts = [0, *(1 + np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0))).tolist(), b.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                key = (scope.dictionary[int(where[0, start])].as_py(), int(where[1, start]))
                if key != now:
                    if group:
                        yield from group.results()
                    now, group = key, _Group(key[0], k, methods, constants, fusion, carry, b.schema)
                part = b.slice(start, stop - start)
                if where[2, start] == 0:
                    group.ask(part)
                else:
                    group.score(part)
        if group:
            yield from group.results()

    return run


class _Group:
    """The queries of a block, and the best chunks so far of each."""

    def __init__(self, scope, k, methods, constants, fusion, carry, schema):
        self.scope, self.k, self.methods, self.fusion, self.carry = scope, k, methods, fusion, carry
        self.k1, self.b = constants
        self.at = {f.name: i for i, f in enumerate(schema)}
        self.schema = schema
        self.ids: dict[str, list] = {}
        self.asked: list[dict] = []
        self.avgdl = None
        self.ready = False
        self.ords: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []
        self.carried: list[pa.Table] = []
        self.rows = 0

    def ask(self, part: pa.RecordBatch) -> None:
        for r in part.select(["query_id", "key", "weight", "terms", "weights", "buckets", "counts"]).to_pylist():
            if r["key"] not in self.ids:
                self.ids[r["key"]] = []
                self.asked.append(r)
            self.ids[r["key"]].append(r["query_id"])
            if r["weight"] is not None:
                self.avgdl = r["weight"]

    def _prepare(self) -> None:
        n = len(self.asked)
        self.least = {m: np.full(n, 5e-10) for m in self.methods}
        self.parts: dict[str, list] = {m: [] for m in self.methods}
        self.held = dict.fromkeys(self.methods, 0)
        if "bm25" in self.methods:
            vocabulary: dict[str, int] = {}
            triples = [(vocabulary.setdefault(t, len(vocabulary)), i, w) for i, r in enumerate(self.asked) for t, w in zip(r["terms"] or (), r["weights"] or ())]
            self.vocabulary = pa.array(list(vocabulary), pa.string())
            t, i, w = (np.array(x) for x in zip(*triples)) if triples else (np.empty(0, int), np.empty(0, int), np.empty(0))
            order = np.lexsort((i, t))
            self.q_at, self.q_i, self.q_w = np.searchsorted(t[order], np.arange(len(vocabulary) + 1)), i[order], w[order]
        if "vector" in self.methods:
            self.matrix = np.zeros((n, BUCKETS))
            for i, r in enumerate(self.asked):
                if r["buckets"]:
                    x = np.array(r["counts"], dtype=np.float64)
                    self.matrix[i, r["buckets"]] = x / np.sqrt((x * x).sum())
        self.ready = True

    def score(self, part: pa.RecordBatch) -> None:
        if not self.asked:
            return
        if not self.ready:
            self._prepare()
        column = lambda name: part.column(self.at[name])
        self.ords.append(column("ord").to_numpy())
        self.weights.append(column("weight").to_numpy(zero_copy_only=False))
        if self.carry:
            self.carried.append(pa.Table.from_batches([part.select(list(self.carry))]))
        for m in self.methods:
            of = self._bm25(column, part.num_rows) if m == "bm25" else self._cosine(column, part.num_rows)
            for a in range(0, len(self.asked), AT_ONCE):
                s = of(a, min(a + AT_ONCE, len(self.asked)))
                if s is not None:
                    self._keep(m, a, s)
        self.rows += part.num_rows

    def _bm25(self, column, n: int):
        lists = column("terms")
        flat = pc.index_in(lists.flatten().cast(pa.string()), value_set=self.vocabulary)
        t = pc.fill_null(flat, -1).to_numpy(zero_copy_only=False)
        d = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        tf = column("tfs").flatten().to_numpy(zero_copy_only=False)
        there = t >= 0
        t, d, tf = t[there], d[there], tf[there].astype(np.float64)
        dl = column("dl").to_numpy(zero_copy_only=False).astype(np.float64)
        x = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl[d] / self.avgdl)) if len(t) else np.empty(0)
        order = np.argsort(t, kind="stable")
        d, x = d[order], x[order]
        at = np.searchsorted(t[order], np.arange(len(self.vocabulary) + 1))
        df, qf = np.diff(at), np.diff(self.q_at)
        present = np.flatnonzero(df)
        heavy = df[present] * qf[present] > DENSE_SHARE * n * len(self.asked)
        dense, sparse = present[heavy], present[~heavy]
        m = np.zeros((len(dense), n))
        for j, term in enumerate(dense.tolist()):
            m[j, d[at[term] : at[term + 1]]] = x[at[term] : at[term + 1]]

        def of(a: int, b: int) -> np.ndarray | None:
            if not len(present):
                return None
            q = np.zeros((b - a, len(dense)))
            for j, term in enumerate(dense.tolist()):
                i, w = self._asked_of(term, a, b)
                q[i, j] = w
            s = q @ m
            for term in sparse.tolist():
                i, w = self._asked_of(term, a, b)
                if len(i):
                    s[i[:, None], d[at[term] : at[term + 1]]] += np.outer(w, x[at[term] : at[term + 1]])
            return s

        return of

    def _asked_of(self, term: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        i = self.q_i[self.q_at[term] : self.q_at[term + 1]]
        f, t = np.searchsorted(i, (a, b))
        return i[f:t] - a, self.q_w[self.q_at[term] : self.q_at[term + 1]][f:t]

    def _cosine(self, column, n: int):
        buckets, counts = column("buckets"), column("counts")
        d = np.repeat(np.arange(n), pc.list_value_length(buckets).to_numpy(zero_copy_only=False))
        c = counts.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        norm = np.sqrt(np.bincount(d, c * c, n))
        m = np.zeros((n, BUCKETS))
        m[d, buckets.flatten().to_numpy(zero_copy_only=False)] = c / norm[d]
        return lambda a, b: self.matrix[a:b] @ m.T

    def _keep(self, method: str, a: int, s: np.ndarray) -> None:
        """What may still be among the best; a margin keeps what rounding makes equal to the border."""
        least = self.least[method][a : a + len(s)]
        new = np.flatnonzero(least == 5e-10)
        if s.shape[1] > self.k and len(new):
            least[new] = np.maximum(least[new], np.partition(s[new] if len(new) < len(s) else s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k])
        # the smallest score that isn't rounded to nothing stays the border where there is no other
        r, c = np.nonzero(s >= np.where(least == 5e-10, least, np.maximum(least - 1.1e-9, 5e-10))[:, None])
        if not len(r):
            return
        x = np.round(s[r, c], 9)
        self.parts[method].append((r + a, c + self.rows, x))
        self.held[method] += len(r)
        if self.held[method] > max(3 * self.k * len(self.asked), 500_000):
            i, row, x = self._best(method)
            last = np.append(i[1:] != i[:-1], True)
            full = np.bincount(i, minlength=len(self.asked))[i[last]] == self.k
            self.least[method][i[last][full]] = np.maximum(self.least[method][i[last][full]], x[last][full])
            self.parts[method] = [(i, row, x)]
            self.held[method] = len(i)

    def _best(self, method: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the best ``k``, by query and rank."""
        i, row, x = (np.concatenate(p) for p in zip(*self.parts[method]))
        i, row, x = i[x > 0], row[x > 0], x[x > 0]
        ords = np.concatenate(self.ords)
        order = np.lexsort((ords[row], -x, i))
        i, row, x = i[order], row[order], x[order]
        keep = _place(i) < self.k
        return i[keep], row[keep], x[keep]

    def results(self) -> Iterator[pa.RecordBatch]:
        if not self.ready:
            return
        best = [(p, m, self._best(m)) for p, m in enumerate(self.methods) if self.parts[m]]
        if not best:
            return
        if self.fusion:
            i, row, x, rank, used = self._fused(best)
        else:
            i, row, x = best[0][2]
            rank, used = _place(i) + 1, None
        ords, carried = np.concatenate(self.ords), pa.concat_tables(self.carried) if self.carry else None
        names = [self.ids[r["key"]] for r in self.asked]
        at = np.searchsorted(i, np.arange(len(names) + 1))
        each = np.diff(at)
        source = pa.array([[m for p, m in enumerate(self.methods) if code >> p & 1] for code in range(2 ** len(self.methods))], pa.list_(pa.string()))
        # queries of the same terms have the same results
        pairs = [(x, j) for j, own in enumerate(names) if each[j] for x in own]
        step = max(1, 200_000 // max(1, int(each.max())))
        kind = self.schema.field("query_id").type
        for f in range(0, len(pairs), step):
            some = pairs[f : f + step]
            j = np.array([p[1] for p in some])
            take = np.repeat(at[j] - np.concatenate(([0], np.cumsum(each[j])[:-1])), each[j]) + np.arange(each[j].sum())
            who = pa.array([p[0] for p in some], kind).take(pa.array(np.repeat(np.arange(len(some)), each[j])))
            columns = [who, pa.array([self.scope], pa.string()).take(pa.array(np.zeros(len(take), dtype=np.int64))), pa.array(ords[row[take]], pa.int64()), pa.array(x[take], pa.float64()), pa.array(rank[take], pa.int32())]
            names_out = ["query_id", "scope", "ord", "score", "rank"]
            if used is not None:
                columns.append(source.take(pa.array(used[take])))
                names_out.append("sources")
            if self.carry:
                rows = carried.take(pa.array(row[take])).combine_chunks()
                columns += [rows.column(c).combine_chunks() if rows.num_rows else pa.array([], self.schema.field(c).type) for c in self.carry]
                names_out += self.carry
            yield pa.RecordBatch.from_arrays(columns, names=names_out)

    def _fused(self, best: list[tuple]) -> tuple[np.ndarray, ...]:
        """Reciprocal-rank fusion and weighting, as ``corvane.operators.fusion`` has them."""
        how = self.fusion
        i = np.concatenate([b[0] for _, _, b in best])
        row = np.concatenate([b[1] for _, _, b in best])
        rank = np.concatenate([_place(b[0]) + 1 for _, _, b in best])
        pos = np.concatenate([np.full(len(b[0]), p) for p, _, b in best])
        x = np.concatenate([float(how.weights.get(m, 1.0)) / (RRF_K + _place(b[0]) + 1) for _, m, b in best])
        order = np.lexsort((pos, row, i))
        i, row, rank, pos, x = i[order], row[order], rank[order], pos[order], x[order]
        new = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (row[1:] != row[:-1]))))
        used, x = np.add.reduceat(1 << pos, new), np.add.reduceat(x, new)
        i, row, rank, pos = i[new], row[new], rank[new], pos[new]
        order = np.lexsort((rank, pos, -np.round(x, 12), i))
        order = order[_place(i[order]) < how.pool]
        i, row, x, used = i[order], row[order], x[order], used[order]
        if how.weigh:
            x = x * np.concatenate(self.weights)[row]
            order = np.lexsort((_place(i), -np.round(x, 12), i))
            i, row, x, used = i[order], row[order], x[order], used[order]
        return i, row, x, _place(i) + 1, used


def _place(i: np.ndarray) -> np.ndarray:
    """Place of every row within its run of equal numbers."""
    new = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.empty(0, int)
    return np.arange(len(i)) - np.repeat(new, np.diff(np.append(new, len(i))))
