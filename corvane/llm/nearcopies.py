"""Problem 3: groups of code chunks that differ by small edits.

Chosen-path set similarity join: each record is the set of its pairs of neighbouring words. In
every tree a record follows the minwise token of its set, so records alike meet with a
probability of at least their similarity; nodes of up to ``leaf`` records are compared
exhaustively (a one-bit minwise sketch first, then the sets themselves), larger ones branch
again on several minwise tokens that the path hasn't used, each node by hashes of its own.
Independent trees are repeated until a pair at the threshold is met with the target recall,
branching included.

Records with equal sets are one record from the start, so a group of copies costs one row. The
first level runs as a count over (tree, token) rows without any text; only records that share
a node travel with their sets. Nodes too large for a task branch again as Spark rows, and what
can't be branched is compared in blocks of block pairs. A task emits a forest of links, never
all pairs of a group.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.components import connected_components
from corvane.session import stage

RECORDS = "ord bigint, seen bigint, set_id binary, n int, tokens binary, sketch binary, sel array<bigint>"
_WORD = re.compile(r"\w+")
_BITS = 128
_U32 = np.uint32


def _odd(seed: int) -> tuple[int, int, int]:
    """Multiplier, addend and inverse multiplier of the ``seed``-th hash on 32-bit tokens."""
    h = xxhash.xxh3_128_intdigest(seed.to_bytes(8, "little", signed=False))
    mul = (h & 0xFFFFFFFF) | 1
    return mul, (h >> 32) & 0xFFFFFFFF, pow(mul, -1, 1 << 32)


_SKETCH = np.array([_odd(10_000 + i)[:2] for i in range(_BITS)], dtype=np.uint32)


def _seed(*path: int) -> int:
    """Seed of the hashes that branch the node at ``path``, so that no two nodes branch alike."""
    return xxhash.xxh3_64_intdigest(",".join(map(str, path)))


def trees_for(threshold: float, recall: float, fan: int = 0, levels: int = 0) -> int:
    """Trees after which a pair at the threshold has met with probability ``recall``.

    With ``levels`` of branching by ``fan`` hashes below a tree's first token, a pair must also
    stay together in a child of every level.
    """
    stays = 1.0
    for _ in range(levels):
        stays = 1 - (1 - threshold * stays) ** fan
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold * stays))


class _Words(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


def token_set(text: str, min_words: int, cache: dict) -> np.ndarray | None:
    """Sorted distinct 32-bit tokens of the pairs of neighbouring words, or None if too short."""
    words = _WORD.findall(text.lower())
    if len(words) < max(2, min_words):
        return None
    w = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    with np.errstate(over="ignore"):
        x = w[:-1] * np.uint64(0x9E3779B97F4A7C15) + (w[1:] ^ (w[1:] >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((x >> np.uint64(32)).astype(_U32))


def sketch(tokens: np.ndarray) -> bytes:
    """One bit of each of ``_BITS`` minwise hashes."""
    h = tokens[None, :] * _SKETCH[:, :1] + _SKETCH[:, 1:]
    return np.packbits((h.min(axis=1) >> _U32(13)) & _U32(1)).tobytes()


def _records(batches: Iterator[pa.RecordBatch], min_words: int, trees: int) -> Iterator[pa.RecordBatch]:
    cache = _Words()
    hashes = [_odd(i) for i in range(trees)]
    mul = np.array([[h[0]] for h in hashes], dtype=_U32)
    add = np.array([[h[1]] for h in hashes], dtype=_U32)
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    names = ["ord", "seen", "set_id", "n", "tokens", "sketch", "sel"]
    for b in batches:
        rows = []
        for o, seen, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            t = token_set(text or "", min_words, cache)
            if t is None:
                continue
            raw = t.tobytes()
            # the minwise token of each tree, as tree number and hash value
            low = (t[None, :] * mul + add).min(axis=1).astype(np.int64)
            rows.append((o, seen, xxhash.xxh3_128_digest(raw), len(t), raw, sketch(t), (low + (np.arange(trees) << 32)).tolist()))
        cols = zip(*rows) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _branch(batches: Iterator[pa.RecordBatch], fan: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, rep, tokens, tag, size) -> (child, rep, tag, node, size), ``fan`` children each."""
    known: dict[int, list[tuple[int, int, int]]] = {}
    for b in batches:
        out = []
        for node, rep, raw, tag, size in zip(*(b.column(i).to_pylist() for i in range(5))):
            t = np.frombuffer(raw, dtype=_U32)
            if node not in known:
                known[node] = [_odd(_seed(node, k)) for k in range(fan)]
            for k, (m, a, _) in enumerate(known[node]):
                low = int((t * _U32(m) + _U32(a)).min())
                out.append((xxhash.xxh3_64_intdigest(b"%d,%d,%d" % (node, k, low)) >> 1, rep, tag, node, size))
        cols = zip(*out) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["node", "rep", "tag", "parent", "parent_size"])


class _Linker:
    """Compares nodes and keeps the forest of links found by one task."""

    def __init__(self, threshold: float, leaf: int, fan: int, depth: int):
        self.threshold, self.leaf, self.fan, self.depth = threshold, leaf, fan, depth
        # a pair at the threshold disagrees in (1 - J) / 2 of the bits; four deviations are kept
        p = (1 - threshold) / 2
        self.far = int(_BITS * p + 4 * math.sqrt(_BITS * p * (1 - p))) + 1
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []
        self.sets: dict[int, frozenset] = {}

    def root(self, x: int) -> int:
        p = self.parent
        while (y := p.get(x, x)) != x:
            p[x] = z = p.get(y, y)
            x = z
        return x

    def _set(self, i: int) -> frozenset:
        s = self.sets.get(i)
        if s is None:
            s = self.sets[i] = frozenset(self.tokens[self.offset[i] : self.offset[i + 1]].tolist())
        return s

    def alike(self, i: int, j: int) -> bool:
        a, b = self._set(i), self._set(j)
        small, big = (len(a), len(b)) if len(a) < len(b) else (len(b), len(a))
        if small < self.threshold * big - 1e-9:
            return False
        n = len(a & b)
        return n >= self.threshold * (len(a) + len(b) - n) - 1e-9

    def link(self, i: int, j: int) -> None:
        a, b = self.root(int(self.reps[i])), self.root(int(self.reps[j]))
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((int(self.reps[i]), int(self.reps[j])))

    def node(self, key: int, reps: list[int], raw: list[bytes], sketches: list[bytes]) -> None:
        self.reps = reps
        self.sets = {}
        self.tokens = np.frombuffer(b"".join(raw), dtype=_U32)
        self.offset = np.concatenate(([0], np.cumsum([len(r) // 4 for r in raw])))
        if len(reps) == 2:
            if self.root(reps[0]) != self.root(reps[1]) and self.alike(0, 1):
                self.link(0, 1)
            return
        self.sketches = np.frombuffer(b"".join(sketches), dtype=np.uint64).reshape(len(reps), -1)
        self.solve(np.arange(len(reps)), 0, _seed(key), ())

    def solve(self, idx: np.ndarray, depth: int, seed: int, path: tuple[int, ...]) -> None:
        if len(idx) <= self.leaf or depth >= self.depth:
            self.compare(idx)
            return
        size = self.offset[idx + 1] - self.offset[idx]
        start = np.cumsum(size) - size
        where = np.repeat(self.offset[idx] - start, size) + np.arange(size.sum())
        tokens = self.tokens[where]
        used = np.isin(tokens, np.array(path, dtype=_U32)) if path else None
        for k in range(self.fan):
            m, a, inverse = _odd(_seed(seed, k))
            h = tokens * _U32(m) + _U32(a)
            if used is not None:
                h[used] = _U32(0xFFFFFFFF)
            low = np.minimum.reduceat(h, start)
            order = np.argsort(low, kind="stable")
            values = low[order]
            edges = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True])))
            for s, e in zip(edges[:-1], edges[1:]):
                if e - s < 2 or values[s] == 0xFFFFFFFF:
                    continue
                if e - s > len(idx) // 2:
                    self.compare(idx[order[s:e]])  # alike for the most part: branching wouldn't part them
                    continue
                token = (int(values[s]) - a) * inverse & 0xFFFFFFFF
                self.solve(idx[order[s:e]], depth + 1, _seed(seed, k, token), (*path, token))

    def compare(self, idx: np.ndarray) -> None:
        m = len(idx)
        own = self.sketches[idx]
        if m <= max(self.leaf, 256):
            d = np.bitwise_count(own[:, None, :] ^ own[None, :, :]).sum(axis=2, dtype=np.int32)
            near = np.argwhere(np.triu(d <= self.far, 1))
            for i, j in near.tolist():
                i, j = int(idx[i]), int(idx[j])
                if self.root(self.reps[i]) != self.root(self.reps[j]) and self.alike(i, j):
                    self.link(i, j)
            return
        # a large node: each record against those of other groups only
        label = np.array([self.root(self.reps[i]) for i in idx.tolist()])
        for x in range(m - 1):
            if x % 64 == 0 and (label[x:] == label[x]).all():
                break  # the rest is one group already
            d = np.bitwise_count(own[x + 1 :] ^ own[x]).sum(axis=1, dtype=np.int32)
            near = x + 1 + np.flatnonzero((d <= self.far) & (label[x + 1 :] != label[x]))
            for y in near.tolist():
                if label[y] != label[x] and self.alike(int(idx[x]), int(idx[y])):
                    self.link(int(idx[x]), int(idx[y]))
                    label[label == label[y]] = label[x]


def _compare_nodes(batches: Iterator[pa.RecordBatch], threshold: float, leaf: int, fan: int, depth: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, rep, tokens, sketch), sorted by node -> links (a, b)."""
    linker = _Linker(threshold, leaf, fan, depth)
    now, group = None, {}

    def done() -> None:
        if len(group) > 1:
            linker.node(now, list(group), [g[0] for g in group.values()], [g[1] for g in group.values()])

    for b in batches:
        for node, rep, tokens, sk in zip(*(b.column(i).to_pylist() for i in range(4))):
            if node != now:
                done()
                now, group = node, {}
            group[rep] = (tokens, sk)
        if linker.links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*linker.links)], names=["a", "b"])
            linker.links = []
    done()
    if linker.links:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*linker.links)], names=["a", "b"])


def links(
    records: DataFrame,
    reps: DataFrame,
    *,
    threshold: float,
    leaf: int,
    fan: int,
    depth: int,
    node_limit: int,
    spark_levels: int,
) -> DataFrame:
    """Verified links (a, b) between the representative records."""
    payload = records.select(F.col("ord").alias("rep"), F.xxhash64("set_id").alias("tag"), "tokens", "sketch")
    rows = reps.select("rep", "tag", F.explode("sel").alias("node"), F.lit(0).cast("bigint").alias("parent"), F.lit(None).cast("bigint").alias("parent_size"))
    ready = before = None

    def blocks(large: DataFrame) -> DataFrame:
        """Blocks of large nodes, each pair of blocks as a node of its own."""
        half = max(1, node_limit // 2)
        parts = (F.col("size") / half).cast("int") + 1
        own = F.pmod(F.xxhash64("rep"), parts).cast("int")
        pairs = large.withColumn("parts", parts).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        key = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
        return pairs.select(key.alias("node"), "rep", "tag")

    for level in range(spark_levels + 1):
        size = rows.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        kept = stage(rows.join(size, "node"), "nodes")
        fits = kept.filter(F.col("size") <= node_limit).select("node", "rep", "tag")
        ready = fits if ready is None else ready.unionAll(fits)
        large = kept.filter(F.col("size") > node_limit)
        if large.limit(1).count() == 0:
            break
        if level == spark_levels:
            ready = ready.unionAll(blocks(large))
            break
        if before is not None:
            # a node whose child keeps most of it can't be branched apart: its records are alike
            stuck = large.filter(F.col("size") > F.col("parent_size") / 2).select("parent").distinct()
            ready = ready.unionAll(blocks(before.join(stuck.withColumnRenamed("parent", "node"), "node", "left_semi")))
            large = large.join(stuck, "parent", "left_anti")
        before = large
        moving = large.select("node", "rep", "tag", "size").join(payload.select("rep", "tag", "tokens"), ["rep", "tag"])
        rows = moving.select("node", "rep", "tokens", "tag", "size").mapInArrow(
            partial(_branch, fan=fan), "node bigint, rep bigint, tag bigint, parent bigint, parent_size bigint"
        )
    # the tag names the version of a record: of several under one ord only the chosen one joins
    work = ready.join(payload, ["rep", "tag"]).select("node", "rep", "tokens", "sketch").repartition("node").sortWithinPartitions("node", "rep")
    return work.mapInArrow(partial(_compare_nodes, threshold=threshold, leaf=leaf, fan=fan, depth=depth), "a bigint, b bigint")


def near_copy_groups(
    chunks: DataFrame,
    *,
    threshold: float = 0.6,
    min_words: int = 40,
    recall: float = 0.999,
    leaf: int = 96,
    fan: int = 3,
    depth: int = 8,
    node_limit: int = 50_000,
    spark_levels: int = 3,
) -> DataFrame:
    """``ord group_ord copies`` of every member of a group of two or more.

    Needs ``ord source text`` (and takes the latest row of an ``ord`` where ``indexed_at`` is
    there); further columns are ignored. Alike are texts whose sets of neighbouring word pairs
    have a Jaccard similarity of at least ``threshold``; a group is a chain of alike texts, named
    by its smallest ``ord``; ``copies`` counts the members with the very same set. Null and short
    texts and rows with a null ``ord`` are in no group; repeated rows count once; an empty table
    gives no rows.
    """
    seen = F.col("indexed_at").cast("timestamp") if "indexed_at" in chunks.columns else F.lit(None).cast("timestamp")
    src = chunks.filter((F.col("source") == "code") & F.col("ord").isNotNull() & F.col("text").isNotNull()).select(
        F.col("ord").cast("bigint").alias("ord"), F.coalesce(F.unix_micros(seen), F.lit(0)).alias("seen"), "text"
    )
    trees = trees_for(threshold, recall, fan, spark_levels + depth)
    records = stage(src.mapInArrow(partial(_records, min_words=min_words, trees=trees), RECORDS), "sets")
    members = records.groupBy("ord").agg(F.max(F.struct("seen", "set_id")).alias("m")).select("ord", "m.set_id")
    classes = members.groupBy("set_id").agg(F.min("ord").alias("rep"), F.count("*").alias("copies"))
    chosen = records.select("ord", "set_id", "sel").join(classes.select("set_id", F.col("rep").alias("ord")), ["set_id", "ord"])
    reps = chosen.select(F.col("ord").alias("rep"), F.xxhash64("set_id").alias("tag"), "sel").dropDuplicates(["rep"])
    found = links(
        records, reps, threshold=threshold, leaf=leaf, fan=fan, depth=depth, node_limit=node_limit, spark_levels=spark_levels
    )
    roots = connected_components(found)
    grouped = classes.join(roots, classes["rep"] == roots["node"], "left").filter("copies > 1 or root is not null")
    grouped = grouped.select("set_id", F.coalesce("root", "rep").alias("group_ord"), "copies")
    return members.join(grouped, "set_id").select("ord", "group_ord", "copies")
