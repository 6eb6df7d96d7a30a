"""Problem 8: passages of held-out test material inside a corpus.

Q-gram lemma filtering: two texts that share a region of ``L`` characters with at most ``e``
edits share at least ``L + 1 - q * (1 + e)`` q-grams in diagonals that differ by at most
``e``. Documents and passages are folded to words with one blank between them, so a run of
``min_words`` equal words is an equal character region whatever stands between the words.
Every q-gram of every document is looked up among the q-grams of the passages; hits are
counted in overlapping diagonal bands per (document, passage); bands that reach the bound
are verified by an edit alignment within the band: the longest stretch of the passage that the
region holds with at most ``edits`` characters inserted, deleted or replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.wordfold import BREAK, SPACE, fold

_SLICE = 1_000_000  #: characters folded at a time, bounds a worker's memory
_BITS = 22
_MULT = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = "doc_id bigint, passage_id bigint, run_words int, shared_qgrams int, start_pos int, end_pos int"


def qgram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """64-bit hash of every window of ``q`` entries, by doubling."""
    with np.errstate(over="ignore"):
        power, width, h = _MULT, 1, codes.astype(np.uint64) + np.uint64(1)
        acc, done = None, 0
        bits = q
        while bits:
            if bits & 1:
                if acc is None:
                    acc, done = h, width
                else:
                    n = len(codes) - done - width + 1
                    if n <= 0:
                        return np.empty(0, np.uint64)
                    acc = acc[:n] * power + h[done : done + n]
                    done += width
            bits >>= 1
            if bits:
                n = len(h) - width
                if n <= 0:
                    return np.empty(0, np.uint64)
                h = h[:n] * power + h[width : width + n]
                power = power * power
                width *= 2
        return acc ^ (acc >> np.uint64(29))


class PassageIndex:
    """Q-grams of one block of passages, in arrays that are cheap to send to workers."""

    def __init__(self, rows: list[tuple[int, str]], q: int, min_words: int, edits: int):
        self.min_words, self.edits = min_words, edits
        self.ids = np.array([r[0] for r in rows], dtype=np.int64)
        codes, _, start = fold([r[1] for r in rows])
        hashes, owner, offset = [], [], []
        self.codes = [codes[start[i] : start[i + 1] - 1] for i in range(len(rows))]
        #: characters of the shortest run of ``min_words`` words with the blanks around it, 0 where there is none
        shortest = np.zeros(len(rows), dtype=np.int64)
        for i, own in enumerate(self.codes):
            spaces = np.flatnonzero(own == SPACE)
            if len(spaces) > min_words:
                shortest[i] = int((spaces[min_words:] - spaces[:-min_words]).min()) + 1
        # q-grams short enough that the edits can't break all of a region
        least = int(shortest[shortest > 0].min()) if (shortest > 0).any() else q
        self.q = q = max(1, min(q, least // (1 + edits)))
        self.bound = np.maximum(1, shortest + 1 - q * (1 + edits))
        for i in np.flatnonzero(shortest):
            h = qgram_hashes(self.codes[i], q)
            hashes.append(h)
            owner.append(np.full(len(h), i, dtype=np.int32))
            offset.append(np.arange(len(h), dtype=np.int32))
        self.empty = not hashes
        if self.empty:
            return
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.hashes, self.owner, self.offset = h[order], np.concatenate(owner)[order], np.concatenate(offset)[order]
        self.seen = np.zeros(1 << _BITS, dtype=bool)
        self.seen[h >> np.uint64(64 - _BITS)] = True


def align(region: np.ndarray, passage: np.ndarray, low: int, width: int, edits: int) -> tuple[int, int, int]:
    """Best alignment in the diagonals ``low .. low + width - 1``: (whole words, first, end in ``region``).

    Of the stretches of ``passage`` that ``region`` holds with at most ``edits`` edits, the one
    with most whole words, blanks around it included. Layer ``k`` holds, for every cell of the
    band, the longest stretch that ends there with ``k`` edits: an edit enters it from the layer
    before, equal characters carry it on along the diagonal.
    """
    n = len(region)
    diagonal = low + np.arange(width)[:, None]
    j = np.arange(-1, n)[None, :] - diagonal
    inside = (j >= 0) & (j < len(passage))
    inside[:, 0] = False
    equal = inside.copy()
    own = np.concatenate(([0], region))
    equal[inside] = np.broadcast_to(own, inside.shape)[inside] == passage[j[inside]]
    # a cell's value is length * unit + the diagonal on which the stretch began
    unit = width + 1
    steps = np.arange(n + 1, dtype=np.int64)[None, :] * unit
    span = np.int64(4 * unit * (n + 2))
    segment = np.cumsum(~equal, axis=1) * span

    def carried(x: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(x - steps + segment, axis=1) - segment + steps

    begin = np.broadcast_to(np.arange(width, dtype=np.int64)[:, None], equal.shape)
    best = carried(begin)
    for _ in range(edits):
        x = best.copy()
        before = np.where(inside[:, 1:], best[:, :-1] + unit, begin[:, 1:])
        x[:, 1:] = np.maximum(x[:, 1:], before)  # replaced
        x[1:, 1:] = np.maximum(x[1:, 1:], best[:-1, :-1])  # only in the region
        x[:-1] = np.maximum(x[:-1], np.where(inside[:-1], best[1:] + unit, begin[:-1]))  # only in the passage
        best = carried(np.maximum(x, begin))
    length, start = best // unit, best % unit
    blanks = np.concatenate(([0], np.cumsum(passage == SPACE)))
    end = np.where(inside, j, -1)
    first = np.maximum(end - length + 1, 0)
    whole = np.where(inside, blanks[end + 1] - blanks[first] - 1, -1)
    at = int(np.argmax(whole.T))  # the earliest end of the best
    i, d = divmod(at, width)
    if whole[d, i] <= 0:
        return 0, 0, 0
    p0, p1 = int(first[d, i]), int(end[d, i])
    spaces = p0 + np.flatnonzero(passage[p0 : p1 + 1] == SPACE)
    r0 = i - int(length[d, i]) - (d - int(start[d, i]))
    return int(whole[d, i]), max(0, r0 + int(spaces[0]) - p0), min(n, i - (p1 - int(spaces[-1])))


def _scan_slice(ids: list[int], texts: list[str], index: PassageIndex) -> list[tuple]:
    codes, pos, start = fold(texts)
    q, band = index.q, index.edits + 1
    h = qgram_hashes(codes, q)
    at = np.flatnonzero(index.seen[h >> np.uint64(64 - _BITS)])
    lo = np.searchsorted(index.hashes, h[at], side="left")
    hi = np.searchsorted(index.hashes, h[at], side="right")
    n = hi - lo
    hit = np.flatnonzero(n)
    if not len(hit):
        return []
    at, lo, n = at[hit], lo[hit], n[hit]
    doc_at = np.repeat(at, n)
    k = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    owner, offset = index.owner[k], index.offset[k]
    diagonal = doc_at - offset
    doc = np.searchsorted(start, doc_at, side="right") - 1
    # bands of 2 * band diagonals, one every ``band``: neighbours overlap by half
    found: dict[tuple[int, int], list[int]] = {}
    for shift in (0, 1):
        cell = (diagonal + shift * band) // (2 * band)
        key = np.lexsort((doc_at, cell, owner, doc))
        d, o, c = doc[key], owner[key], cell[key]
        new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (o[1:] != o[:-1]) | (c[1:] != c[:-1]))))
        count = np.diff(np.append(new, len(d)))
        for b in np.flatnonzero(count >= index.bound[o[new]]):
            s, e = new[b], new[b] + count[b]
            where = doc_at[key[s:e]]
            entry = found.setdefault((int(d[s]), int(o[s])), [])
            first = int(where.min())
            entry.append((first, int(where.max()), int(count[b]), (int(c[s]) * 2 - shift) * band))
    out = []
    for (d, o), regions in found.items():
        best = (0, 0, 0, 0)
        passage = index.codes[o]
        # what edits at a region's ends may hide of it from the q-grams
        margin = 2 * band + (q + 1) * index.edits
        for first, last, count, low in regions:
            s, e = max(first - margin, int(start[d])), last + q + margin
            own = codes[s:e]
            stop = np.flatnonzero(own == BREAK)
            own = own[: stop[0]] if len(stop) else own
            run, begin, finish = align(own, passage, low - s - index.edits, 2 * band + 2 * index.edits, index.edits)
            if run > best[0]:
                inner = begin + np.flatnonzero(own[begin:finish] != SPACE)
                best = (run, count, int(pos[s + int(inner[0])]), int(pos[s + int(inner[-1])]) + 1)
        if best[0] >= index.min_words:
            out.append((ids[d], int(index.ids[o]), *best))
    return out


def _scan(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    idx: PassageIndex = index.value
    names = ["doc_id", "passage_id", "run_words", "shared_qgrams", "start_pos", "end_pos"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    for batch in batches:
        rows: list[tuple] = []
        ids, texts, size = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if t and i is not None:
                ids.append(i)
                texts.append(t)
                size += len(t)
            if size >= _SLICE:
                rows += _scan_slice(ids, texts, idx)
                ids, texts, size = [], [], 0
        if ids:
            rows += _scan_slice(ids, texts, idx)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def find_leaks(
    docs: DataFrame,
    passages: DataFrame,
    *,
    min_words: int = 12,
    q: int = 16,
    edits: int = 0,
    block_bytes: int = 8_000_000,
) -> DataFrame:
    """Each (document, passage) that share ``min_words`` consecutive words, once.

    ``edits`` is the number of characters of the folded text that may be inserted, deleted or
    replaced over the whole stretch; with 0 the words are equal. Q-grams shrink with it, so that
    the lemma's bound stays above zero.

    docs: ``doc_id``, ``text``; passages: ``passage_id``, ``text``; further columns are ignored.
    Passages are indexed in blocks of at most about ``block_bytes`` of text (an index takes about
    16 bytes a character), one pass over the documents for each, so no broadcast grows with the
    test set. Rows with a null key or a null
    or blank text hold nothing; a passage of fewer than ``min_words`` words can't leak; repeated
    rows give the pair once, with its longest run; empty tables give no rows. Positions are in
    code points of the text as delivered.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src.filter(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    tests = passages.select(F.col("passage_id").cast("bigint").alias("passage_id"), F.col("text").cast("string").alias("text"))
    tests = tests.filter(F.col("passage_id").isNotNull() & F.col("text").isNotNull()).distinct()
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // block_bytes
    out = None
    for b in range(blocks):
        rows = tests.filter(F.pmod(F.xxhash64("passage_id"), F.lit(blocks)) == b) if blocks > 1 else tests
        index = PassageIndex([(r[0], r[1]) for r in rows.collect()], q, min_words, edits)
        if index.empty:
            continue
        part = src.mapInArrow(partial(_scan, index=spark.sparkContext.broadcast(index)), SCHEMA)
        out = part if out is None else out.unionAll(part)
    if out is None:
        return spark.createDataFrame([], SCHEMA)
    return out.groupBy("doc_id", "passage_id").agg(
        *(F.max_by(c, F.struct("run_words", -F.col("start_pos"))).alias(c) for c in ("run_words", "shared_qgrams", "start_pos", "end_pos"))
    )
