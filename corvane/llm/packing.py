"""Problem 7: filling containers of fixed capacity with texts.

Best-fit decreasing: items go, from the largest to the smallest, into the open container with
the least room that still holds them. What it does depends on the sizes alone, and those are
whole numbers up to the capacity, so the plan is made from the histogram of sizes: containers
with equal room are one entry with a count, a segment tree over the room left finds the
tightest entry in logarithmic time, and items of one size fill an entry's containers in one
step. The plan has at most a few rows per size and container pattern, whatever the number of
texts. Each text then finds its container from its rank among the texts of its size.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import stage

TOKENIZERS = os.environ.get("CORVANE_TOKENIZERS", "/opt/tokenizers")
SCHEMA = "doc_id bigint, piece int, token_start int, token_end int, start_pos int, end_pos int, n_tokens int"
_SIZES = SCHEMA + ", text_tokens bigint, digest bigint"
PLAN = "n_tokens int, rank_from bigint, rank_to bigint, container_from bigint, per_container int, slot int"
_BUCKET_ROWS = 250_000  #: rows of one size that one task ranks, about

# Fixed value: the split pattern that belongs to the vocabulary byte_bpe_50k.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    """Byte-level BPE with the ranks of a ``.tiktoken`` file."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(enc, text: str, capacity: int) -> list[tuple[int, int, int, int]]:
    """(token start, token end, first character, last character) of the pieces of one text.

    A text within the capacity is one piece. Cuts are at token borders that are also borders
    of characters.
    """
    tokens = enc.encode_ordinary(text)
    if len(tokens) <= capacity:
        return [(0, len(tokens), 0, len(text))]
    out, start, at = [], 0, 0
    lead = [enc.decode_single_token_bytes(t)[0] & 0xC0 != 0x80 for t in tokens]
    while start < len(tokens):
        end = min(start + capacity, len(tokens))
        while end < len(tokens) and end > start + 1 and not lead[end]:
            end -= 1
        stop = len(text) if end == len(tokens) else at + len(enc.decode_bytes(tokens[start:end]).decode("utf-8", "replace"))
        out.append((start, end, at, stop))
        start, at = end, stop
    return out


def _measure(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        names = ["doc_id", "piece", "token_start", "token_end", "start_pos", "end_pos", "n_tokens", "text_tokens", "digest"]
        wide = {"doc_id", "text_tokens", "digest"}
        for b in batches:
            rows = []
            for i, t, h in zip(*(b.column(k).to_pylist() for k in range(3))):
                cut = pieces(enc, t or "", capacity)
                for k, (s, e, c, d) in enumerate(cut):
                    rows.append((i, k, s, e, c, d, e - s, cut[-1][1], h))
            cols = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in wide else pa.int32()) for n, c in zip(names, cols)], names=names)

    return run


class RoomTree:
    """Segment tree over the room left: which amounts have open containers."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, room: int, there: bool) -> None:
        i = room + self.size
        self.any[i] = there
        while i > 1:
            i >>= 1
            now = self.any[2 * i] | self.any[2 * i + 1]
            if self.any[i] == now:
                break
            self.any[i] = now

    def tightest(self, need: int) -> int:
        """The smallest room >= ``need`` with an open container, or -1."""
        i = need + self.size
        if self.any[i]:
            return need
        while i > 1:
            if i & 1 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (size, rank from, rank to, first container, items per container, first slot).

    The items of ``size`` with ranks in [from, to) go, ``per container`` at a time, into
    consecutive containers.
    """
    tree = RoomTree(capacity)
    open_: dict[int, list[tuple[int, int, int]]] = {}  # room -> [(first container, containers, items in each)]
    rows, containers = [], 0

    def put(room: int, first: int, n: int, filled: int) -> None:
        if n and room > 0:
            open_.setdefault(room, []).append((first, n, filled))
            tree.set(room, True)

    for size in sorted((s for s in histogram if s > 0), reverse=True):
        rank, count = 0, histogram[size]
        while rank < count:
            room = tree.tightest(size)
            if room < 0:
                each = capacity // size
                need = -(-(count - rank) // each)
                put(capacity, containers, need, 0)
                containers += need
                room = capacity
            first, n, filled = open_[room].pop()
            if not open_[room]:
                del open_[room]
                tree.set(room, False)
            each = room // size
            whole = min(n, (count - rank) // each)
            if whole:
                rows.append((size, rank, rank + whole * each, first, each, filled))
                rank += whole * each
                put(room - each * size, first, whole, filled + each)
                first, n = first + whole, n - whole
            if n and rank < count:
                some = count - rank
                rows.append((size, rank, count, first, some, filled))
                rank = count
                put(room - some * size, first, 1, filled + some)
                first, n = first + 1, n - 1
            put(room, first, n, filled)
    return rows


def measure(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """Pieces of every text with their token counts, as in ``_SIZES``."""
    path = tokenizer or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src.filter("doc_id is not null").withColumn("digest", F.xxhash64("text"))
    return src.mapInArrow(_measure(path, capacity), _SIZES)


def pack(docs: DataFrame, *, capacity: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """Every piece with its container: the columns of ``SCHEMA``, ``container_id`` and ``slot``.

    Needs ``doc_id`` and ``text``; further columns are ignored. A text is cut only if it alone
    exceeds ``capacity`` tokens. Null and empty texts have no tokens: one row each, with null
    container and slot. Rows with a null ``doc_id`` are left out; repeated rows count once, of
    texts that differ under one ``doc_id`` the one with most tokens counts; ties of size are
    ordered by ``doc_id``; an empty table gives no rows.
    """
    spark = docs.sparkSession
    sized = measure(docs, capacity, tokenizer)
    # one text per doc_id, and each of its pieces once
    texts = Window.partitionBy("doc_id").orderBy(F.desc("text_tokens"), "digest")
    copies = Window.partitionBy("doc_id", "piece").orderBy("digest")
    sized = sized.withColumn("text_rank", F.dense_rank().over(texts)).filter("text_rank = 1")
    sized = sized.withColumn("copy", F.row_number().over(copies)).filter("copy = 1").drop("copy", "text_rank", "text_tokens", "digest")
    sized = stage(sized, "packing-sizes")
    # as many buckets as the most common size needs: full pieces of long texts all have one size
    most = sized.groupBy("n_tokens").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(1 + most // _BUCKET_ROWS)).cast("int"))
    # ranks within a size: offsets of small buckets first, then ranks within a bucket
    counts = sized.groupBy("n_tokens", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("offset", F.coalesce(before, F.lit(0)))
    # at most ``capacity`` rows: the histogram of sizes is bounded by the container
    histogram = {r[0]: r[1] for r in counts.groupBy("n_tokens").agg(F.sum("n")).collect()}
    planned = spark.createDataFrame(plan(histogram, capacity), PLAN)
    # of the plan's ranges of a size, each bucket gets those that its own ranks reach
    own = offsets.join(planned, "n_tokens").filter("rank_from < offset + n and rank_to > offset")
    ranges = own.groupBy("n_tokens", "bucket").agg(
        F.array_sort(F.collect_list(F.struct("rank_from", "container_from", "per_container", "slot"))).alias("ranges")
    )
    buckets = offsets.select("n_tokens", "bucket", "offset").join(ranges, ["n_tokens", "bucket"], "left")
    ranked = sized.withColumn("rn", F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece")))
    ranked = ranked.join(buckets, ["n_tokens", "bucket"]).withColumn("rank", F.col("offset") + F.col("rn") - 1)
    hit = F.expr("element_at(filter(ranges, r -> r.rank_from <= rank), -1)")
    out = ranked.withColumn("hit", F.when(F.col("ranges").isNotNull(), hit)).drop("ranges")
    inner = F.col("rank") - F.col("hit.rank_from")
    return out.select(
        "doc_id",
        "piece",
        "token_start",
        "token_end",
        "start_pos",
        "end_pos",
        "n_tokens",
        (F.col("hit.container_from") + F.floor(inner / F.col("hit.per_container"))).alias("container_id"),
        (F.col("hit.slot") + inner % F.col("hit.per_container")).cast("int").alias("slot"),
    )
