"""Problem 2: records of evaluation splits that the training split already holds.

Content-defined chunks: a record is normalised to its distinct words in the order in which they
come, a hash rolls over the characters of that text, across the borders of words, and cuts it
behind a word where its value says so; the chunks' digests are joined across splits and the
lengths of shared chunks, summed, give the overlap fraction of each record.

Records as short as questions give few chunks, and an edit breaks the chunk it falls into, so a
record is cut several times: each chunking reads other bits of the same rolling hash. A pair
at the threshold is missed only if it shares no chunk in any of them; ``chunkings_for`` gives
the number for a target recall. What the join finds is checked on the whole sets of words.

Not every chunk is a key of the join. A pair that shares enough of its words must share one of
the rarest words of either side (the prefix of a set-similarity join); only chunks that hold one
are keys. A phrase that a third of all rows share, "which function decides whether", so joins
nothing unless it is most of the record, and then the pairs are results. Keys that are frequent
on both sides are split over several tasks.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.wordfold import words
from corvane.session import stage

_MASK = (1 << 64) - 1
_BASE = 0x100000001B3
_ODD = 0x9E3779B97F4A7C15
WINDOW = 6  #: characters the rolling hash sees
MEAN_WORDS = 2  #: words of a chunk, on average
_DROP = pow(_BASE, WINDOW, 1 << 64)
_TASK_PAIRS = 250_000  #: pairs of one key that one task joins

RECORDS = "id string, split string, set_name string, files array<string>, words array<string>, class_id binary"


def chunkings_for(recall: float, mean_words: int = MEAN_WORDS) -> int:
    """Chunkings after which one shared word has stood in a chunk of its own with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - mean_words**-2.0))


def rolling(distinct: list[str]) -> list[int]:
    """The rolling hash over the last ``WINDOW`` characters behind each word of the record."""
    out, h, at = [], 0, 0
    text = " ".join(distinct) + " "
    for w in distinct:
        for i in range(at, at + len(w) + 1):
            h = (h * _BASE + ord(text[i]) + 1) & _MASK
            if i >= WINDOW:
                h = (h - (ord(text[i - WINDOW]) + 1) * _DROP) & _MASK
        at += len(w) + 1
        x = (h ^ (h >> 29)) * _ODD & _MASK
        out.append(x ^ (x >> 32))
    return out


def cut(distinct: list[str], chunking: int = 0, mean_words: int = MEAN_WORDS, hashes: list[int] | None = None) -> list[tuple[int, int]]:
    """(first word, end) of the chunks of a normalised record: cut where the rolling hash says so."""
    out, first = [], 0
    seed = (chunking + 1) * _ODD & _MASK
    for i, h in enumerate(rolling(distinct) if hashes is None else hashes):
        h = (h ^ seed) * 0xD6E8FEB86659FD93 & _MASK
        if i + 1 == len(distinct) or (h >> 33) % mean_words == 0:
            out.append((first, i + 1))
            first = i + 1
    return out


def digests(distinct: list[str], chunkings: int, mean_words: int = MEAN_WORDS) -> list[dict[int, tuple[int, int]]]:
    """{digest: (first word, end)} of the chunks of each chunking."""
    hashes = rolling(distinct)
    return [
        {xxhash.xxh3_64_intdigest(" ".join(distinct[s:e])) - (1 << 63): (s, e) for s, e in cut(distinct, c, mean_words, hashes)}
        for c in range(chunkings)
    ]


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = pa.list_(pa.string())
    types = [pa.string(), pa.string(), pa.string(), texts, texts, pa.binary()]
    names = [x.split()[0] for x in RECORDS.split(", ")]
    for b in batches:
        rows = []
        for i, split, source, files, t in zip(*(b.column(k).to_pylist() for k in range(5))):
            own = list(dict.fromkeys(words(unicodedata.normalize("NFC", t or ""))))
            same = "\x00".join(["\x01".join(own), *(files or [])])
            rows.append((i, split, source, files, own, xxhash.xxh3_128_digest(same.encode("utf-8", "surrogatepass"))))
        cols = zip(*rows) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def _keys(batches: Iterator[pa.RecordBatch], chunkings: int, mean_words: int) -> Iterator[pa.RecordBatch]:
    """(class_id, n, words, rare positions) -> (class_id, n, digests of the chunks that hold a rare word)."""
    for b in batches:
        rows = []
        for i, n, own, rare in zip(*(b.column(k).to_pylist() for k in range(4))):
            found = {d for one in digests(own, chunkings, mean_words) for d, (s, e) in one.items() if any(s <= r < e for r in rare)}
            rows.append((i, n, sorted(found)))
        cols = zip(*rows) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.list_(pa.int64())))], names=["class_id", "n_words", "digests"]
        )


def _overlaps(batches: Iterator[pa.RecordBatch], threshold: float, chunkings: int, mean_words: int) -> Iterator[pa.RecordBatch]:
    """Candidate pairs with their words -> those that reach the threshold, with both measures."""
    chunks = lru_cache(maxsize=4096)(lambda own: digests(list(own), chunkings, mean_words))
    names = ["ca", "cb", "shared_words", "jaccard", "eval_overlap", "chunk_overlap"]
    types = [pa.binary(), pa.binary(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
    for b in batches:
        rows = []
        for ca, cb, wa, wb in zip(*(b.column(k).to_pylist() for k in range(4))):
            shared = len(set(wa).intersection(wb))
            if shared < threshold * (len(wa) + len(wb) - shared) - 1e-9:
                continue
            both = 0
            for one, two in zip(chunks(tuple(wa)), chunks(tuple(wb))):
                both += sum(e - s for d, (s, e) in two.items() if d in one)
            rows.append((ca, cb, shared, shared / (len(wa) + len(wb) - shared), shared / len(wb), both / (chunkings * len(wb))))
        cols = zip(*rows) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def normal_split(split: Column) -> Column:
    """Lower-cased without spaces around it; null or blank is ``dev``."""
    s = F.lower(F.regexp_replace(split, r"^\s+|\s+$", ""))
    return F.when(s.isNull() | (s == ""), "dev").otherwise(s)


def normal_files(files: Column) -> Column:
    """Distinct paths with ``/`` and without leading ``./``, sorted."""
    one = F.transform(files, lambda f: F.regexp_replace(F.regexp_replace(F.trim(f), r"\\", "/"), r"^(\./+)+", ""))
    return F.array_sort(F.array_distinct(F.filter(one, lambda f: f.isNotNull() & (f != ""))))


def records(questions: DataFrame) -> DataFrame:
    """One row per distinct (id, text, files, split, source), normalised, as in ``RECORDS``.

    Needs ``id question expect_files split set_name``; further columns are ignored.
    """
    base = questions.select(
        F.col("id").cast("string").alias("id"),
        normal_split(F.col("split")).alias("split"),
        F.col("set_name").cast("string").alias("set_name"),
        normal_files(F.col("expect_files")).alias("files"),
        F.col("question").cast("string").alias("question"),
    )
    return base.filter(F.col("id").isNotNull()).distinct().mapInArrow(_normalised, RECORDS)


def candidates(classes: DataFrame, threshold: float, chunkings: int, mean_words: int) -> DataFrame:
    """Pairs (ca, cb) of a training and an evaluation class that share a file and the digest of a chunk."""
    common = classes.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    by_word = classes.select("class_id", F.posexplode("words").alias("pos", "word")).join(common, "word")
    need = F.ceil(threshold * F.count("*") - 1e-9)
    rare = by_word.groupBy("class_id").agg(
        F.array_sort(F.collect_list(F.struct("df", "word", "pos"))).alias("r"), (F.count("*") - need + 1).cast("int").alias("prefix")
    )
    rare = rare.select("class_id", F.expr("transform(slice(r, 1, prefix), x -> x.pos)").alias("rare"))
    src = classes.join(rare, "class_id").select("class_id", F.size("words").alias("n_words"), "words", "rare")
    cutter = partial(_keys, chunkings=chunkings, mean_words=mean_words)
    keys = src.mapInArrow(cutter, "class_id binary, n_words int, digests array<bigint>").withColumn("digest", F.explode("digests"))
    keys = keys.select("class_id", "n_words", "digest").join(classes.select("class_id", "train", "eval", F.explode("files").alias("file")), "class_id")
    keys = stage(keys, "overlap-keys")
    both = keys.groupBy("digest", "file").agg(F.count_if("train").alias("nt"), F.count_if("eval").alias("ne")).filter("nt > 0 and ne > 0")
    # the pairs of a frequent key are split by their evaluation side
    parts = F.ceil(F.col("nt") * F.col("ne") / F.lit(_TASK_PAIRS)).cast("int")
    met = keys.join(both.select("digest", "file", parts.alias("parts")), ["digest", "file"])
    a = met.filter("train").select(
        F.col("class_id").alias("ca"), F.col("n_words").alias("na"), "digest", "file", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    b = met.filter("eval").select(
        F.col("class_id").alias("cb"), F.col("n_words").alias("nb"), "digest", "file", F.pmod(F.xxhash64("class_id"), "parts").cast("int").alias("part")
    )
    met = a.join(b, ["digest", "file", "part"]).filter(F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)
    return met.select("ca", "cb").distinct()


def find_overlaps(
    questions: DataFrame,
    *,
    threshold: float = 0.6,
    recall: float = 0.99,
    mean_words: int = MEAN_WORDS,
    chunkings: int | None = None,
    train: str = "dev",
    evaluation: tuple[str, ...] = ("test", "holdout"),
) -> DataFrame:
    """Pairs of an evaluation record and a training record that share a file and enough words.

    Columns ``eval_id train_id eval_split set_name shared_words jaccard eval_overlap
    chunk_overlap``. Pairs come from the join of chunk digests and are kept where shared words /
    all distinct words of both >= ``threshold``; ``eval_overlap`` is the share of the evaluation
    record's words that the other holds, ``chunk_overlap`` the share that its shared chunks sum
    up to, on average over the chunkings. Null or wordless questions, null ids and records
    without a file overlap with nothing; repeated rows count once; splits other than ``train``
    and ``evaluation`` are ignored; empty tables give no rows. Records equal in words and files
    are joined as one class and expanded at the end, so copies cost the rows they must yield and
    nothing before.
    """
    side = F.when(F.col("split") == train, 0).when(F.col("split").isin(*evaluation), 1)
    rec = records(questions).withColumn("side", side).filter(F.col("side").isNotNull() & (F.size("words") > 0) & (F.size("files") > 0))
    rec = stage(rec, "overlap-records")
    chunkings = chunkings or chunkings_for(recall, mean_words)
    classes = rec.groupBy("class_id").agg(
        F.first("words").alias("words"), F.first("files").alias("files"), F.max(F.col("side") == 0).alias("train"), F.max(F.col("side") == 1).alias("eval")
    )
    classes = stage(classes, "overlap-classes")
    pairs = candidates(classes, threshold, chunkings, mean_words)
    texts = classes.select("class_id", "words")
    pairs = pairs.join(texts.select(F.col("class_id").alias("ca"), F.col("words").alias("wa")), "ca")
    pairs = pairs.join(texts.select(F.col("class_id").alias("cb"), F.col("words").alias("wb")), "cb")
    scored = pairs.select("ca", "cb", "wa", "wb").mapInArrow(
        partial(_overlaps, threshold=threshold, chunkings=chunkings, mean_words=mean_words),
        "ca binary, cb binary, shared_words int, jaccard double, eval_overlap double, chunk_overlap double",
    )
    t = rec.filter("side = 0").select(F.col("id").alias("train_id"), F.col("class_id").alias("ca")).distinct()
    e = rec.filter("side = 1").select(F.col("id").alias("eval_id"), F.col("class_id").alias("cb"), F.col("split").alias("eval_split"), "set_name").distinct()
    return scored.join(t, "ca").join(e, "cb").drop("ca", "cb")


def overlap_report(questions: DataFrame, **options) -> DataFrame:
    """Per evaluation split and source: records, records that overlap, their share, mean best overlap."""
    evaluation = options.get("evaluation", ("test", "holdout"))
    hits = find_overlaps(questions, **options).groupBy("eval_id", "eval_split", "set_name").agg(F.max("eval_overlap").alias("best"))
    total = (
        questions.filter(F.col("id").isNotNull())
        .select(F.col("id").alias("eval_id"), normal_split(F.col("split")).alias("eval_split"), "set_name")
        .distinct()
        .filter(F.col("eval_split").isin(*evaluation))
    )
    cond = [total[c].eqNullSafe(hits[c]) for c in ("eval_id", "eval_split", "set_name")]
    both = total.join(hits, cond[0] & cond[1] & cond[2], "left").select(total["eval_split"], total["set_name"], "best")
    return both.groupBy("eval_split", "set_name").agg(
        F.count("*").alias("records"),
        F.count("best").alias("overlapping"),
        F.bround(F.count("best") / F.count("*"), 6).alias("share"),
        F.bround(F.avg("best"), 6).alias("mean_best_overlap"),
    )
