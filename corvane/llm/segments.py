"""Problem 6: splitting oversized chunks at natural boundaries.

Lexical-cohesion segmentation: for every gap between lines the words of a sliding block before
it are compared (cosine of counts) with those of the block behind it; a valley of that curve
marks a change of topic, its depth is the rise to the peaks on both sides. Each piece ends at
the deepest valley among the natural boundaries of the window that the size limit leaves, at
the deepest valley of any line gap where the window holds no natural boundary, and at white
space (at last anywhere) where a single line exceeds the limit. The next piece begins with
whole lines of the piece before it, as many as the overlap allows.

A natural boundary is a non-blank line behind a blank one, outside fenced blocks (sections)
or triple-quoted strings and open brackets (code).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = (
    "ord bigint, piece int, start_line int, end_line int, overlap_lines int, text string, "
    "boundaries array<struct<line_no:int,depth:double>>"
)
_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})(.*)")
_CODE = re.compile(r"\"\"\"|'''|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|#[^\n]*|[()\[\]{}]|\n")
_WORD = re.compile(r"[^\W_]+")


def inside_fence(lines: list[str]) -> list[bool]:
    """Per line: whether it lies in a fenced block that began on an earlier line."""
    out, fence = [], ""
    for line in lines:
        out.append(bool(fence))
        m = _FENCE.match(line)
        if fence:
            if m and m.group(1).startswith(fence) and not m.group(2).strip():
                fence = ""
        elif m and (m.group(1)[0] == "~" or "`" not in m.group(2)):
            fence = m.group(1)
    return out


def inside_code(text: str) -> list[bool]:
    """Per line: whether it begins within a triple-quoted string or open brackets."""
    out, depth, pos = [False], 0, 0
    while m := _CODE.search(text, pos):
        pos, t = m.end(), m.group()
        if t == "\n":
            out.append(depth > 0)
        elif t in ('"""', "'''"):
            end = pos
            while (end := text.find(t, end)) >= 0:
                back = 0
                while text[end - 1 - back] == "\\":
                    back += 1
                if back % 2 == 0:
                    break
                end += 1
            stop = len(text) if end < 0 else end + 3
            out.extend([True] * text.count("\n", pos, stop))
            pos = stop
        elif t in "([{":
            depth += 1
        elif t in ")]}":
            depth = max(0, depth - 1)
    return out


def natural_boundaries(text: str, kind: str | None) -> list[int]:
    """Indices of the lines at which a piece may naturally begin."""
    lines = text.split("\n")
    inside = inside_fence(lines) if kind == "section" else inside_code(text)
    blank = [not x.strip() for x in lines]
    return [i for i in range(1, len(lines)) if blank[i - 1] and not blank[i] and not inside[i]]


def cohesion_depths(lines: list[str], block: int = 6) -> list[float]:
    """Depth of the cohesion valley at the gap before each line (0 for the first)."""
    n = len(lines)
    bags = [Counter(w.lower() for w in _WORD.findall(x)) for x in lines]
    sim = [1.0] * n
    left: Counter = Counter()
    right: Counter = Counter()
    for b in bags[:block]:
        right.update(b)
    for g in range(1, n):
        left.update(bags[g - 1])
        right.subtract(bags[g - 1])
        if g - 1 + block < n:
            right.update(bags[g - 1 + block])
        if g - 1 - block >= 0:
            left.subtract(bags[g - 1 - block])
        small, big = (left, right) if len(left) < len(right) else (right, left)
        dot = sum(c * big[w] for w, c in small.items() if c and w in big)
        norm = math.sqrt(sum(c * c for c in left.values()) * sum(c * c for c in right.values()))
        sim[g] = dot / norm if norm else 0.0
        if g % 64 == 0:
            left, right = +left, +right
    peak_left, peak_right = sim[:], sim[:]
    for g in range(2, n):
        if sim[g - 1] >= sim[g]:
            peak_left[g] = peak_left[g - 1]
    for g in range(n - 2, 0, -1):
        if sim[g + 1] >= sim[g]:
            peak_right[g] = peak_right[g + 1]
    return [0.0] + [peak_left[g] + peak_right[g] - 2 * sim[g] for g in range(1, n)]


def split(text: str, kind: str | None, limit: int = 1500, overlap: int = 150) -> tuple[list[tuple], dict[int, float]]:
    """Pieces (first line, last line, overlap lines, text) and {boundary line: valley depth}.

    Pieces without their overlap lines, one after the other, are the text again.
    """
    lines = text.split("\n")
    whole = [x + "\n" for x in lines[:-1]] + [lines[-1]]
    at = [0]
    for x in whole:
        at.append(at[-1] + len(x))
    depth = cohesion_depths(lines)
    natural = natural_boundaries(text, kind)
    edges = {i: depth[i] for i in natural}
    n = len(whole)
    pieces: list[tuple] = []
    i, shift, over = 0, 0, 0  # next line, characters of it already out, overlap lines before it
    while i < n:
        base = at[i - over]
        if over and at[i + 1] - base > limit:
            over -= 1  # the overlap must leave room for one more line
            continue
        if at[i + 1] - at[i] - shift > limit and not over or shift:
            start = at[i] + shift
            stop = at[i + 1]
            if stop - start > limit:
                cut = max(text.rfind(" ", start + limit // 2, start + limit), text.rfind("\t", start + limit // 2, start + limit)) + 1
                stop = cut if cut > start else start + limit
            pieces.append((i, i, 0, text[start:stop]))
            if stop == at[i + 1]:
                i, shift = i + 1, 0
            else:
                shift = stop - at[i]
            continue
        j = i + 1
        while j < n and at[j + 1] - base <= limit:
            j += 1
        if j < n:
            low = at[i] + (limit - (at[i] - base)) // 3
            window = range(i + 1, j + 1)
            best = [g for g in window if g in edges and at[g] >= low] or [g for g in window if g in edges]
            best = best or [g for g in window if at[g] >= low] or [j]
            j = max(best, key=lambda g: (depth[g], g))
        pieces.append((i - over, j - 1, over, text[base : at[j]]))
        over = 0
        while j - over - 1 > i and at[j] - at[j - over - 1] <= overlap:
            over += 1
        i = j
    return pieces, edges


def _run(limit: int, overlap: int):
    kind_type = pa.list_(pa.struct([("line_no", pa.int32()), ("depth", pa.float64())]))
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), kind_type]
    names = ["ord", "piece", "start_line", "end_line", "overlap_lines", "text", "boundaries"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for o, kind, first, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                first = 1 if first is None else first
                pieces, edges = split(text, kind, limit, overlap)
                left = sorted(edges.items())
                k = 0
                for n, (s, e, over, piece) in enumerate(pieces):
                    own = []
                    while k < len(left) and left[k][0] <= e:
                        own.append({"line_no": first + left[k][0], "depth": left[k][1]})
                        k += 1
                    rows.append((o, n, first + s, first + e, over, piece, own))
            cols = zip(*rows) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return run


def split_oversized(chunks: DataFrame, *, limit: int = 1500, overlap: int = 150) -> DataFrame:
    """Pieces of at most ``limit`` characters of every chunk whose text is longer.

    Needs ``ord kind start_line text`` (and takes the latest row of an ``ord`` where
    ``indexed_at`` is there); further columns are ignored. Columns as in ``SCHEMA``;
    ``boundaries`` are the natural boundaries that begin in a piece's own lines, with the depth
    of their valley. Chunks up to the limit, null and empty texts give no rows; a null
    ``start_line`` counts as 1; of rows with a null ``ord`` each different text is kept; ``end_line``
    of the input isn't read, as it is often wrong; repeated rows count once; an empty table gives
    no rows.
    """
    long = chunks.filter(F.length("text") > limit)
    when = F.col("indexed_at") if "indexed_at" in chunks.columns else F.lit(None)
    own = F.when(F.col("ord").isNull(), F.xxhash64("text", "start_line", "kind"))
    w = Window.partitionBy("ord", own).orderBy(F.col("when").desc_nulls_last(), "text", "start_line", "kind")
    src = long.select(
        F.col("ord").cast("bigint").alias("ord"), "kind", F.col("start_line").cast("int").alias("start_line"), "text", when.alias("when")
    )
    src = src.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("ord", "kind", "start_line", "text")
    return src.mapInArrow(_run(limit, overlap), SCHEMA)


def boundaries(pieces: DataFrame) -> DataFrame:
    """One row per natural boundary of the pieces: ``ord line_no depth``."""
    return pieces.select("ord", F.explode("boundaries").alias("b")).select("ord", "b.line_no", "b.depth")
