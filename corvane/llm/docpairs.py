"""Problem 5: functions paired with their documentation.

The source of every function chunk is lexed into token rows (one for each line's first lexeme:
comment, decorator, ``def``, string or other code, with the line's net bracket depth). The
structure is found with SQL windows over those rows: a running sum of the depths tells
statement starts from continuation lines, gaps and islands group runs of comment lines, and
lag/lead windows attach a run to the signature below or above it and a string to the body it
opens. Own documentation is what stands in the docstring field, opens the body, or is attached
to the signature; documentation of nested functions is attached to theirs.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: token kinds
COMMENT, DECORATOR, DEF, STRING, CODE, BLANK = range(6)
TOKENS = "ord bigint, pos int, kind tinyint, delta int, text string, name string, signature string, docstring string, code string"

_LEX = re.compile(
    r"(?P<s>[rRbBuUfF]{0,2}(?:\"\"\"|'''))|(?P<q>[rRbBuUfF]{0,2}(?:\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?))"
    r"|(?P<c>#[^\n]*)|(?P<b>[()\[\]{}])|(?P<n>\r?\n)|(?P<x>:)|[^\W\d]\w*|[^\s\w]|\d\w*"
)
_DEF = re.compile(r"(?:async\s+)?def\b")


def lex(text: str) -> list[tuple[int, int, str | None]]:
    """(kind, net depth of its brackets, text of a comment or string) for each line's first lexeme.

    A body on the line of its ``def`` is a row of its own.
    """
    rows: list[list] = []
    fresh, in_def, depth, pos = True, False, 0, 0
    while m := _LEX.search(text, pos):
        start, pos = m.start(), m.end()
        kind = m.lastgroup
        if kind == "n":
            if fresh:
                rows.append([BLANK, 0, None])
            fresh = True
            in_def = in_def and depth > 0
            continue
        if kind == "c":
            if fresh:
                rows.append([COMMENT, 0, m.group()])
                fresh = False
            continue
        if kind in ("s", "q"):
            t = m.group()
            if kind == "s":
                quote, end = t[-3:], pos
                while (end := text.find(quote, end)) >= 0:
                    back = 0
                    while text[end - 1 - back] == "\\":
                        back += 1
                    if back % 2 == 0:
                        break
                    end += 1
                body, pos = (text[pos:], len(text)) if end < 0 else (text[pos:end], end + 3)
            else:
                body = t.lstrip("rRbBuUfF")[1:-1]
            if fresh:
                rows.append([STRING, 0, body])
                fresh = False
            continue
        if fresh:
            c = m.group()
            first = DECORATOR if c == "@" else DEF if _DEF.match(text, start) else CODE
            rows.append([first, 0, None])
            in_def = first == DEF and depth == 0
            fresh = False
        if kind == "b":
            step = 1 if m.group() in "([{" else -1
            depth = max(0, depth + step)
            rows[-1][1] += step
        elif kind == "x" and in_def and depth == 0:
            fresh, in_def = True, False  # what follows on this line is the body
            rest = text.find("\n", pos)
            tail = text[pos : rest if rest >= 0 else len(text)].strip()
            if not tail or tail.startswith("#"):
                fresh = False
    return [tuple(r) for r in rows]


def _lex_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int32(), pa.int8(), pa.int32()] + [pa.string()] * 5
    names = ["ord", "pos", "kind", "delta", "text", "name", "signature", "docstring", "code"]
    for b in batches:
        cols: list[list] = [[] for _ in names]
        for o, name, signature, docstring, text in zip(*(b.column(i).to_pylist() for i in range(5))):
            rows = lex(text or "") or [(CODE, 0, None)]
            n = len(rows)
            kinds, deltas, texts = zip(*rows)
            cols[0] += [o] * n
            cols[1] += range(n)
            cols[2] += kinds
            cols[3] += deltas
            cols[4] += texts
            for k, v in ((5, name), (6, signature), (7, docstring), (8, text)):
                cols[k].append(v)
                cols[k] += [None] * (n - 1)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


# Words that say nothing of their own in a function's documentation.
_EMPTY = set(
    """todo fixme xxx tbd hack wip doc docs docstring documentation document documented undocumented write add describe
    description placeholder missing pending later auto autogenerated generated generate accessor method methods function
    functions func stub see base class parent super superclass inherited inherit inheritdoc overridden override same as
    above here goes helper util utility internal private public return returns returned returning yield yields param
    params parameter parameters arg args argument arguments type types raise raises rtype value values self cls int str
    float bool none any list dict tuple object optional default the a an of for to from with and or by in on this that
    it its is na n no not implemented nothing none comment comments noqa pylint type ignore pragma cover fmt off isort
    skip flake8 mypy nosec yapılacak açıklama eklenecek ekle belge belgelendirilecek sonra daha fonksiyon fonksiyonu
    metot metodu işlev işlevi siehe basisklasse beschreibung folgt funktion methode dokumentation fehlt noch ergänzen
    à compléter documenter fonction méthode voir classe mère description manquante por hacer pendiente documentar
    función método ver clase sin descripción getter setter constructor initialize initializes init main entry point
    implementation details deprecated unused empty test tests""".split()
)
_DIRECTIVE = re.compile(
    r"(?i)^\W*(?:noqa|type\s*:|pylint|pragma|fmt\s*:|isort|flake8|mypy|ruff|nosec|yapf|pyright|pytype|coding[:=]|-\*-|eslint|sourcery|todo\b\s*$)"
)
_FIELD = re.compile(r"^:(?:param|type|arg|raises?|returns?|rtype|yields?|var|ivar)\b[^:]*:?")
_NAMED = re.compile(r"^\*{0,2}`?(\w+)`?\s*(?:\([^)]*\))?\s*(?::|--| - |–)\s*")
_WORDS = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _stem(w: str) -> str:
    for end in ("ies", "es", "ed", "ing", "s", "e", "y"):
        if len(w) > len(end) + 2 and w.endswith(end):
            return w[: -len(end)]
    return w


def _is_code(line: str) -> bool:
    if not re.search(r"[=(\[:.]|^(?:return|pass|break|continue|raise|yield|del|import|from)\b", line):
        return False
    for source in (line, line + "\n    pass" if line.endswith(":") else ""):
        if source:
            try:
                tree = ast.parse(source)
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                continue
            # a lone name or string is prose, an annotation ("x: int") a field of a docstring
            return bool(tree.body) and not (
                isinstance(tree.body[0], ast.Expr)
                and isinstance(tree.body[0].value, ast.Name | ast.Constant)
                or isinstance(tree.body[0], ast.AnnAssign)
                and tree.body[0].value is None
            )
    return False


def says_something(doc: str | None, name: str | None, signature: str | None, comment: bool = False) -> bool:
    """Whether a documentation text has content beyond the function's own names and stock words."""
    if not doc or not doc.strip():
        return False
    known = {_stem(w) for w in _words(f"{name or ''} {signature or ''}")}
    content: list[str] = []
    example = False
    for line in doc.splitlines():
        line = line.strip()
        if comment:
            line = line.lstrip("#:!").strip()
        if not line:
            example = False
            continue
        if line.startswith(">>>"):
            example = True
        if example or _DIRECTIVE.match(line):
            continue
        if comment and _is_code(line):
            continue
        line = _FIELD.sub("", line)
        m = _NAMED.match(line)
        if m and _stem(m.group(1).lower()) in known:
            line = line[m.end() :]
        content += [w for w in _words(line) if w not in _EMPTY and _stem(w) not in known and (len(w) > 1 or ord(w[0]) > 0x2E80)]
        if len(content) >= 2:
            return True
    if len(content) == 1:
        return len(content[0]) > 3 and ord(content[0][0]) > 0x2E80
    return False


def _words(text: str) -> list[str]:
    return [p.lower() for w in _WORDS.findall(text) for p in _CAMEL.split(w)]


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["ord", "name", "signature", "code", "documentation", "place"]
    for b in batches:
        rows = []
        for o, name, signature, code, docstring, string, comments in zip(*(b.column(i).to_pylist() for i in range(7))):
            found = [(docstring, "docstring", False), (string, "body", False)]
            found += [("\n".join(x["t"] for x in c["lines"]), "comment", True) for c in comments or []]
            for text, place, comment in found:
                if says_something(text, name, signature, comment):
                    rows.append((o, name, signature, code, text, place))
                    break
        cols = zip(*rows) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.string()) for i, c in enumerate(cols)], names=names)


def token_rows(chunks: DataFrame) -> DataFrame:
    """Token rows of the function and method chunks; the chunk's own fields stand in the first."""
    src = chunks.filter(F.col("kind").isin("function", "method")).select(
        F.col("ord").cast("bigint").alias("ord"), "name", "signature", "docstring", "text"
    )
    return src.mapInArrow(_lex_batches, TOKENS)


def latest(chunks: DataFrame) -> DataFrame:
    """One row per ``ord``: the one indexed last where ``indexed_at`` is there, of several the one with the longest text."""
    when = F.col("indexed_at") if "indexed_at" in chunks.columns else F.lit(None).cast("timestamp")
    w = Window.partitionBy("ord").orderBy(
        when.desc_nulls_last(), F.length("text").desc_nulls_last(), F.length("docstring").desc_nulls_last(), "text", "docstring", "name", "signature"
    )
    return chunks.withColumn("version", F.row_number().over(w)).filter("version = 1").drop("version")


def pair_documentation(chunks: DataFrame) -> DataFrame:
    """``ord name signature code documentation place`` of the functions with real documentation.

    Needs ``ord kind name signature docstring text`` (and takes the latest row of an ``ord`` where
    ``indexed_at`` is there); further columns are ignored. Null or empty texts leave the docstring
    field alone; a null ``ord`` is dropped (it names no function); rows repeated for an ``ord`` are
    one function, the one indexed last, all of whose fields are read; an empty table gives no rows.
    """
    known = chunks.filter(F.col("ord").isNotNull() & F.col("kind").isin("function", "method"))
    t = token_rows(latest(known))
    by = Window.partitionBy("ord").orderBy("pos", "kind")
    t = t.withColumn("depth", F.coalesce(F.sum("delta").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # statement starts, comments and blanks outside open brackets
    s = t.filter((F.col("depth") <= 0) | (F.col("pos") == 0))
    solid = F.when(~F.col("kind").isin(COMMENT, BLANK), F.col("kind"))
    s = (
        s.withColumn("n", F.row_number().over(by))
        .withColumn("in_kind", F.row_number().over(Window.partitionBy("ord", "kind").orderBy("pos")))
        .withColumn("island", F.col("n") - F.col("in_kind"))
        .withColumn("prev", F.lag("kind").over(by))
        .withColumn("next", F.lead("kind").over(by))
        .withColumn("defs_before", F.coalesce(F.sum((F.col("kind") == DEF).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("before", F.last(solid, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    )
    body = (F.col("kind") == STRING) & (F.col("before") == DEF) & (F.col("defs_before") == 1)
    is_comment = F.col("kind") == COMMENT
    islands = s.groupBy("ord", F.when(is_comment, F.col("island")).otherwise(-1).alias("island")).agg(
        F.array_sort(F.collect_list(F.when(is_comment, F.struct("pos", F.col("text").alias("t"))))).alias("lines"),
        F.max_by("next", F.when(is_comment, F.col("pos"))).alias("below"),
        F.min_by("prev", F.when(is_comment, F.col("pos"))).alias("above"),
        F.min(F.when(is_comment, F.col("defs_before"))).alias("defs"),
        F.max(F.when(body, F.col("text"))).alias("string"),
        *(F.max(c).alias(c) for c in ("name", "signature", "docstring", "code")),
    )
    attached = ((F.col("defs") == 0) & F.col("below").isin(DEF, DECORATOR)) | ((F.col("defs") == 1) & (F.col("above") == DEF))
    whole = islands.groupBy("ord").agg(
        *(F.max(c).alias(c) for c in ("name", "signature", "code", "docstring", "string")),
        F.array_sort(F.collect_list(F.when(attached, F.struct("island", "lines")))).alias("comments"),
    )
    src = whole.select("ord", "name", "signature", "code", "docstring", "string", "comments")
    return src.mapInArrow(_judge, "ord bigint, name string, signature string, code string, documentation string, place string")
