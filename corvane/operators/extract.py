"""Chunk extraction: one file in, its chunks out.

Python files are cut along their syntax tree, documents along their headings. Both run in Arrow
batches over a table of files, and a file that can't be parsed becomes an error row instead of
ending the job.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Limits, marks and suffixes that decide what a chunk holds.
ASSIGNMENT_LIMIT, CUT_MARK = 300, "  # ... (kısaltıldı)"
SECTION_LIMIT, SECTION_OVERLAP = 1500, 150
FIELDS_MARK, METHODS_MARK, MODULE_MARK, DOC_MARK, UNTITLED = "    # alanlar:", "    # metotlar:", "Modül: ", "doküman", "(başlıksız)"
CODE_SUFFIX, DOC_SUFFIXES = ".py", (".md", ".markdown", ".mdx", ".rst", ".txt")
HEADING, FENCE = re.compile(r"(#{1,6})\s+(.*)"), re.compile(r"\s*(?:```|~~~)")

EXTRACTED = (
    "path string, part int, source string, kind string, name string, start_line int, end_line int, location string, signature string, "
    "docstring string, parent string, context string, text string, content_hash string, error string"
)


@dataclass
class Piece:
    source: str
    kind: str
    name: str
    start: int
    end: int
    text: str
    context: str
    signature: str | None = None
    docstring: str | None = None
    parent: str | None = None


@dataclass
class PythonFile:
    """Walks the definitions of one module and collects its chunks."""

    path: str
    source: str
    pieces: list[Piece] = field(default_factory=list)

    def run(self) -> list[Piece]:
        self.tree = ast.parse(self.source)
        self.rows = self.source.splitlines()
        self.doc = ast.get_docstring(self.tree)
        self._module()
        self._definitions(self.tree.body, "")
        return self.pieces

    def _label(self, name: str, kind: str) -> str:
        out = f"{self.path} > {name} ({kind})"
        first = self.doc.strip().partition("\n")[0].strip() if self.doc else ""
        return f"{out}\n{MODULE_MARK}{first}" if first else out

    def _module(self) -> None:
        body = self.tree.body
        doc = [body[0]] if self.doc else []
        imports = [n for n in body if isinstance(n, ast.Import | ast.ImportFrom)]
        values = list(assignments(body))
        if not (doc or imports or values):
            return
        texts = [f'"""{self.doc.strip()}"""'] if self.doc else []
        texts += map(ast.unparse, imports)
        texts += [render(node, note) for node, note in values]
        nodes = doc + imports + [x for node, note in values for x in (node, note) if x is not None]
        name = self.path.removesuffix(CODE_SUFFIX).replace("/", ".")
        self.pieces.append(
            Piece(
                "code", "module", name, min(n.lineno for n in nodes), max(n.end_lineno or n.lineno for n in nodes), "\n".join(texts),
                self._label(name, "module"), docstring=self.doc,
            )
        )

    def _definitions(self, body: list[ast.stmt], inside: str) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef):
                kind = "class"
            elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "method" if inside else "function"
            else:
                continue
            name = f"{inside}.{node.name}" if inside else node.name
            start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            end = node.end_lineno or node.lineno
            text = summary(node) if kind == "class" else "\n".join(self.rows[start - 1 : end])
            self.pieces.append(
                Piece("code", kind, name, start, end, text, self._label(name, kind), headline(node), ast.get_docstring(node), inside or None)
            )
            if kind == "class":
                self._definitions(node.body, name)


def headline(node: ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """Signature without a body."""
    if isinstance(node, ast.ClassDef):
        heirs = ", ".join(map(ast.unparse, [*node.bases, *node.keywords]))
        return f"class {node.name}({heirs}):" if heirs else f"class {node.name}:"
    word = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
    gives = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    return f"{word} {node.name}({ast.unparse(node.args)}){gives}:"


def assignments(body: list[ast.stmt]) -> Iterator[tuple[ast.stmt, ast.Expr | None]]:
    """Assignments of a body, each with the bare string right behind it."""
    for node, after in zip(body, [*body[1:], None]):
        if isinstance(node, ast.Assign | ast.AnnAssign):
            note = isinstance(after, ast.Expr) and isinstance(after.value, ast.Constant) and isinstance(after.value.value, str)
            yield node, after if note and after.value.value else None


def render(node: ast.stmt, note: ast.Expr | None, indent: str = "") -> str:
    text = ast.unparse(node)
    if len(text) > ASSIGNMENT_LIMIT:
        text = text[:ASSIGNMENT_LIMIT] + CUT_MARK
    return f"{indent}{text}" + (f'\n{indent}"""{note.value.value.strip()}"""' if note else "")


def summary(node: ast.ClassDef) -> str:
    """Class chunk: signature, docstring, fields and the methods' signatures."""
    doc = ast.get_docstring(node)
    out = [headline(node)] + ([f'    """{doc.strip()}"""'] if doc else [])
    fields = [render(n, note, "    ") for n, note in assignments(node.body)]
    methods = ["    " + headline(n) for n in node.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    if fields:
        out += [FIELDS_MARK, *fields]
    if methods:
        out += [METHODS_MARK, *methods]
    return "\n".join(out)


def split_section(text: str, start: int, limit: int = SECTION_LIMIT, overlap: int = SECTION_OVERLAP) -> list[tuple[str, int]]:
    """Parts of a section as (text, first line): whole lines up to the limit, then the tail again."""
    rows = text.splitlines()
    out: list[tuple[str, int]] = []
    first, used = 0, 0  # the part so far is rows[first:i], ``used`` characters with line ends
    for i, row in enumerate(rows):
        if i > first and used + len(row) > limit:
            out.append(("\n".join(rows[first:i]), start + first))
            back, kept = i, 0
            while back > first and kept + len(rows[back - 1]) <= overlap:
                back -= 1
                kept += len(rows[back]) + 1
            first, used = back, kept
        used += len(row) + 1
    if "".join(rows[first:]).strip():
        out.append(("\n".join(rows[first:]), start + first))
    return out


def markdown_pieces(source: str, path: str) -> list[Piece]:
    """Sections of a document under their headings; headings inside fences are text."""
    trail: list[str] = []
    sections: list[tuple[tuple[str, ...], int, list[str]]] = [((), 1, [])]
    fenced = False
    for n, row in enumerate(source.splitlines(), 1):
        fenced ^= bool(FENCE.match(row))
        m = None if fenced else HEADING.fullmatch(row)
        if m:
            level = len(m[1]) - 1
            trail = trail[:level] + [""] * (level - len(trail)) + [m[2].strip()]
            sections.append((tuple(trail), n, [row]))
        else:
            sections[-1][2].append(row)
    out = []
    for titles, start, rows in sections:
        if not "".join(rows).strip():
            continue
        name = " > ".join(filter(None, titles)) or UNTITLED
        above = " > ".join(filter(None, titles[:-1])) or None
        for text, at in split_section("\n".join(rows).strip("\n"), start):
            out.append(
                Piece("doc", "section", name, at, at + len(text.splitlines()) - 1, text, f"{path} > {name} ({DOC_MARK})", parent=above)
            )
    return out


def file_pieces(path: str, content: bytes) -> list[Piece]:
    text = content.decode("utf-8", errors="replace")
    suffix = PurePosixPath(path).suffix
    if suffix == CODE_SUFFIX:
        return PythonFile(path, text).run()
    return markdown_pieces(text, path) if suffix.lower() in DOC_SUFFIXES else []


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in EXTRACTED.split(", ")]
    whole = {"part", "start_line", "end_line"}
    for b in batches:
        rows = []
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            try:
                pieces = file_pieces(path, content or b"")
            except SyntaxError as e:
                rows.append((path, 0, *[None] * 12, f"{path}: sözdizimi hatası satır {e.lineno}"))
                continue
            except (ValueError, RecursionError, MemoryError) as e:
                rows.append((path, 0, *[None] * 12, f"{path}: {e}"))
                continue
            for i, p in enumerate(pieces):
                h = hashlib.sha256(f"{p.context}\n\n{p.text}".encode("utf-8", "replace")).hexdigest()[:16]
                rows.append(
                    (path, i, p.source, p.kind, p.name, p.start, p.end, f"{path}:{p.start}", p.signature, p.docstring, p.parent, p.context, p.text, h, None)
                )
        cols = zip(*rows) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n in whole else pa.string()) for n, c in zip(names, cols)], names=names)


def extract(files: DataFrame) -> DataFrame:
    """Chunk and error rows (``EXTRACTED``) of files with columns ``path content``; null paths are left out."""
    src = files.filter("path is not null").select("path", F.col("content").cast("binary").alias("content"))
    return src.mapInArrow(_extract, EXTRACTED)


def chunks_of(extracted: DataFrame) -> DataFrame:
    return extracted.filter("error is null").drop("error")


def errors_of(extracted: DataFrame) -> DataFrame:
    return extracted.filter("error is not null").select("path", F.col("error").alias("message"))
