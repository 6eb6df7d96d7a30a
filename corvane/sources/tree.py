"""A source tree as a table: Spark Data Source ``corvane_tree``.

Spark's own file listing drops names that begin with an underscore, and such files hold code,
so the tree is walked here. The walk yields a file's place in the order of the index; the files
are read by the tasks, in groups of bounded size.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvane.operators.extract import CODE_SUFFIX, DOC_SUFFIXES

# Directories and files that are never part of a code base.
EXCLUDES = frozenset(
    """.git .hg .svn .venv venv env __pycache__ node_modules site-packages build dist .mypy_cache .pytest_cache .ruff_cache
    .tox .eggs .idea .vscode""".split()
)


#: what a walk is after
CODE, DOCS, ATTRIBUTES = "code", "docs", "attributes"
ATTRIBUTE_FILE = ".gitattributes"


def wanted(name: str, kind: str) -> bool:
    suffix = os.path.splitext(name)[1]
    if kind == ATTRIBUTES:
        return name == ATTRIBUTE_FILE
    return suffix.lower() in DOC_SUFFIXES if kind == DOCS else suffix == CODE_SUFFIX


def walk(root: str, docs: bool = False, excludes: frozenset[str] | set[str] = EXCLUDES, kind: str | None = None) -> Iterator[str]:
    """Paths below ``root``: a directory's files by name, then its sub-directories, last name first.

    Attribute files are looked for in excluded directories too: they are what says that those are foreign.
    """
    kind = kind or (DOCS if docs else CODE)
    pending = [""]
    while pending:
        below = pending.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, below)), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            hidden = e.name.startswith(".") and not (kind == ATTRIBUTES and e.name == ATTRIBUTE_FILE)
            if hidden or e.name in excludes and kind != ATTRIBUTES or e.is_symlink():
                continue
            path = f"{below}/{e.name}" if below else e.name
            if e.is_dir():
                pending.append(path)
            elif wanted(e.name, kind):
                yield path


def confined(root: str, path: str) -> str:
    """Real path of ``path`` below ``root``; leaving the root is an error."""
    base = os.path.realpath(root)
    target = os.path.realpath(os.path.join(base, path))
    if target != base and not target.startswith(base + os.sep):
        raise ValueError(f"outside of the root: {path}")
    return target


class _Group(InputPartition):
    def __init__(self, files: list[tuple[int, str]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options.get("path") or options["root"]
        self.kind = options.get("kind", DOCS if options.get("docs", "false").lower() == "true" else CODE)
        self.excludes = frozenset(options["excludes"].split(",")) if "excludes" in options else EXCLUDES
        self.group = int(options.get("filesPerTask", "200"))
        if not os.path.isdir(self.root):
            raise NotADirectoryError(self.root)

    def partitions(self) -> list[InputPartition]:
        files = list(enumerate(walk(self.root, excludes=self.excludes, kind=self.kind)))
        return [_Group(files[i : i + self.group]) for i in range(0, len(files), self.group)] or [_Group([])]

    def read(self, partition: _Group):
        for place, path in partition.files:
            try:
                with open(confined(self.root, path), "rb") as f:
                    yield place, path, f.read(), None
            except (OSError, ValueError) as e:
                yield place, path, None, str(e)


class TreeSource(DataSource):
    """``spark.read.format("corvane_tree").option("docs", "true").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "corvane_tree"

    def schema(self) -> str:
        return "place bigint, path string, content binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_tree(spark: SparkSession, root: str, docs: bool = False, excludes: frozenset[str] | set[str] = EXCLUDES, kind: str | None = None) -> DataFrame:
    """``place path content error`` of the code (or document, or attribute) files below ``root``."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("corvane_tree").option("kind", kind or (DOCS if docs else CODE))
    return reader.option("excludes", ",".join(sorted(excludes))).load(root)


def attribute_files(spark: SparkSession, root: str, project_id: str) -> DataFrame:
    """``project_id path text`` of the ``.gitattributes`` files of a tree, which no index holds."""
    found = read_tree(spark, root, kind=ATTRIBUTES).filter("content is not null")
    return found.select(F.lit(project_id).alias("project_id"), "path", F.col("content").cast("string").alias("text"))
