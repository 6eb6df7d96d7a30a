import os
import random

import pytest

from corvane.operators.extract import chunks_of, errors_of, extract, markdown_pieces, split_section
from corvane.sources.tables import VersionedTable, index_tree, read_jsonl, read_questions, write_jsonl
from corvane.sources.tree import confined, walk

MODULE = '''"""Orders.

More."""
import os
from .b import x

LIMIT = 3
"""Most orders."""

@deco
def create(a: int, *, b=1) -> int:
    """Makes one."""
    def inner():
        pass
    return a


class Box(Base, metaclass=M):
    """Holds."""

    size: int = 1
    """How many."""

    @property
    def full(self) -> bool:
        return True

    async def wait(self): ...
'''


def run(spark, files):
    return extract(spark.createDataFrame([(p, t.encode()) for p, t in files.items()], "path string, content binary"))


def test_python_chunks(spark):
    rows = chunks_of(run(spark, {"pkg/o.py": MODULE})).orderBy("part").collect()
    assert [(r.kind, r.name) for r in rows] == [
        ("module", "pkg.o"), ("function", "create"), ("class", "Box"), ("method", "Box.full"), ("method", "Box.wait"),
    ]
    module, create, box, full, wait = rows
    assert module.text == '"""Orders.\n\nMore."""\nimport os\nfrom .b import x\nLIMIT = 3\n"""Most orders."""'
    assert (module.start_line, module.end_line) == (1, 8)
    assert create.signature == "def create(a: int, *, b=1) -> int:" and create.start_line == 10 and create.docstring == "Makes one."
    assert create.context == "pkg/o.py > create (function)\nModül: Orders."
    assert box.text.splitlines() == [
        "class Box(Base, metaclass=M):", '    """Holds."""', "    # alanlar:", "    size: int = 1", '    """How many."""', "    # metotlar:",
        "    def full(self) -> bool:", "    async def wait(self):",
    ]
    assert full.parent == "Box" and full.start_line == 24 and wait.signature == "async def wait(self):"
    assert full.location == "pkg/o.py:24"


def test_bad_files_are_errors(spark):
    out = run(spark, {"bad.py": "def (:\n", "nul.py": "x = '\0'", "empty.py": "", "a.go": "package a", "ok.md": "# T\ntext"})
    assert {r.path for r in errors_of(out).collect()} == {"bad.py", "nul.py"}
    assert [(r.path, r.name) for r in chunks_of(out).collect()] == [("ok.md", "T")]


def test_long_assignment_is_cut(spark):
    r = chunks_of(run(spark, {"a.py": f"X = {list(range(400))}"})).first()
    assert r.text.endswith("(kısaltıldı)") and len(r.text) < 340


def test_markdown_sections():
    doc = "intro\n\n# A\ntext\n## B\n```\n# not a heading\n```\n### C\nx\n# D\n\n"
    got = [(p.name, p.start, p.parent) for p in markdown_pieces(doc, "r.md")]
    assert got == [("(başlıksız)", 1, None), ("A", 3, None), ("A > B", 5, "A"), ("A > B > C", 9, "A > B"), ("D", 11, None)]
    assert markdown_pieces("", "r.md") == [] and markdown_pieces("\n \n", "r.md") == []


def test_split_section_limits():
    rnd = random.Random(2)
    for _ in range(50):
        lines = ["x" * rnd.randrange(0, 400) for _ in range(rnd.randrange(1, 40))]
        parts = split_section("\n".join(lines), 10)
        for text, start in parts:
            rows = text.splitlines() or [""]
            assert lines[start - 10 : start - 10 + len(rows)] == rows
            assert sum(len(r) + 1 for r in rows[:-1]) + len(rows[-1]) <= 1500 + 400 or len(rows) == 1
    long = "y" * 2000
    assert split_section(long, 1) == [(long, 1)]


@pytest.fixture
def tree(tmp_path):
    for p, t in {
        "_base.py": "X = 1", "pkg/__init__.py": "Y = 1", "pkg/_sub/y.py": "def f(): pass", "zzz/a.py": "A = 1", "README.md": "# Hi\nthere", "docs/x.TXT": "plain",
        ".hidden/h.py": "H = 1", "build/b.py": "B = 1", "node_modules/n.py": "N = 1", "broken.py": "def (",
    }.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t)
    os.symlink(tmp_path / "_base.py", tmp_path / "link.py")
    return tmp_path


def test_walk_order(tree):
    assert list(walk(str(tree))) == ["_base.py", "broken.py", "zzz/a.py", "pkg/__init__.py", "pkg/_sub/y.py"]
    assert list(walk(str(tree), docs=True)) == ["README.md", "docs/x.TXT"]


def test_confined(tree):
    assert confined(str(tree), "pkg/__init__.py").endswith("__init__.py")
    for bad in ("../x", "../../etc/passwd", "/etc/passwd", "pkg/../../../etc/hosts"):
        with pytest.raises(ValueError):
            confined(str(tree), bad)


def test_index_tree_and_jsonl(spark, tree, tmp_path):
    chunks, errors = index_tree(spark, str(tree))
    rows = chunks.orderBy("ord").collect()
    assert [r.ord for r in rows] == list(range(len(rows)))
    assert [r.path for r in rows] == ["_base.py", "zzz/a.py", "pkg/__init__.py", "pkg/_sub/y.py", "README.md", "docs/x.TXT"]
    assert [r.path for r in errors.collect()] == ["broken.py"]
    write_jsonl(chunks, str(tmp_path / "out"))
    assert read_jsonl(spark, str(tmp_path / "out")).count() == len(rows)


def test_questions(spark, tmp_path):
    f = tmp_path / "q.json"
    f.write_text('{"repo": "r", "questions": [{"id": "1", "question": "a", "expect_files": ["x"]}, {"id": "2", "question": "b", "expect_files": ["y"], "split": "test"}]}')
    assert {(r.id, r.split) for r in read_questions(spark, str(f)).collect()} == {("1", "dev"), ("2", "test")}
    assert read_questions(spark, str(f), "test").count() == 1
    with pytest.raises(ValueError):
        read_questions(spark, str(f), "holdout")
    f.write_text('{"questions": [{"id": "1", "question": "a"}]}')
    with pytest.raises(ValueError):
        read_questions(spark, str(f))
    f.write_text('{"questions": [{"id": "1", "question": "a", "expect_files": ["x"]}, {"id": "1", "question": "a", "expect_files": ["x"]}]}')
    with pytest.raises(ValueError):
        read_questions(spark, str(f))


def test_versioned_table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "v"), "k string, v int", ["k"])
    assert t.read().count() == 0
    t.upsert(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"))
    t.upsert(spark.createDataFrame([("b", 2), ("b", 3), ("c", 1)], "k string, v int"))
    assert {(r.k, r.v) for r in t.read().collect()} == {("a", 1), ("b", 3), ("c", 1)}
