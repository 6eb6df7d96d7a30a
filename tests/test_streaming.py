import json

from corvane.streaming.incremental import chunk_table, current, follow


def put(folder, name, files):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"path": p, "content": c}) for p, c in files.items()))


def run(spark, tmp_path):
    q = follow(spark, str(tmp_path / "in"), str(tmp_path / "index"), str(tmp_path / "cp"))
    q.awaitTermination()
    return {(r.path, r.name): r.text for r in current(chunk_table(spark, str(tmp_path / "index"))).collect()}


def test_files_replace_their_chunks(spark, tmp_path):
    put(tmp_path / "in", "1.json", {"a.py": "def f():\n    return 1\n\ndef g():\n    return 2", "b.md": "# T\nx", "bad.py": "def ("})
    assert set(run(spark, tmp_path)) == {("a.py", "f"), ("a.py", "g"), ("b.md", "T")}
    put(tmp_path / "in", "2.json", {"a.py": "def f():\n    return 3"})
    got = run(spark, tmp_path)
    assert set(got) == {("a.py", "f"), ("b.md", "T")} and got[("a.py", "f")] == "def f():\n    return 3"
