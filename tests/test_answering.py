import json
import math
import threading

import pytest
from pyspark.sql import functions as F

from corvane.operators import citations
from corvane.plans import agent, answer, context, projects, providers, report, search
from corvane.schema import VECTORS
from corvane.sources.tables import VersionedTable, index_tree
from corvane.sources.tree import attribute_files, read_tree

SOURCE = {
    "api/orders.py": '"""Orders."""\nimport os\n\ndef create_order(cart):\n    """Save a cart."""\n    return cart\n',
    "api/pay.py": "def charge_payment(card):\n    return card\n",
    "docs/guide.md": "# Guide\n\nHow to pay.\n",
    "vendor/.gitattributes": "* linguist-vendored\n",
    ".gitattributes": "*.min.py linguist-generated\n",
    "bad.py": "def (:\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in SOURCE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text, encoding="utf-8")
    return str(root)


@pytest.fixture(scope="module")
def indexed(spark, tree, tmp_path_factory):
    chunks, errors = index_tree(spark, tree)
    out = f"{tmp_path_factory.mktemp('index')}/chunks"
    chunks.write.parquet(out)
    assert errors.count() == 1
    return out


def lines_of(spark, tree):
    files = read_tree(spark, tree).select(F.lit("index").alias("project_id"), "path", F.lit(1).alias("start_line"), F.col("content").cast("string").alias("text"))
    return citations.source_lines(files).withColumnRenamed("project_id", "scope")


def test_attribute_files(spark, tree):
    got = {r.path: r.text for r in attribute_files(spark, tree, "p").collect()}
    assert set(got) == {".gitattributes", "vendor/.gitattributes"} and got["vendor/.gitattributes"] == "* linguist-vendored\n"


def scripted():
    """A model that reads and searches, then answers with what it was told; local, so that it travels to the workers by value."""

    class Scripted:
        def turn(self, messages):
            told = [m for m in messages if m["role"] == "tool"]
            usage = {"input_tokens": 10, "output_tokens": None}
            question = messages[0]["content"].rpartition("Soru: ")[2]
            if question == "plain":
                return {"text": " done api/pay.py:1 ", "calls": [], "usage": usage, "stop": "end"}
            if question == "endless":
                return {"text": "again", "calls": [{"tool": "search_symbol", "input": {"query": "zzz"}}], "usage": usage, "stop": "tool"}
            if not told:
                return {
                    "text": "", "usage": usage, "stop": "tool",
                    "calls": [
                        {"tool": "read_file", "input": {"path": "api/pay.py", "start_line": 2}}, {"tool": "read_file", "input": {"path": "no.py"}},
                        {"tool": "search_symbol", "input": {"query": "create order", "limit": 1}}, {"tool": "other", "input": {}}, {"tool": "read_file", "input": {"path": "api/pay.py", "start_line": 9}},
                        {"tool": "read_file", "input": {"path": "api/orders.py", "start_line": 1, "end_line": 2}},
                    ],
                }
            return {"text": json.dumps(told[0]["content"]), "calls": [], "usage": usage, "stop": "end"}

    return Scripted()


def test_tool_loop(spark, tree, indexed):
    chunks = spark.read.parquet(indexed).withColumn("project_id", F.lit("index"))
    q = spark.createDataFrame([("a", "index", "plain"), ("b", "index", "tools"), ("c", "index", "endless")], "query_id string, scope string, text string")
    got = {r.answer_id: r for r in agent.ask_with_tools(q, search.Index(chunks), chunks, lines_of(spark, tree), scripted(), rounds=3).collect()}
    assert got["a"].text == "done api/pay.py:1" and got["a"].tool_calls == "[]" and json.loads(got["a"].usage)["input_tokens"] == 10
    told = json.loads(got["b"].text)
    assert told[0] == "api/pay.py (2-2 / 2 satır)\n    2 |     return card"
    assert told[1] == "Hata: dosya bulunamadı: no.py" and told[4] == "Hata: api/pay.py sadece 2 satır."
    assert "create_order" in told[2] and "    4 | def create_order(cart):" in told[2] and told[3] == "unknown tool: other"
    assert told[5].endswith("... (4 satır daha, api/orders.py:3 ile devam)")
    assert json.loads(got["b"].usage)["input_tokens"] == 20 and len(json.loads(got["b"].tool_calls)) == 6
    assert got["c"].text == "again" and len(json.loads(got["c"].tool_calls)) == 3


def test_services():
    calls, slept = [], []

    def flaky(texts, purpose):
        calls.append((len(texts), purpose, texts[0]))
        if len(calls) == 1:
            raise TimeoutError
        return [[3.0, 4.0] for _ in texts]

    s = providers.ServiceEmbedder("stub", flaky, ("doc: ", "query: "), batch=2, transient=(TimeoutError,), wait=0)
    assert s.embed(["a", "b", "c"]) == [[0.6, 0.8]] * 3 and s.embed_queries(["x"]) == [[0.6, 0.8]]
    assert calls == [(2, "document", "doc: a"), (2, "document", "doc: a"), (1, "document", "doc: c"), (1, "query", "query: x")]
    with pytest.raises(TimeoutError):
        providers.retrying(lambda: (_ for _ in ()).throw(TimeoutError()), TimeoutError, 3, 5, slept.append)
    assert slept == [5, 10] and providers.unit([0.0]) == [0.0]
    assert providers.task_prefixes("nomic-embed-text:v1")[0] == "search_document: " and providers.task_prefixes("x") == ("", "")
    assert providers.reranker("none") is None and providers.ServiceReranker("r", lambda q, d: [1.0] * len(d)).score("q", []) == []
    for f in (providers.embedder, providers.reranker):
        with pytest.raises(ValueError):
            f("unheard of")
    assert "key" in providers.error_hint(RuntimeError("authentication_error")) and providers.error_hint(RuntimeError("x")) is None


def test_query_vectors_are_kept(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/q", providers.QUERY_VECTORS, ["provider", "query_key"])
    s = providers.ServiceEmbedder("stub", lambda texts, purpose: [[float(len(t)), 0.0] for t in texts])
    q = spark.createDataFrame([("1", "abc"), ("2", "abc"), ("3", "de"), ("4", None)], "query_id string, text string")
    got = {r.query_id: r.vec for r in providers.with_query_vectors(q, s, table).collect()}
    assert got == {"1": [1.0, 0.0], "2": [1.0, 0.0], "3": [1.0, 0.0], "4": None} and table.read().count() == 2
    broken = providers.ServiceEmbedder("stub", lambda texts, purpose: 1 / 0)
    assert providers.with_query_vectors(q, broken, table).filter("vec is not null").count() == 3


def test_two_writers_lose_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    write = lambda n: VersionedTable(spark, path, VECTORS, ["provider", "content_hash"]).upsert(spark.createDataFrame([("p", f"h{n}", [1.0])], VECTORS))
    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    table = VersionedTable(spark, path, VECTORS, ["provider", "content_hash"])
    assert {r.content_hash for r in table.read().collect()} == {"h0", "h1", "h2", "h3"} and len(table._states()) == 2


def test_contextualize(spark, tmp_path):
    chunks = spark.createDataFrame(
        [("p", "a.py", "f", 1, 2, "def f()", "ctx", "h1", None), ("p", "a.py", "g", 3, 4, "def g()", "ctx", "h2", None), ("p", "gone.py", "x", 1, 1, "x", "ctx", "h3", None), ("p", "b.py", "fatal", 1, 1, "x", "ctx", "h4", None), ("p", "b.py", "after", 2, 2, "x", "ctx", "h5", None)],
        "project_id string, path string, name string, start_line int, end_line int, text string, context string, content_hash string, llm_context string",
    )
    files = spark.createDataFrame([("p", "a.py", "x" * 70_000), ("p", "b.py", "text")], "project_id string, path string, content string")

    def call(text, chunk):
        if chunk["name"] == "fatal":
            raise context.Fatal("no credit")
        if chunk["name"] == "g":
            raise TimeoutError
        return f"about {chunk['name']} in {len(text)}"

    known = context.sentence_table(spark, f"{tmp_path}/s")
    out, failures = context.contextualize(chunks, files, context.Describer("m", call, wait=0), known)
    got = {r.name: r for r in out.collect()}
    assert got["f"].llm_context == "about f in 60000" and got["f"].context == "ctx\nabout f in 60000" and got["f"].content_hash != "h1"
    assert got["g"].llm_context is None and got["x"].content_hash == "h3"
    assert {r.content_hash: r.error for r in failures.collect()} == {"h2": "a.py: TimeoutError", "h4": "stopped: no credit", "h5": "stopped: no credit"}
    again, failures = context.contextualize(chunks, files, context.Describer("m", lambda t, c: 1 / 0 if c["name"] == "f" else "new", wait=0), known)
    assert {r.name: r.llm_context for r in again.collect()} == {"f": "about f in 60000", "g": "new", "x": None, "fatal": "new", "after": "new"} and failures.count() == 0
    with pytest.raises(ValueError):
        context.Describer("m", call, "xx")


def test_registry(tmp_path):
    path = tmp_path / "deep" / "projects.json"
    assert projects.load_registry(path) == []
    projects.register(path, projects.Project("a", "A", "/a", "a.idx"))
    projects.register(path, projects.Project("b", "B", "/b", "b.idx"))
    projects.register(path, projects.Project("a", "A2", "/a", "a.idx", checks={"smoke_rate": 0.5}))
    assert [(p.id, p.name) for p in projects.load_registry(path)] == [("b", "B"), ("a", "A2")]
    path.write_text("{broken")
    assert projects.load_registry(path) == []


def test_scan_tools_and_jobs(spark, tree, tmp_path):
    vectors = spark.createDataFrame([], VECTORS)
    seen = projects.scan_preview(spark, tree, f"{tmp_path}/idx", vectors, "real")
    assert seen["chunks"] == 4 and seen["failed"] == 1 and seen["composition"]["doc"] == 1 and seen["estimate"]["missing"] == 4 and seen["language"]["turkish_pct"] == 0
    with pytest.raises(ValueError):
        projects.scan_preview(spark, f"{tree}/none", f"{tmp_path}/x", vectors, "real")
    tools = projects.Tools(lambda: spark.read.parquet(f"{tmp_path}/idx"), "idx")
    assert "api/pay.py:1  [function] charge_payment" in tools.search_code("charge payment", 1)
    assert tools.search_code("qqqq") == "'qqqq' için sonuç yok."
    assert tools.read_chunk("api/pay.py:1").endswith("return card") and "search_code" in tools.read_chunk("x:1")
    assert "Parça  : 4 (3 dosya)" in tools.index_status() and "function: 2" in tools.index_status()
    gone = projects.Tools(lambda: spark.read.parquet(f"{tmp_path}/nowhere"), "nowhere")
    assert gone.index_status() == gone.search_code("x") == gone.read_chunk("x") == "no index at nowhere"
    jobs = projects.Jobs(spark, keep=2)
    made = [jobs.start("count", lambda job: spark.range(5).count()), jobs.start("fail", lambda job: 1 / 0)]
    while any(j.ended is None for j in made):
        threading.Event().wait(0.05)
    assert (made[0].state, made[0].result) == ("done", 5) and made[1].state == "failed" and "ZeroDivisionError" in made[1].error
    jobs.start("more", lambda job: None)
    assert jobs.get(made[0].id) is None and jobs.get(made[1].id) is made[1]


def test_report_and_run(spark, tmp_path):
    questions = spark.createDataFrame([("q1", "where?", ["a.py"]), ("q2", "how?", ["b.py", "c.py"])], "id string, question string, expect_files array<string>")
    results = spark.createDataFrame(
        [("q1", "dev", "s", 1, 1, 2, None, True, 1.0), ("q2", "dev", "s", 2, 0, None, False, False, 0.0)],
        "question_id string, split string, set_name string, expected int, returned int, rank int, symbols_found boolean, found boolean, coverage double",
    )
    answers = spark.createDataFrame([("q1", ["a.py:1"], [], 2), ("q2", ["z.py:1"], ["z.py:1"], 0)], "question_id string, citations array<string>, unverified array<string>, tools int")
    text = report.report_text("run", questions, results, answers)
    for part in ("Koşu: run", "  ✓ q1: sıra 2", "  ✗ q2: bulunamadı  (sembol eksik)", "recall@k     : 50%", "n=2)", "MRR          : 0.250", "✓ q1: kapsam 100%, 2 tool", "⚠ 1 doğrulanamayan", "doğruluk       : 50%", "uydurma referans: 1", "  q2: how?\n    beklenen: b.py, c.py"):
        assert part in text, part
    assert report.report_text("empty", questions, results.limit(0)) == "Koşu: empty\n"
    path = report.save_run(tmp_path, "run", {"retrieval": results})
    assert path.name.endswith("-run.json") and json.loads(path.read_text())["retrieval"][1]["rank"] is None


def test_command_line(spark, tree, tmp_path, capsys, monkeypatch):
    from corvane import __main__ as cli

    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.setitem(providers.EMBEDDERS, "stub", lambda model: providers.ServiceEmbedder("stub", lambda texts, purpose: [[1.0, float("pay" in t), float("order" in t)] for t in texts]))
    monkeypatch.setattr(cli, "_named", lambda place: scripted())
    monkeypatch.chdir(tmp_path)
    idx = f"{tmp_path}/i"
    assert cli.main(["index", tree, idx]) == 0 and "bad.py" in capsys.readouterr().out
    cli.main(["embed", idx, "--provider", "stub", "--vectors", f"{tmp_path}/v"])
    assert "4 vectors of stub" in capsys.readouterr().out
    cli.main(["search", idx, "pay", "-k", "1", "--provider", "stub", "--vectors", f"{tmp_path}/v"])
    assert "pay" in capsys.readouterr().out
    cli.main(["search", idx, "charge", "--facets"])
    cli.main(["ask", idx, "plain", "--repo", tree, "--answerer", "x:y"])
    assert "done api/pay.py:1" in capsys.readouterr().out
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"id": "q", "question": "charge payment", "expect_files": ["api/pay.py"]}]}))
    cli.main(["eval", idx, f"{tmp_path}/q.json", "--label", "try"])
    out = capsys.readouterr().out
    assert "✓ q: sıra 1" in out and "-try.json" in out
    cli.main(["stats", idx])
    cli.main(["status", idx])
    assert "Parça  : 4" in capsys.readouterr().out


def test_embed_missing_with_service(spark):
    c = spark.createDataFrame([("h1", "a", "b"), ("h1", "a", "b"), ("h2", None, "c")], "content_hash string, context string, text string")
    s = providers.ServiceEmbedder("stub", lambda texts, purpose: [[1.0, 1.0] for _ in texts])
    got = answer.embed_missing(c.select("content_hash").distinct(), c, s).collect()
    assert {r.content_hash for r in got} == {"h1", "h2"} and math.isclose(got[0].vec[0], 0.7071, abs_tol=1e-3)
