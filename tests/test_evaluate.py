from pyspark.sql import functions as F

from corvane.operators import citations, evaluate
from corvane.plans import answer

Q = "id string, question string, expect_files array<string>, expect_symbols array<string>, note string, split string, set_name string, project_id string"


def questions(spark, rows):
    return evaluate.clean_questions(spark.createDataFrame(rows, Q))


def test_clean_questions(spark):
    q = questions(
        spark,
        [
            ("1", "a", ["./x/y.py", "x\\y.py", None, ""], [""], None, " Test ", "s", "p"),
            ("1", "a", ["./x/y.py", "x\\y.py", None, ""], [""], None, " Test ", "s", "p"),
            ("2", "b", ["z.py"], None, None, None, "s", "p"),
            ("3", "c", [], None, None, "dev", "s", "p"),
            (None, "d", ["z.py"], None, None, "dev", "s", "p"),
        ],
    )
    assert {(r.id, r.split, tuple(r.expect_files), tuple(r.expect_symbols)) for r in q.collect()} == {("1", "test", ("x/y.py",), ()), ("2", "dev", ("z.py",), ())}


def test_metrics(spark):
    q = questions(
        spark,
        [
            ("1", "a", ["a.py"], ["f"], None, "dev", "s", "p"),
            ("2", "b", ["b.py", "c.py"], ["K.g", "h"], None, "dev", "s", "p"),
            ("3", "c", ["d.py"], None, None, "dev", "s", "p"),
        ],
    )
    hits = spark.createDataFrame([("1", 1, 10, "a.py"), ("2", 4, 11, "b.py"), ("2", 5, 12, "x.py")], "query_id string, pos int, ord bigint, path string")
    names = spark.createDataFrame([(10, "m.f"), (11, "K.g"), (12, "hh")], "ord bigint, name string")
    per = evaluate.per_question(q, hits, names)
    got = {r.question_id: (r.found, r.rank, r.coverage, r.symbols_found) for r in per.collect()}
    assert got == {"1": (True, 1, 1.0, True), "2": (True, 4, 0.5, False), "3": (False, None, 0.0, None)}
    r = evaluate.report(per).first()
    assert (r.n, r.recall, r.mrr, r.coverage, r.symbol_recall) == (3, 0.6667, round((1 + 0.25) / 3, 4), 0.5, 0.5)
    none = evaluate.report(per.filter("question_id = '3'")).first()
    assert none.symbol_recall is None and none.recall == 0.0
    empty = evaluate.report(per.limit(0)).first()
    assert (empty.n, empty.recall, empty.mrr, empty.symbol_recall) == (0, 0.0, 0.0, None)


def test_smoke_sample(spark):
    rows = [(i, "p", "function", f"f{i}", f"a.py:{i:03d}") for i in range(60)] + [(60, "p", "function", "f0", "b.py:1"), (61, "p", "module", "m", "m.py:1")]
    c = spark.createDataFrame(rows, "ord bigint, project_id string, kind string, name string, location string")
    w = c.select("ord", F.when(F.col("ord") == 5, 0.4).otherwise(1.0).alias("weight"))
    got = evaluate.smoke_sample(c, w).orderBy("location").collect()
    unique = [i for i in range(1, 60) if i != 5]
    assert [r.ord for r in got] == unique[:: len(unique) // 25][:25]
    report = evaluate.smoke_report(
        evaluate.smoke_sample(c, w), spark.createDataFrame([(str(got[0].ord), got[0].location), (str(got[1].ord), "else")], "query_id string, location string")
    ).first()
    assert (report.total, report.found, report.rate) == (25, 1, 0.04)


def test_verification(spark):
    files = spark.createDataFrame([("api/orders.py", 10), ("lib/orders.py", 5), ("README.md", 3)], "path string, n_lines int")
    indexed = files.filter("path <> 'README.md'")
    texts = {
        "exact": "api/orders.py:4 and api/orders.py:11 and README.md:3",
        "ambiguous": "orders.py:4",
        "spelled": "lib/orders.py:1, later orders.py:4",
        "unknown": "nope.py:1 orders.py:0",
        "none": "no reference",
    }
    a = spark.createDataFrame(list(texts.items()), "answer_id string, text string")
    got = {r.question_id: (r.citations, r.unverified) for r in answer.checked(a, files, indexed).collect()}
    assert got["exact"] == (["api/orders.py:4", "api/orders.py:11", "README.md:3"], ["api/orders.py:11"])
    assert got["ambiguous"] == (["orders.py:4"], ["orders.py:4"])
    assert got["spelled"] == (["lib/orders.py:1", "orders.py:4"], [])
    assert got["unknown"][1] == ["nope.py:1", "orders.py:0"]
    assert got["none"] == ([], [])


def test_answer_report(spark):
    q = questions(spark, [(str(i), "q", ["a.py", "b.py"] if i == 1 else ["a.py"], None, None, "dev", "s", "p") for i in range(3)])
    a = spark.createDataFrame(
        [("0", ["a.py:1"], []), ("1", ["a.py:1", "x.py:2"], ["x.py:2", "y.py:1"])], "question_id string, citations array<string>, unverified array<string>"
    )
    r = evaluate.answer_report(q, a).first()
    assert (r.n, r.accuracy, r.file_coverage, r.citations_per_answer, r.unverified) == (3, 0.6667, 0.5, 1.0, 2)


def test_windows_and_prompts(spark):
    c = spark.createDataFrame(
        [(1, "p", "function", "a.py", "f", "a.py:3", 3, "x\ny\nz")], "ord bigint, project_id string, kind string, path string, name string, location string, start_line int, text string"
    )
    lines = citations.source_lines(c)
    assert [(r.line_no, r.text) for r in citations.read_lines(lines, "a.py", 4, 99).collect()] == [(4, "y"), (5, "z")]
    at = spark.createDataFrame([("p", "a.py", 4)], "project_id string, path string, line int")
    assert sorted(r.line_no for r in citations.source_window(at, lines, 1, 0).collect()) == [3, 4]
    q = spark.createDataFrame([("q", "why?"), ("r", "how?")], "query_id string, text string")
    hits = spark.createDataFrame([("q", 1, 1)], "query_id string, pos int, ord bigint")

    class Echo:
        def answer(self, prompt):
            return prompt

    got = {r.answer_id: r.text for r in answer.ask(q, hits, c, Echo()).collect()}
    assert got["q"] == "Aramayla bulunan parçalar:\n\n--- a.py:3  [function] f\n    3 | x\n    4 | y\n    5 | z\n\nSoru: why?"
    assert got["r"].startswith("(Arama sonuç vermedi.")


def test_embedding_and_enrichment(spark):
    c = spark.createDataFrame(
        [(1, "ctx", "text", "c63ccbc4db56b550", None), (2, "ctx", "text", "c63ccbc4db56b550", None), (3, "o", "t", "h3", None)],
        "ord bigint, context string, text string, content_hash string, llm_context string",
    )

    class Ones:
        name = "ones"

        def embed(self, texts):
            return [[float(len(t))] for t in texts]

    v = answer.embed_missing(c.select("content_hash").distinct(), c, Ones())
    assert {(r.content_hash, r.vec[0]) for r in v.collect()} == {("c63ccbc4db56b550", 9.0), ("h3", 4.0)}
    s = spark.createDataFrame([("h3", "Says it.")], "content_hash string, sentence string")
    got = {r.ord: (r.context, r.llm_context) for r in answer.enrich(c, s).collect()}
    assert got == {1: ("ctx", None), 2: ("ctx", None), 3: ("o\nSays it.", "Says it.")}
