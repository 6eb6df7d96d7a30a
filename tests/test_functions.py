import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.stats import mean_interval, wilson


def value(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], list(row)) if row else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("getUserOrders", ["get", "user", "orders"]),
        ("order_id", ["order", "id"]),
        ("services.payment.charge", ["services", "payment", "charge"]),
        ("Varsayılan zaman aşımı süresi", ["varsayılan", "zaman", "aşımı", "süresi"]),
        ("HTTPServer2X", ["httpserver2", "x"]),
        ("", []),
    ],
)
def test_tokenize(spark, text, expected):
    assert value(spark, T.tokenize(F.col("t")), t=text) == expected


def test_lines_match_splitlines(spark):
    for t in ("a\nb\n", "a\r\nb", "", "\n", "x\x0cy\x85z\u2028w", "a\n\n"):
        expected = t.splitlines()
        assert value(spark, T.lines(F.col("t")), t=t) == expected


def test_paths(spark):
    assert value(spark, T.directory(F.col("p")), p="a/b/c.py") == "a/b"
    assert value(spark, T.directory(F.col("p")), p="c.py") == ""
    assert value(spark, T.facet_directory(F.col("p")), p="setup.py:1") == "."
    assert value(spark, T.ancestors(F.col("p")), p="a/b/c") == ["a", "a/b", "a/b/c"]
    assert value(spark, T.ancestors(F.col("p")), p=".") == []
    assert value(spark, T.normal_path(F.col("p")), p=".\\a\\b.py") == "a/b.py"


@pytest.mark.parametrize(
    "importer, dots, name, expected",
    [
        ("lib/env/_p.py", "..", "_retry", "lib/_retry.py"),
        ("lib/env/_p.py", ".", "a.b", "lib/env/a/b.py"),
        ("lib/env/_p.py", ".....", "x", "x.py"),
        ("lib/env/_p.py", ".", "", "lib/env.py"),
        ("p.py", ".", "", None),
    ],
)
def test_relative_imports(spark, importer, dots, name, expected):
    assert value(spark, T.resolve_relative_import(F.col("i"), F.col("d"), F.col("n")), i=importer, d=dots, n=name) == expected


def test_slug(spark):
    assert value(spark, T.slug(F.col("n")), n="My Repo!") == "my-repo"
    assert value(spark, T.slug(F.col("n")), n="...") == "proje"


def test_citations(spark):
    t = "`api/orders.py:88`'de başlar, sonra services\\payment.py:145'te ve api/orders.py:88"
    assert value(spark, T.citations(F.col("t")), t=t) == ["api/orders.py:88", "services/payment.py:145"]
    assert value(spark, T.cited_files(T.citations(F.col("t"))), t=t) == ["api/orders.py", "services/payment.py"]


def test_narrow(spark):
    assert value(spark, T.narrow(F.col("q")), q="İndirim hangi dosyada hesaplanıyor?") == "indirim"
    assert value(spark, T.narrow(F.col("q"), 2), q="Bu sipariş nasıl iptal edilir") == "sipariş iptal"


def test_weight_and_reexport(spark):
    w = T.chunk_weight(F.col("k"), F.col("t"), demote_reexports=True)
    assert value(spark, w, k="class", t="class A:\n    x: int") == 0.4
    assert value(spark, w, k="class", t="class A:\n    def f(self)") == 1.0
    assert value(spark, w, k="module", t="from a import B\n\n__all__ = ['B']\nC = B") == 0.4
    assert value(spark, w, k="module", t="LIMIT = 2") == 1.0


def test_rendering(spark):
    assert value(spark, T.numbered(F.col("t"), F.col("s")), t="a\nb", s=99999) == "99999 | a\n100000 | b"
    assert value(spark, T.snippet(F.col("t"), 2), t="a\nb\nc") == "a\nb\n... (1 more lines)"
    assert value(spark, T.content_hash(F.col("c"), F.col("t")), c="ctx", t="text") == "c63ccbc4db56b550"
    cost = T.token_cost(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    assert value(spark, cost, a=1_000_000, b=0, c=0, d=1_000_000) == pytest.approx(6.0)


@pytest.mark.parametrize(
    "s, n, low, high",
    [(14, 14, 0.784683, 1), (13, 14, 0.685307, 0.987278), (25, 26, 0.811068, 0.993178), (37, 40, 0.801355, 0.974164), (0, 5, 0, 0.434491), (0, 0, 0, 0)],
)
def test_wilson(spark, s, n, low, high):
    a, b = wilson(F.col("s"), F.col("n"))
    row = spark.createDataFrame([(s, n)], "s int, n int").select(a.alias("a"), b.alias("b")).first()
    assert (row.a, row.b) == (pytest.approx(low, abs=1e-6), pytest.approx(high, abs=1e-6))


def test_mean_interval(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 0.5, 1.0, 0.5, 1.0)], "x double")
    a = df.agg(F.avg("x").alias("m"), F.var_samp("x").alias("v"), F.count("*").alias("n"))
    low, high = mean_interval(F.col("m"), F.col("v"), F.col("n"))
    row = a.select(low.alias("a"), high.alias("b")).first()
    assert (row.a, row.b) == (pytest.approx(0.55995, abs=1e-5), 1)


def test_stage_and_release(spark):
    import os

    from corvane.session import _application_folder, release, stage

    df = stage(spark.createDataFrame([(1, "a")], "x int, y string"), "t")
    assert [tuple(r) for r in df.collect()] == [(1, "a")]
    folder = _application_folder(spark)
    assert any(n.startswith("t-") for n in os.listdir(folder))
    release(spark)
    assert not os.path.exists(folder)
