import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import bm25, chunks as C, citations, expand, facets, fusion, vector
from corvane.plans import catalog, search
from corvane.session import release


def chunk_table(spark, rows):
    """rows: (ord, path, kind, name, text)"""
    data = [(o, "p", k, path, name, f"{path}:1", 1, 1, "", text) for o, path, k, name, text in rows]
    return spark.createDataFrame(
        data, "ord bigint, project_id string, kind string, path string, name string, location string, start_line int, end_line int, context string, text string"
    )


def test_bm25_floor(spark):
    docs = [["get", "order", "id"], ["order", "create"], ["render", "page", "page"]]
    tokens = spark.createDataFrame([("p", i, d) for i, d in enumerate(docs)], "scope string, ord bigint, tokens array<string>")
    q = spark.createDataFrame([("order", "p", "order"), ("page", "p", "page"), ("order id", "p", "order id"), ("pp", "p", "page page")], "query_id string, scope string, text string")
    got = {(r.query_id, r.ord): r.score for r in bm25.search(q, tokens, 10).collect()}
    expected = {
        ("order", 0): 0.080604, ("order", 1): 0.095930, ("page", 2): 0.701563, ("order id", 0): 0.564226, ("order id", 1): 0.095930, ("pp", 2): 1.403126,
    }
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, abs=1e-5)


def test_bm25_scopes_and_empty(spark):
    tokens = spark.createDataFrame([("a", 1, ["x", "y"]), ("b", 2, ["x", "z"]), ("b", 3, ["q"]), ("b", 4, [])], "scope string, ord bigint, tokens array<string>")
    q = spark.createDataFrame([("1", "b", "x"), ("2", "c", "x"), ("3", "b", "")], "query_id string, scope string, text string")
    assert {(r.query_id, r.ord) for r in bm25.search(q, tokens, 5).collect()} == {("1", 2)}
    assert bm25.search(q, tokens.limit(0), 5).count() == 0


def ranking(spark, rows):
    return spark.createDataFrame(rows, "query_id string, ord bigint, score double, rank int")


def test_rrf(spark):
    a = ranking(spark, [("q", o, 1.0, i + 1) for i, o in enumerate((1, 2, 3))])
    b = ranking(spark, [("q", o, 1.0, i + 1) for i, o in enumerate((3, 1, 4))])
    got = {r.ord: r for r in fusion.fuse({"bm25": a, "vector": b}, 10).collect()}
    for o, s in {1: 0.032522475, 3: 0.032266458, 2: 0.016129032, 4: 0.015873016}.items():
        assert got[o].score == pytest.approx(s, abs=1e-9)
    assert [o for o, r in sorted(got.items(), key=lambda x: x[1].rank)] == [1, 3, 2, 4]
    assert got[1].sources == ["bm25", "vector"] and got[2].sources == ["bm25"] and got[4].sources == ["vector"]


def test_reweigh_is_stable(spark):
    a = ranking(spark, [("q", o, 1.0, o) for o in (1, 2, 3)])
    w = spark.createDataFrame([(1, 0.4), (2, 1.0), (3, 1.0)], "ord bigint, weight double")
    fused = fusion.fuse({"bm25": a}, 10)
    assert [r.ord for r in fusion.reweigh(fused, w).orderBy("rank").collect()] == [2, 3, 1]


def loop_expand(ranked, k, edges, modules):
    """Plain sequential model of head, unseen files, sibling files and referencing files."""
    out = [(o, p) for o, p in ranked[:k]]
    seen = {p for _, p in out}
    for o, p in ranked[k:60]:
        if len(out) - min(k, len(ranked)) >= 4:
            break
        if p not in seen:
            seen.add(p)
            out.append((o, p))
    dirs = {}
    for _, p in out:
        dirs.setdefault(p.rpartition("/")[0], set()).add(p)
    strong = {d for d, files in dirs.items() if len(files) >= 2}
    added = 0
    for o, p in ranked[:60]:
        if added < 2 and p not in seen and p.rpartition("/")[0] in strong:
            seen.add(p)
            out.append((o, p))
            added += 1
    added = 0
    for _, p in list(out):
        users = sorted(a for a, b in edges if b == p)
        if not 1 <= len(users) <= 5:
            continue
        for u in users:
            if u not in seen and added < 2:
                seen.add(u)
                out.append((modules[u], u))
                added += 1
    return out


def test_expansion_equals_loop(spark):
    rnd = random.Random(5)
    rows, edge_rows, expected = [], [], {}
    modules = {}
    paths = [f"d{i % 5}/f{i}.py" for i in range(24)]
    for i, p in enumerate(paths):
        modules[p] = 1000 + i
    for case in range(40):
        edges = {(a, b) for a, b in ((rnd.choice(paths), rnd.choice(paths)) for _ in range(rnd.randrange(40))) if a != b}
        ranked = [(case * 10_000 + i, rnd.choice(paths)) for i in range(rnd.randrange(70))]
        k = 4
        rows += [(f"q{case}", f"s{case}", o, p, 1.0, i + 1) for i, (o, p) in enumerate(ranked)]
        edge_rows += [(f"s{case}", a, b) for a, b in edges]
        expected[f"q{case}"] = [o for o, _ in loop_expand(ranked, k, edges, modules)]
    r = spark.createDataFrame(rows, "query_id string, scope string, ord bigint, path string, score double, rank int").cache()
    e = spark.createDataFrame(edge_rows, "scope string, importer string, target string")
    m = spark.createDataFrame([(f"s{c}", p, o) for c in range(40) for p, o in modules.items()], "scope string, path string, ord bigint")
    stages = [expand.head(r, 4), expand.unseen_files(r, 4)]
    stages.append(expand.sibling_files(r, expand.numbered(stages)))
    stages.append(expand.referencing_files(expand.numbered(stages), e, m))
    got = {}
    for x in expand.numbered(stages).orderBy("query_id", "pos").collect():
        got.setdefault(x.query_id, []).append(x.ord)
    assert got == {q: o for q, o in expected.items() if o}


def test_imported_files(spark):
    sel = spark.createDataFrame([("q", "s", 1, "a.py", 1.0, 0, 1, 1)], "query_id string, scope string, ord bigint, path string, score double, stage int, at int, pos int")
    edges = spark.createDataFrame([("s", "a.py", t) for t in ("b.py", "c.py", "hub.py", "shim.py")] + [("s", f"u{i}.py", "hub.py") for i in range(30)], "scope string, importer string, target string")
    mods = spark.createDataFrame([("s", p, i) for i, p in enumerate(("b.py", "c.py", "hub.py", "shim.py"))], "scope string, path string, ord bigint")
    close = spark.createDataFrame([("q", 0, 0.1), ("q", 1, 0.9)], "query_id string, ord bigint, cosine double")
    shims = spark.createDataFrame([("s", "shim.py")], "scope string, path string")
    got = expand.imported_files(sel, edges, mods, close, shims, 5).orderBy("at").collect()
    assert [r.path for r in got] == ["c.py", "b.py"]


def test_import_edges(spark):
    c = chunk_table(
        spark,
        [
            (1, "pkg/a.py", "module", "pkg.a", "from .b import x\nfrom ..top import y\nimport os"),
            (2, "pkg/b.py", "module", "pkg.b", "from .a import z\nfrom .missing import q"),
            (3, "top.py", "module", "top", "from pkg.a import x"),
        ],
    )
    assert {(r.importer, r.target) for r in expand.import_edges(c).collect()} == {("pkg/a.py", "pkg/b.py"), ("pkg/a.py", "top.py"), ("pkg/b.py", "pkg/a.py")}


def pool_of(spark, tree):
    rows, o = [], 0
    for d, n in tree.items():
        for i in range(n):
            o += 1
            rows.append((o, f"{d}/f{i}.py" if d else f"f{i}.py", "function", f"n{i % 4}", "x"))
    c = chunk_table(spark, rows)
    return c.select(F.lit("q").alias("query_id"), "ord", F.col("ord").cast("int").alias("rank")), c


def loop_facets(tree):
    """Recursive model of the tree cut: {directory: chunks of its own}."""
    total = sum(tree.values())
    under = {}
    for d, n in tree.items():
        parts = d.split("/") if d else []
        for i in range(1, len(parts) + 1):
            under["/".join(parts[:i])] = under.get("/".join(parts[:i]), 0) + n
    chosen = set()

    def visit(node):
        chosen.add(node)
        if under[node] > int(total * 0.25):
            for x in under:
                if x.rpartition("/")[0] == node:
                    visit(x)

    for root in {d.split("/")[0] for d in under}:
        visit(root)
    out = {}
    for d, n in tree.items():
        node = d
        while node and node not in chosen:
            node = node.rpartition("/")[0]
        if node:
            out[node] = out.get(node, 0) + n
    return {k: v for k, v in out.items() if v >= 3}


@pytest.mark.parametrize(
    "tree",
    [
        {"s/payment": 40, "s/payment/gateways": 30, "s/order": 30},
        {"s/a": 10, "s/a/deep": 5, "s/b": 85},
        {"": 4, "x": 2, "y/z": 9},
        {"a/b/c": 5, "a/b": 1, "a": 1, "d/e": 3, "d/f": 2},
    ],
)
def test_facets_equal_recursion(spark, tree):
    pool, c = pool_of(spark, tree)
    got = facets.facets(pool, c, limit=100)
    assert {r.directory: r.chunks for r in got.collect()} == loop_facets(tree)


def test_facet_label_and_query(spark):
    pool, c = pool_of(spark, {"s/pay": 3, "s/pay/Gate": 4, "s/pay/b": 1, "s/pay/c": 1, "s/pay/d": 1, "t": 90})
    f = facets.facets(pool, c).filter("directory = 's'").select(facets.label().alias("l"), facets.refined_query(F.lit("PAY")).alias("q")).first()
    assert f.l == "s · 10 parça — pay" and f.q == "PAY s"


def test_cosine_topk_against_brute_force(spark):
    rnd = random.Random(1)
    unit = lambda: (lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v])([rnd.gauss(0, 1) for _ in range(8)])
    base = {i: unit() for i in range(200)}
    base[200] = base[3]  # a tie
    v = spark.createDataFrame([(i, x) for i, x in base.items()] + [(999, [1.0])], "ord bigint, vec array<double>").repartition(3)
    q = spark.createDataFrame([(i, base[i]) for i in (3, 7)], "query_id bigint, qvec array<double>")
    got = {}
    for r in vector.cosine_topk(q, v, 5, block_bytes=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.ord)
    for i in (3, 7):
        s = sorted(((round(sum(a * b for a, b in zip(base[i], x)), 9), o) for o, x in base.items()), key=lambda x: (-x[0], x[1]))
        assert got[i] == [o for c, o in s if c > 0][:5]


def test_blake_buckets(spark):
    df = spark.createDataFrame([(t,) for t in ("order", "id", "charge", "payment", "şifre")], "term string")
    assert {r.term: r.bucket for r in vector.blake_buckets(df).collect()} == {"order": 477, "id": 473, "charge": 294, "payment": 428, "şifre": 437}


def test_search_modes(spark):
    assert search.resolve_mode(None, "hash") == "hybrid" and search.resolve_mode(None, "voyage") == "vector" and search.resolve_mode("bm25", "x") == "bm25"
    with pytest.raises(ValueError):
        search.resolve_mode("fuzzy", "hash")
    assert search.SearchConfig(k=8).pool_size == 60 and search.SearchConfig(k=8, file_slots=0).pool_size == 32


def test_end_to_end_and_rerank(spark):
    c = chunk_table(
        spark,
        [
            (1, "api/orders.py", "function", "create_order", "def create_order(cart): return save(cart)"),
            (2, "api/orders.py", "function", "charge_payment", "def charge_payment(card): gateway.charge(card)"),
            (3, "mail/send.py", "function", "send_invoice_email", "def send_invoice_email(to): smtp.send(to)"),
            (4, "mail/types.py", "class", "Invoice", "class Invoice:\n    total: int"),
        ],
    )
    q = spark.createDataFrame([("q", "p", "charge payment card order email")], "query_id string, scope string, text string")
    index = search.Index(c)
    hits = search.search(q, index, search.SearchConfig(k=2)).orderBy("pos").collect()
    assert hits[0].ord == 2 and hits[0].sources == ["bm25", "vector"]

    class Reverse:
        name = "reverse"

        def score(self, query, documents):
            return [float(i) for i in range(len(documents))]

    first = search.search(q, index, search.plain(search.SearchConfig(k=2)), Reverse()).orderBy("pos").collect()
    assert first[0].ord != 2 and first[0].sources[-1] == "rerank"


def test_chunk_reports(spark):
    c = chunk_table(
        spark,
        [(1, "a.py", "function", "f", "x"), (2, "tests/a.py", "function", "f", "ş"), (3, "test_b.py", "method", "g", "x"), (4, "r.md", "section", "R", "x")],
    )
    r = C.composition(c).first()
    assert (r.code, r.test, r.doc, r.test_pct) == (1, 2, 1, 50)
    s = C.language_signal(c).first()
    assert (s.turkish_pct, s.suggested_mode) == (25, "hybrid")
    assert C.language_signal(c.limit(0)).count() == 0
    t = C.text_length(c.limit(0)).first()
    assert (t.chunks, t.mean_chars) == (0, 0)
    assert [r.ord for r in C.grep(c, "F", 1).collect()] == [1]


def test_stored_vectors(spark):
    c = chunk_table(spark, [(i, f"d/f{i}.py", "function", f"n{i}", f"text number {i}") for i in range(6)]).withColumn("content_hash", F.concat(F.lit("h"), "ord"))
    kind = "provider string, content_hash string, vec array<float>"
    rows = [("real", f"h{i}", [float(i), 1.0, 2.0]) for i in range(6)] + [("real", "h1", None), ("real", "h2", [1.0]), ("real", "h3", [0.0] * 3), ("real", "h4", [float("nan")] * 3), ("other", "h0", [9.0])]
    q = spark.createDataFrame([("q", "p", "n4", [8.0, 1.0, 2.0]), ("zero", "p", "n", [0.0] * 3)], "query_id string, scope string, text string, vec array<float>")
    index = search.Index(c, "real", spark.createDataFrame(rows, kind))
    got = [r.ord for r in index.nearest(q, 3).orderBy("rank").collect()]
    assert got == [5, 4, 3]
    hits = search.search(q, index, search.SearchConfig(k=2, mode=None, import_slots=1)).filter("query_id = 'q'").orderBy("pos").collect()
    assert hits[0].ord == 5 and hits[0].sources == ["vector"]
    pairs = spark.createDataFrame([("q", 5), ("q", 0)], "query_id string, ord bigint")
    close = {r.ord: r.cosine for r in index.closeness(q, pairs).collect()}
    assert close[5] > close[0] > 0
    with pytest.raises(search.MissingVectors, match="1 chunks"):
        search.search(q, search.Index(c, "real", spark.createDataFrame([r for r in rows if r[1] != "h5"], kind)), search.SearchConfig(mode="vector"))
    with pytest.raises(search.MissingVectors):
        search.Index(c, "real")


def test_hashed_ranking_equals_join(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    c = chunk_table(spark, [(i, "a.py", "function", f"n{i}", " ".join(rnd.choices(words, k=rnd.randrange(0, 12)))) for i in range(120)])
    q = spark.createDataFrame([(f"q{i}", "p" if i % 5 else None, " ".join(rnd.choices(words, k=3))) for i in range(20)], "query_id string, scope string, text string")
    index = search.Index(c)
    got = {(r.query_id, r.ord): (r.rank, r.score) for r in vector.hashed_topk(index.query_vectors(q), index.vectors, 7, block_bytes=20_000).collect()}
    a = {r.query_id: dict(zip(r.buckets, r.weights)) for r in index.query_vectors(q).collect() if r.scope}
    b = {r.ord: dict(zip(r.buckets, r.weights)) for r in index.vectors.collect()}
    want = {}
    for i, x in a.items():
        s = sorted((-round(sum(w * y.get(k, 0.0) for k, w in x.items()), 9), o) for o, y in b.items())
        want |= {(i, o): (n + 1, -v) for n, (v, o) in enumerate(s[:7]) if v < 0}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    pairs = spark.createDataFrame(list(want), "query_id string, ord bigint")
    assert {(r.query_id, r.ord): r.cosine for r in index.closeness(q, pairs).collect()} == pytest.approx({k: v[1] for k, v in want.items()})


def test_index_follows_its_files(spark, tmp_path):
    rows = [(i, "p", f"a{i}.py", "function", "code", f"n{i}", "ctx", f"alpha beta{i}", f"h{i}", f"a{i}.py:1", None) for i in range(4)]
    kind = "ord long, project_id string, path string, kind string, source string, name string, context string, text string, content_hash string, location string, indexed_at timestamp"
    question = [("q#1", "alpha", ["a1.py"], None, None, "dev", "s", "p")]
    spark.createDataFrame(question, "id string, question string, expect_files array<string>, expect_symbols array<string>, note string, split string, set_name string, project_id string").write.parquet(f"{tmp_path}/questions.parquet")
    write = lambda n: spark.createDataFrame(rows[:n], kind).write.mode("overwrite").parquet(f"{tmp_path}/chunks.parquet")
    write(4)
    assert catalog.hash_embed_topk(spark, str(tmp_path)).count() == 4
    write(2)
    assert catalog.hash_embed_topk(spark, str(tmp_path)).count() == 2
    release(spark)
    assert catalog.hash_embed_topk(spark, str(tmp_path)).count() == 2
    assert {r.measure for r in catalog.facet_measure(spark, str(tmp_path)).collect()} == {"plain", "menu", "ceiling"}


def test_citations_stay_in_their_scope(spark):
    files = spark.createDataFrame([("p", "src/a.py", 10), ("q", "src/a.py", 99), ("q", "lib/b.py", 5), ("p", "x/__init__.py", 3), ("p", "y/__init__.py", 3)], "scope string, path string, n_lines int")
    answers = spark.createDataFrame(
        [(1, "p", "see src/a.py:50 and b.py:2 and __init__.py:1"), (2, "q", "see src/a.py:50, a.py:99, b.py:2"), (3, "p", "`y/__init__.py:1` then __init__.py:2"), (4, None, "src/a.py:1")],
        "answer_id bigint, scope string, text string",
    )
    got = {(r.answer_id, r.citation): (r.target, r.verified) for r in citations.verify(citations.answer_citations(answers), files, files).collect()}
    assert got[(1, "src/a.py:50")] == ("src/a.py", False) and got[(1, "b.py:2")] == (None, False) and got[(1, "__init__.py:1")] == (None, False)
    assert got[(2, "src/a.py:50")] == ("src/a.py", True) and got[(2, "a.py:99")] == ("src/a.py", True) and got[(2, "b.py:2")] == ("lib/b.py", True)
    assert got[(3, "__init__.py:2")] == ("y/__init__.py", True) and got[(4, "src/a.py:1")] == (None, False)
