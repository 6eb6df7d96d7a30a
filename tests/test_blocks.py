import random

import pytest

from corvane.operators import blocks, bm25, facets, fusion
from corvane.plans import catalog, search


@pytest.fixture(scope="module")
def indexed(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    some = lambda n: " ".join(rnd.choice(words) for _ in range(rnd.randrange(n)))
    c = [(o, rnd.choice(["a", "b", None]), rnd.choice(["class", "module"]), f"d{o % 7}/e/f{o % 40}.py", f"n{o % 9}", f"d{o % 7}/e/f{o % 40}.py:1", "", some(25)) for o in range(600)]
    c = spark.createDataFrame(c, "ord bigint, project_id string, kind string, path string, name string, location string, context string, text string")
    texts = [some(8) for _ in range(40)] * 2
    q = spark.createDataFrame([(f"q{i}", rnd.choice(["a", "b", "c", None]), t) for i, t in enumerate(texts)], "query_id string, scope string, text string")
    return search.Index(c), q


def records(spark):
    jvm, store = spark._jvm, spark._jsc.sc().statusStore()
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pairs_of_query_and_chunk_are_not_shuffled(spark):
    c = spark.createDataFrame([("p", i, ["common", f"c{i}"]) for i in range(400)], "scope string, ord bigint, tokens array<string>")
    q = spark.createDataFrame([(f"q{i}", "p", f"common x{i}") for i in range(300)], "query_id string, scope string, text string")
    before = records(spark)
    bm25.search(q, c, 5).collect()
    assert records(spark) - before < 20_000


@pytest.mark.parametrize("block", [4, 1000])
def test_fused_in_blocks_equals_fusion_of_rankings(indexed, block):
    index, q = indexed
    asked = bm25.weighted(bm25.asked(q), index.idf, index.lengths())
    k = 9
    bm = blocks.ranked(asked, index.rows, k, ("bm25",), block=block).select("query_id", "ord", "score", "rank")
    assert sorted(bm.collect()) == sorted(index.bm25(q, k).collect())
    want = fusion.reweigh(fusion.fuse({"bm25": bm, "vector": index.hashed(q, k)}, 12, {"bm25": 0.5}), index.weights())
    got = blocks.ranked(asked, index.rows, k, ("bm25", "vector"), fusion=blocks.Fusion(12, {"bm25": 0.5}), carry=("path", "location", "name"), block=block)
    key = lambda df: {(r.query_id, r.ord): (round(r.score, 12), r.rank, r.sources) for r in df.collect()}
    assert key(got) == key(want) and got.count() > 300
    paths = {r.ord: (r.project_id, r.path, r.name) for r in index.docs.collect()}
    assert all(paths[r.ord] == (r.scope, r.path, r.name) for r in got.collect())


def test_facets_of_a_pool_that_carries_places(indexed):
    index, q = indexed
    pool = search.candidates(q, index, search.SearchConfig(k=3, pool=80), ("location", "name"))
    carried = facets.facets(pool, index.docs).collect()
    assert carried and sorted(map(str, carried)) == sorted(map(str, facets.facets(pool.drop("scope", "location", "name"), index.docs).collect()))


def test_narrowed_questions_are_asked_once(spark):
    q = [("1", "a", "Where is ledger kept"), ("2", "a", "where  was it"), ("3", "b", "Where is it"), ("4", None, "where")]
    texts, askers = catalog._narrowed(spark.createDataFrame(q, "id string, project_id string, question string"))
    assert sorted((r.scope or "", r.query_id, r.text) for r in texts.collect()) == [("", "4", "where"), ("a", "1", "where"), ("b", "3", "where")]
    found = spark.createDataFrame([("1", "x.py"), ("3", "y.py")], "query_id string, path string")
    assert sorted((r.query_id, r.path) for r in catalog._for_askers(found, askers).collect()) == [("1", "x.py"), ("2", "x.py"), ("3", "y.py")]
