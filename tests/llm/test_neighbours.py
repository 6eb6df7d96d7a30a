import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corvane.llm import neighbours
from corvane.llm.neighbours import CentroidGraph, balanced_kmeans, fit_centroids, nearest
from corvane.llm.queries import p4_found

SCHEMA = "provider string, content_hash string, vec array<float>, rep string, rank int"


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 6, d))
    x = centres[rng.integers(0, len(centres), n)] + 0.35 * rng.standard_normal((n, d))
    return x.astype(np.float32)


def brute(x, k, floor=-1.0):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u.astype(np.float64) @ u.T
    np.fill_diagonal(c, -9)
    return {(i, int(j)) for i in range(len(x)) for j in np.argsort(-c[i], kind="stable")[:k] if c[i, j] >= floor}


def table(spark, x, provider="a"):
    return spark.createDataFrame([(provider, f"h{i:05d}", v.tolist(), "r", 0) for i, v in enumerate(x)], SCHEMA)


@pytest.mark.parametrize("options", [{}, {"target": 40}, {"target": 60, "block": 100}])
def test_recall_against_brute_force(spark, options):
    x = clustered(900, 24, 1)
    got = {(int(r.content_hash[1:]), int(r.neighbour[1:])) for r in nearest(table(spark, x), k=5, min_cosine=0.8, **options).collect()}
    truth = brute(x, 5, 0.8)
    assert len(got & truth) / len(truth) >= 0.97 and len(got - truth) <= 0.02 * len(truth)


def test_small_is_exact_without_floor(spark):
    x = clustered(60, 8, 2)
    rows = nearest(table(spark, x), k=5).collect()
    assert {(int(r.content_hash[1:]), int(r.neighbour[1:])) for r in rows} == brute(x, 5)
    assert all(1 <= r["rank"] <= 5 for r in rows)


def test_recall_without_floor_over_many_centroids(spark):
    x = clustered(3000, 24, 6)
    got = {(int(r.content_hash[1:]), int(r.neighbour[1:])) for r in nearest(table(spark, x), k=5, target=20).collect()}
    assert len(got & brute(x, 5)) / (5 * len(x)) >= 0.98


def test_unusable_and_repeated_rows(spark):
    x = clustered(30, 8, 3)
    rows = [("a", f"h{i}", v.tolist(), "r", 0) for i, v in enumerate(x)]
    rows += rows[:7]
    rows += [
        ("a", "null", None, "r", 0), ("a", "short", [1.0], "r", 0), ("a", "zero", [0.0] * 8, "r", 0), ("a", "nan", [float("nan")] * 8, "r", 0),
        ("a", "inf", [float("inf")] + [0.0] * 7, "r", 0), ("a", None, x[0].tolist(), "r", 0), ("a", "empty", [], "r", 0), (None, "h1", [1.0, 0.0], "r", 0), (None, "h2", [2.0, 0.1], "r", 0),
        ("b", "h1", [1.0, 0.0, 0.0], "r", 0),
    ]
    got = nearest(spark.createDataFrame(rows, SCHEMA), k=5).collect()
    bad = {"null", "short", "zero", "nan", "inf", "empty"}
    assert not any(r.content_hash in bad or r.neighbour in bad for r in got)
    assert len([r for r in got if r.provider == "a"]) == 30 * 5
    assert {(r.content_hash, r.neighbour) for r in got if r.provider is None} == {("h1", "h2"), ("h2", "h1")}


def test_group_of_copies(spark):
    x = clustered(40, 8, 4)
    x = np.vstack([x, np.repeat(x[:1] * 3, 300, axis=0)])
    rows = nearest(table(spark, x), k=5).collect()
    assert len(rows) == len(x) * 5
    assert all(r.cosine > 0.999 for r in rows if int(r.content_hash[1:]) >= 40)
    assert all(r.content_hash != r.neighbour for r in rows)


def test_empty(spark):
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert nearest(spark.createDataFrame([("a", "h", None, "r", 0)], SCHEMA)).count() == 0
    assert nearest(spark.createDataFrame([("a", "h", [1.0, 2.0], "r", 0)], SCHEMA)).count() == 0


def test_graph_finds_nearest_centroids():
    x = clustered(6000, 32, 5)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = balanced_kmeans(x, 200)
    ids, sim = CentroidGraph(c).search(x[:500], 4)
    truth = np.argsort(-(x[:500] @ c.T), axis=1)[:, :4]
    hit = np.mean([len(set(a) & set(b)) / 4 for a, b in zip(ids, truth)])
    assert hit > 0.9
    sizes = np.bincount(np.argmax(x @ c.T, axis=1), minlength=200)
    assert sizes.max() < 12 * sizes.mean()


def test_graph_of_many_centroids():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cells, full = CentroidGraph(x, whole=1000), CentroidGraph(x)
    q = x[:200] + 0.05 * rng.normal(size=(200, 24)).astype(np.float32)
    for graph in (cells, full):
        assert graph.next.shape == (3000, 24) and (graph.next != np.arange(3000)[:, None]).all()
        found, _ = graph.search(q, 1)
        assert (found[:, 0] == np.argmax(q @ x.T, axis=1)).mean() > 0.75


def test_centroids_grow_with_the_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    reps = spark.createDataFrame([("p", f"r{i}", r.tobytes()) for i, r in enumerate(x)], "provider string, rep string, v binary")
    for n, least, most in ((3000, 200, 320), (600, 40, 65)):
        number, graph = fit_centroids(reps.filter(f"int(substr(rep, 2)) < {n}"), {"p": 16}, 12)["p"]
        assert number == 0 and least <= len(graph.c) <= most
    assert fit_centroids(reps.limit(0), {}, 12) == {}


def pairs_at(n, d, cosine, seed):
    rng = np.random.default_rng(seed)
    a, u = rng.normal(size=(n, d)), rng.normal(size=(n, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    u -= (u * a).sum(axis=1, keepdims=True) * a
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return np.vstack([a, cosine * a + np.sqrt(1 - cosine**2) * u]).astype(np.float32)


def test_pairs_near_the_floor_among_many_centroids(spark, tmp_path, monkeypatch):
    n, d = 12_000, 64
    x = pairs_at(n, d, 0.81, 7)
    vec = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, d, dtype=np.int32)), pa.array(x.ravel()))
    pq.write_table(pa.table({"provider": ["a"] * len(x), "content_hash": [f"{i:05d}" for i in range(len(x))], "vec": vec}), tmp_path / "vectors.parquet")
    want = {(f"{i:05d}", f"{i + n:05d}") for i in range(n)}
    whole = {(r.hash_a, r.hash_b) for r in p4_found(spark, str(tmp_path)).collect()}
    assert whole <= want and len(whole) >= 0.999 * n
    # the same in several rounds and with lists that are cut
    monkeypatch.setattr(neighbours, "ROUND", 50_000)
    some = nearest(spark.read.parquet(str(tmp_path / "vectors.parquet")), min_cosine=0.8, block=1_500)
    assert len({(r.content_hash, r.neighbour) for r in some.collect()}) >= 2 * 0.999 * n


@pytest.mark.parametrize("floor", [0.8, 0.95, -1.0])
def test_pairs_of_a_list_against_all_cosines(floor):
    x = clustered(700, 24, 8)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = np.vstack([x, x[:300] + np.float32(1e-3)]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j, _ = neighbours._compare(x, 5, floor)
    assert set(zip(i.tolist(), j.tolist())) == {(min(p), max(p)) for p in brute(x, 5, floor)}
    assert neighbours._above(x, 0.8, 10) is None


def test_walk_finds_nearest_centroids():
    x = pairs_at(2000, 32, 0.9, 9)
    graph = CentroidGraph(x[:2000])
    walked, all_ = graph.search(x[2000:2300], 8, exact=0)[0], graph.search(x[2000:2300], 8)[0]
    assert (all_ == np.argsort(-(x[2000:2300] @ graph.c.T), axis=1)[:, :8]).all()
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(walked, all_)]) > 0.9
