import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm.components import connected_components
from corvane.llm.nearcopies import _branch, _compare_nodes, _odd, near_copy_groups, sketch, trees_for

SCHEMA = "ord bigint, source string, text string, indexed_at timestamp, rep bigint, node string"


def brute(rows, threshold=0.6, min_words=40):
    sets = {}
    for o, source, text, *_ in rows:
        w = re.findall(r"\w+", (text or "").lower())
        if o is not None and source == "code" and len(w) >= min_words:
            sets[o] = frozenset(zip(w, w[1:]))
    parent = {o: o for o in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    size = {}
    for o in sets:
        size[root(o)] = size.get(root(o), 0) + 1
    return {o: root(o) for o in sets if size[root(o)] > 1}


def corpus(seed=7, families=30, rest=80):
    rnd = random.Random(seed)
    words = [f"v{i}" for i in range(250)] + ["if", "return", "self", "not", "in"] * 20
    rows, o = [], 0
    for _ in range(families):
        base = [rnd.choice(words) for _ in range(rnd.randrange(45, 120))]
        for _ in range(rnd.randrange(1, 6)):
            t = base[:]
            for _ in range(rnd.randrange(0, 12)):
                at = rnd.randrange(len(t))
                t[at : at + rnd.randrange(0, 2)] = [rnd.choice(words)]
            o += 1
            rows.append((o, "code", " ".join(t), None, 0, "x"))
    for _ in range(rest):
        o += 1
        rows.append((o, "code", " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 90))), None, 0, "x"))
    return rows


@pytest.mark.parametrize("options", [{}, {"leaf": 4, "fan": 4}, {"node_limit": 6, "spark_levels": 1, "recall": 0.99999}])
def test_groups_equal_brute_force(spark, options):
    rows = corpus()
    rows += rows[:5] + [(9001, "code", None, None, 0, "x"), (9002, "code", "", None, 0, "x"), (9003, "doc", rows[0][2], None, 0, "x"), (None, "code", rows[0][2], None, 0, "x")]
    got = near_copy_groups(spark.createDataFrame(rows, SCHEMA), **options).collect()
    assert {r.ord: r.group_ord for r in got} == brute(rows) and len(got) == len({r.ord for r in got})


def test_hot_group_of_copies(spark):
    rows = corpus(seed=8, families=5, rest=20)
    text = rows[0][2]
    rows += [(10_000 + i, "code", text, None, 0, "x") for i in range(400)]
    assert {r.ord: r.group_ord for r in near_copy_groups(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


def test_latest_version_counts(spark):
    import datetime

    rows = corpus(seed=9, families=2, rest=0)[:2]
    day = lambda d: datetime.datetime(2024, 1, d)
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, "code", a, day(1), 0, "x"), (1, "code", b, day(2), 0, "x"), (2, "code", a, day(1), 0, "x"), (3, "code", b, day(1), 0, "x")]
    assert {r.ord: r.group_ord for r in near_copy_groups(spark.createDataFrame(rows, SCHEMA)).collect()} == {1: 1, 3: 1}


def test_empty_and_trees(spark):
    assert near_copy_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trees_for(0.6, 0.999) == 8


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(rnd.randrange(1000, 1200), rnd.randrange(1000, 1200)) for _ in range(80)] + [(5, 5), (7, None)]
    edges += [(5000, 5000 + i) for i in range(1, 200)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in got} == {x: root(x) for x in parent} and len(got) == len(parent)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_recall_of_pairs_at_the_threshold_in_large_nodes():
    # pairs at J = 0.6 out of one pool, so that hundreds of records share a node and no child keeps half of it
    rng = np.random.default_rng(11)
    pool = rng.choice(1 << 32, 355, replace=False).astype(np.uint32)
    sets = []
    for _ in range(400):
        t = rng.permutation(pool)[:200]
        sets += [np.sort(t[:160]), np.sort(np.concatenate((t[:120], t[160:])))]
    met = set()
    rows = []
    for i in range(trees_for(0.6, 0.999, 3, 11)):
        m, a, _ = _odd(i)
        rows += [((i << 32) + int((t * np.uint32(m) + np.uint32(a)).min()), r, t.tobytes(), sketch(t)) for r, t in enumerate(sets)]
    rows.sort(key=lambda x: x[:2])
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["node", "rep", "tokens", "sketch"])
    for b in _compare_nodes(iter([batch]), 0.6, 96, 3, 8):
        met |= {(min(x), max(x)) for x in zip(*b.to_pydict().values())}
    assert met <= {(r, r + 1) for r in range(0, len(sets), 2)}
    assert len(met) >= 0.99 * len(sets) / 2


def test_every_node_branches_by_its_own_hashes():
    rng = np.random.default_rng(12)
    t = rng.choice(1 << 32, 200, replace=False).astype(np.uint32)
    pair = [t[:160].tobytes(), np.concatenate((t[:120], t[160:])).tobytes()]
    rows = [(node, rep, pair[rep], 0, 2) for node in range(500) for rep in (0, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["node", "rep", "tokens", "tag", "size"])
    children = [set(), set()]
    for b in _branch(iter([batch]), fan=3):
        for x in b.to_pylist():
            children[x["rep"]].add((x["parent"], x["node"]))
    assert 0.88 < len({p for p, _ in children[0] & children[1]}) / 500 < 0.98


def test_trees_count_branching():
    assert trees_for(0.6, 0.999, 3, 11) == 9 and trees_for(0.6, 0.999, 3, 1) == 9 and trees_for(0.6, 0.999, 3, 0) == 8
