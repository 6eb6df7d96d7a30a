import random

import pytest

from corvane.llm import leakage, overlap
from corvane.llm.wordfold import fold, words

Q = "id string, question string, expect_files array<string>, split string, set_name string, project_id string, df long, class_id string"


def test_words():
    assert words("Hello, wörld x_y İSTANBUL ışık I") == ["hello", "world", "x", "y", "istanbul", "isik", "i"]
    assert words("ço\u00adk e\u0301t\u200be") == ["cok", "ete"]
    assert words("") == [] and words("...") == []
    codes, pos, start = fold(["ab, c", "", "d"])
    assert "".join(chr(c) if c > 1 else "|" for c in codes) == " | ab c |  | d | "
    assert len(start) == 4 and pos[start[0] + 1] == 0 and pos[start[2] + 1] == 0


def test_cut_is_content_defined():
    a = [f"w{i}" for i in range(200)]
    b = a[:90] + ["extra"] + a[90:]
    for chunking in range(3):
        ca, cb = overlap.cut(a, chunking), overlap.cut(b, chunking)
        assert [s for s, _ in ca[1:]] == [e for _, e in ca[:-1]] and ca[0][0] == 0 and ca[-1][1] == 200
        assert 60 < len(ca) < 140, "two words a chunk on average"
        da, db = (overlap.digests(x, chunking + 1)[chunking] for x in (a, b))
        assert sum(e - s for d, (s, e) in da.items() if d in db) > 185
    assert overlap.cut(a, 0) != overlap.cut(a, 1)
    # the window reaches into the word before a short word
    assert overlap.rolling(["alpha", "a"])[1] != overlap.rolling(["omega", "a"])[1]
    assert overlap.rolling(["alpha", "considerably"])[1] == overlap.rolling(["omega", "considerably"])[1]


def test_chunks_decide_the_pairs(spark, monkeypatch):
    rows = [("a", "one two three four five six", ["f"], "dev", "s", "p", 1, "x"), ("b", "six five four three two one", ["f"], "test", "s", "p", 1, "x")]
    df = spark.createDataFrame(rows, Q)
    assert overlap.find_overlaps(df).count() == 1
    # without a cut a reversed record shares no chunk
    assert overlap.find_overlaps(df, chunkings=3, mean_words=10**9).count() == 0


def brute(rows, threshold=0.6):
    recs = set()
    for i, q, f, s, *_ in rows:
        if i is None:
            continue
        s = (s or "").strip().lower() or "dev"
        recs.add((i, frozenset(words(q or "")), frozenset(x.replace("\\", "/").removeprefix("./") for x in f or [] if x), s))
    out = set()
    for a in recs:
        for b in recs:
            if a[3] == "dev" and b[3] in ("test", "holdout") and a[2] & b[2] and a[1] and len(a[1] & b[1]) >= threshold * len(a[1] | b[1]) - 1e-9:
                out.add((b[0], a[0]))
    return out


def test_overlaps_equal_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = [f"word{i}" for i in range(40)] + ["the", "a", "of"]
    rows = []
    for i in range(300):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 9))]
        files = [rnd.choice(["a.py", "./a.py", "b\\c.py", "b/c.py", "hot.py", None]) for _ in range(rnd.randrange(0, 3))]
        rows.append((f"q{i}", " ".join(base), files, rnd.choice(["dev", None, "Test", " holdout ", "dev", "other"]), "s", "p", 1, "x"))
    rows += rows[:20] + [("n1", None, ["a.py"], "dev", "s", "p", 1, "x"), ("n2", "", None, "test", None, "p", 1, "x"), (None, "a b", ["a.py"], "test", "s", "p", 1, "x")]
    # a third of all rows are copies of one question
    rows += [(f"c{i}", "same old question text", ["hot.py"], "test" if i % 2 else "dev", "s", "p", 1, "x") for i in range(120)]
    df = spark.createDataFrame(rows, Q)
    got = [(r.eval_id, r.train_id) for r in overlap.find_overlaps(df).select("eval_id", "train_id").distinct().collect()]
    assert set(got) == brute(rows) and len(got) == len(set(got))
    report = overlap.overlap_report(df).collect()
    assert sum(r.overlapping for r in report) == len({e for e, _ in brute(rows)})


def test_overlap_empty(spark):
    df = spark.createDataFrame([], Q)
    assert overlap.find_overlaps(df).count() == 0 and overlap.overlap_report(df).count() == 0


def brute_leaks(docs, passages, n=12):
    out = set()
    for d, t in docs:
        w = words(t or "")
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for p, x in passages:
            v = words(x or "")
            if d is not None and p is not None and any(tuple(v[i : i + n]) in grams for i in range(len(v) - n + 1)):
                out.add((d, p))
    return out


@pytest.mark.parametrize("block_bytes", [10**9, 500])
def test_leaks_equal_brute_force(spark, block_bytes):
    rnd = random.Random(4)
    vocabulary = [f"kelime{i}" for i in range(300)] + ["İyi", "ÇOK", "été"]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passages = [(i, text(rnd.randrange(5, 60))) for i in range(25)]
    docs = []
    for d in range(120):
        body = text(rnd.randrange(0, 150))
        if d % 3 == 0:
            p = rnd.choice(passages)[1]
            s, k = rnd.randrange(0, max(1, len(p) - 5)), rnd.randrange(8, 20)
            at = rnd.randrange(0, len(body) + 1)
            body = body[:at] + p[s : s + k] + body[at:]
        sep = rnd.choice([" ", ", ", "\n", " - ", "\u200b  "])
        docs.append((d, sep.join(rnd.choice([str.upper, str.lower, str])(w) for w in body)))
    docs += [(500, None), (501, ""), (None, docs[0][1]), docs[3], docs[3], (502, "x" * 50_000)]
    rows = [(i, " ".join(w)) for i, w in passages] + [(90, None), (91, ""), (None, "a"), (0, " ".join(passages[0][1]))]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, passage_id int")
    p = spark.createDataFrame([(*r, "t") for r in rows], "passage_id bigint, text string, doc_id string")
    found = leakage.find_leaks(d, p, block_bytes=block_bytes).collect()
    assert {(r.doc_id, r.passage_id) for r in found} == brute_leaks(docs, rows)
    assert len(found) == len({(r.doc_id, r.passage_id) for r in found})
    by_id = dict(x for x in docs if x[0] is not None)
    for r in found:
        assert len(words(by_id[r.doc_id][r.start_pos : r.end_pos])) == r.run_words >= 12


def test_leaks_empty(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    p = spark.createDataFrame([], "passage_id bigint, text string")
    one = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert leakage.find_leaks(d, p).count() == 0 and leakage.find_leaks(one, p).count() == 0
    assert leakage.find_leaks(d, one.withColumnRenamed("doc_id", "passage_id")).count() == 0


def edit_run(a: str, b: str, edits: int) -> int:
    """Most whole words of ``b`` in a stretch that ``a`` holds with at most ``edits`` edits, by a plain table."""
    best = 0
    for j0 in range(len(b)):
        if b[j0] != " ":
            continue
        row = [0] * (len(a) + 1)  # the stretch may begin anywhere in a
        for j in range(j0, len(b)):
            new = [row[0] + 1]
            for i in range(1, len(a) + 1):
                new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (a[i - 1] != b[j])))
            row = new
            if min(row) <= edits and b[j] == " ":
                best = max(best, b[j0 : j + 1].count(" ") - 1)
    return best


def test_edit_alignment_equals_plain_table():
    rnd = random.Random(8)
    codes = lambda t: fold([t])[0][2:-2]
    for _ in range(60):
        b = [rnd.choice(["ab", "ba", "abc", "c", "bcaa"]) for _ in range(rnd.randrange(1, 9))]
        a = [w if rnd.random() < 0.8 else rnd.choice(["ab", "acb", "c"]) for w in b]
        if rnd.random() < 0.3:
            a.insert(rnd.randrange(len(a) + 1), "b")
        x, y = codes(" ".join(a)), codes(" ".join(b))
        s, t = ("".join(map(chr, v)) for v in (x, y))
        for edits in (0, 1, 3):
            got, begin, end = leakage.align(x, y, -len(y), len(x) + len(y), edits)
            assert got == edit_run(s, t, edits), (s, t, edits)
            assert 0 <= begin <= end <= len(x)


def test_edits_find_changed_words(spark):
    words_ = [f"passage{chr(97 + i)}{chr(105 + i)}" for i in range(18)]
    changed = [*words_[:8], "passagexy", *words_[9:]]
    longer = [*words_[:9], "a", *words_[9:]]
    docs = [(1, "before " + " ".join(changed) + " behind"), (2, " ".join(longer)), (3, " ".join(words_)), (4, "nothing at all")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    p = spark.createDataFrame([(7, " ".join(words_))], "passage_id bigint, text string")
    found = lambda e: {r.doc_id: r for r in leakage.find_leaks(d, p, edits=e).collect()}
    assert set(found(0)) == {3}
    two = found(2)
    assert set(two) == {1, 2, 3} and all(r.run_words == 18 for r in two.values())
    assert docs[0][1][two[1].start_pos : two[1].end_pos] == " ".join(changed)
