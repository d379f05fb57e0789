import random
from itertools import combinations

import numpy as np
import pytest

from tests.llm.awkward import docs
from weftlink.llm.minhash_dedup import DedupParams, dedup_documents, drop_near_duplicates
from weftlink.llm.shingles import jaccard, normal_bytes, shingle_sets, signatures


def shingles(text):
    w = normal_bytes(text or "").split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, threshold=0.8):
    """Class of every id from all pairs of texts; texts of one id are linked."""
    texts = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in combinations(texts, 2):
        if s and t and len(s & t) >= threshold * len(s | t):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def variants(seed, n, length, rate):
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(length)]
    return [" ".join(w if r.random() > rate * k / n else f"v{r.randrange(10**6)}" for w in base) for k in range(n)]


def check(spark, rows, **kw):
    out = dedup_documents(docs(spark, [(i, t, "", "") for i, t in rows]).repartition(3), DedupParams(**kw)).collect()
    want = brute(rows)
    assert len(out) == len(rows)
    assert {r.doc_id: r.class_id for r in out if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in out if r.doc_id is not None)
    return out


def test_group_of_near_copies_whose_smallest_is_far_off(spark):
    texts = variants(1, 60, 120, 0.12)
    order = list(range(60))
    random.Random(2).shuffle(order)
    rows = [(1, texts[59]), *((10 + i, texts[k]) for i, k in enumerate(order))]
    out = check(spark, rows, block=8, salt=4)
    assert 1 < len({r.class_id for r in out}) < 60


def test_awkward_documents(spark):
    near = variants(3, 12, 80, 0.1)
    rows = [(1, None), (2, ""), (3, "one"), (4, "One!"), (5, "a b c d"), (6, "a b c d"), (6, "a b c d"), (None, "a b c d"), (None, None), (7, "x" * 5000), (8, " ".join(f"u{i}" for i in range(30000))),
            (9, " ".join(f"u{i}" for i in range(29000))), *((20 + i, t) for i, t in enumerate(near)), *((50 + i, near[0]) for i in range(20))]
    out = check(spark, rows)
    assert {r.class_id for r in out if r.doc_id is None} == {None} and all(r.kept for r in out if r.doc_id is None)
    assert dedup_documents(docs(spark, [])).collect() == []


A, B = "one two three four five six seven", "eight nine ten eleven twelve thirteen fourteen"


@pytest.mark.parametrize("parts", [1, 5])
def test_ids_with_several_texts(spark, parts):
    rows = [(3, A), (5, A), (5, B), (7, B), (5, ""), (9, ""), (9, ""), (11, "lone words that nothing else has here"), (11, None)]
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        out = {(r.doc_id, r.class_id, r.kept) for r in dedup_documents(df).collect()}
        assert out == {(3, 3, True), (5, 3, False), (7, 3, False), (9, 9, True), (11, 11, True)}
        kept = sorted((str(r.doc_id), r.text) for r in drop_near_duplicates(df).collect() if r.text)
        assert kept == [("11", "lone words that nothing else has here"), ("3", A), ("5", B)]


def test_no_text_is_lost_by_row(spark):
    """Each row's text is near one that stays, and no two that stay are near."""
    near = variants(5, 30, 60, 0.2)
    r = random.Random(6)
    rows = [(r.choice([None, *range(8)]), r.choice([*near, "", "tiny"])) for _ in range(120)]
    kept = [(x.doc_id, x.text) for x in drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    classes = brute([(k, t) for k, (_, t) in enumerate(rows)])
    members = {}
    for k, c in classes.items():
        members.setdefault(c, []).append(rows[k])
    order = lambda x: (x[0] is None, x[0])
    want = [min(v, key=order)[0] for v in members.values()]
    assert sorted(map(str, want)) == sorted(str(i) for i, _ in kept)
    left = list(kept)
    for v in members.values():
        left.remove(next(x for x in left if x in v))
    assert not left


def test_one_huge_group_of_copies_and_of_near_copies(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base)) for i in range(300)] + [(1000 + i, " ".join([*base[:50], *(f"t{i}_{k}" for k in range(2))])) for i in range(300)] + [(5000 + i, f"quite other words number {i} of many more {i * 7}") for i in range(300)]
    check(spark, rows, salt=16, block=32)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(spark, rows)


@pytest.mark.parametrize("weighted", [False, True])
def test_signatures_estimate_probability_jaccard(weighted):
    rng = np.random.default_rng(4)
    e = np.sort(rng.integers(0, 2**63, 120, dtype=np.uint64))
    a, b = (e[:100], rng.integers(1, 6, 100)), (e[20:], rng.integers(1, 6, 100))
    v, w = (dict(zip(x[0].tolist(), x[1].tolist() if weighted else [1] * 100)) for x in (a, b))
    exact = sum(1 / sum(max(v.get(j, 0) / v[i], w.get(j, 0) / w[i]) for j in v.keys() | w.keys()) for i in v.keys() & w.keys())
    assert jaccard(a, b, weighted) == pytest.approx(exact)
    s = signatures([a, b, (e[:0], a[1][:0])], 6000, 1, weighted)
    assert (s[0] == s[1]).mean() == pytest.approx(exact, abs=0.03) and not s[2].any()
    assert (signatures([a], 6000, 1, weighted)[0] == s[0]).all()


def test_shingles_do_not_depend_on_the_batch():
    texts = ["One two, three four five six", "", "été — deux", "a b c d e f g", "x"]
    blobs = [normal_bytes(t) for t in texts]
    whole = shingle_sets(blobs, 5)
    for b, t, (h, c) in zip(blobs, texts, whole):
        alone = shingle_sets([b], 5)[0]
        assert (alone[0] == h).all() and (alone[1] == c).all() and len(h) == len(shingles(t))


def probability_jaccard(a, b):
    count = lambda t: {k: t.count(k) for k in t}
    w = lambda t: count([tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)])
    v, w = w(a), w(b)
    return sum(1 / sum(max(v.get(j, 0) / v[i], w.get(j, 0) / w[i]) for j in v.keys() | w.keys()) for i in v.keys() & w.keys())


def test_counted_weights(spark):
    """Weighted mode against all pairs."""
    r = random.Random(7)
    rows = [(i, " ".join(r.choice(["a b c d e", "f g h i j", "k l m n o"]) for _ in range(r.randint(3, 12)))) for i in range(40)]
    rows += [(100, "a b c d e " * 30 + "tail one"), (101, "a b c d e " * 30 + "tail two"), (102, "p q r s t u v w")]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in combinations(rows, 2):
        if probability_jaccard(a, b) >= 0.8 - 1e-12:
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    out = {x.doc_id: x.class_id for x in dedup_documents(docs(spark, [(i, t, "", "") for i, t in rows]), DedupParams(weights="count")).collect()}
    assert out == {i: find(i) for i in parent} and len(set(out.values())) < len(out)
