import math
import random

import numpy as np
import pytest

from weftlink.llm import embedding_dedup, pivot_search
from weftlink.llm.components import connected_components
from weftlink.llm.embedding_dedup import VectorDedupParams, dedup_vectors
from weftlink.llm.pivot_search import SearchParams, quantised, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, rep int, codes int, t int, score int, id int"
ODD = [(901, None), (902, []), (903, [0.0] * 8), (904, [1.0, None] + [0.0] * 6), (905, [math.nan] + [1.0] * 7), (906, [math.inf] + [1.0] * 7), (None, [1.0] * 8), (907, [1.0, 2.0])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 1, 1, 1, 1) for i, v in rows], SCHEMA).repartition(3)


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 4, 8))
    x = np.concatenate([base, base + 0.1 * rng.standard_normal(base.shape), base, rng.standard_normal((n - 3 * (n // 4), 8))]).astype(np.float32)
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


def brute_links(rows, threshold=0.95):
    good = {i: np.asarray(v, float) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    return {(a, b) for a in good for b in good if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= threshold}


@pytest.mark.parametrize("block", [16, 1024])
def test_dedup_equals_all_pairs(spark, block):
    rows = [*vectors(300), *ODD, (3, vectors(300)[3][1])]
    out = dedup_vectors(frame(spark, rows), VectorDedupParams(block=block)).collect()
    links = brute_links(rows)
    assert links and sorted(r.vec_id for r in out) == sorted({i for i, _ in rows if i is not None})
    label = {r.vec_id: r.vec_id for r in out}
    while True:
        new = {i: min([x, *(label[b] for a, b in links if a == i)]) for i, x in label.items()}
        if new == label:
            break
        label = new
    for r in out:
        assert (r.n_links, r.component_id, r.kept) == (sum(a == r.vec_id for a, _ in links), label[r.vec_id], label[r.vec_id] == r.vec_id)
    assert dedup_vectors(frame(spark, [])).collect() == []


def test_shape_follows_recall():
    for n in (100, 10**5, 10**9):
        bits, tables = VectorDedupParams().shape(n)
        assert 1 - (1 - (1 - math.acos(0.95) / math.pi) ** bits) ** tables >= 0.9995


@pytest.mark.parametrize("block,ring,queries", [(32, 8, 7), (4096, 512, 2048)])
def test_top_k_equals_all_pairs(spark, block, ring, queries):
    rows = [*vectors(300, 1), *ODD, (3, vectors(300, 1)[3][1])]
    got = top_k(quantised(frame(spark, rows), "vec_id", "embedding", 256.0), "id % 10 = 0", SearchParams(block=block, ring=ring, queries=queries)).collect()
    good = {i: [math.floor(256 * c) for c in v] for i, v in rows if i is not None and v and len(v) == 8 and all(c is not None and math.isfinite(c) for c in v)}
    want = set()
    for q in (i for i in good if i % 10 == 0):
        best = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_top_k_of_few_vectors(spark):
    one = [1.0] * 8
    got = top_k(quantised(frame(spark, [(0, one), (1, one), (2, [-1.0] * 8)]), "vec_id", "embedding", 256.0), "id = 0").collect()
    assert {tuple(r) for r in got} == {(0, 1, 1, 8 * 256 * 256), (0, 2, 2, -8 * 256 * 256)}
    assert top_k(quantised(frame(spark, [(0, one)]), "vec_id", "embedding", 256.0), "id = 0").collect() == []
    assert top_k(quantised(frame(spark, []), "vec_id", "embedding", 256.0), "id = 0").collect() == []
    assert top_k(quantised(frame(spark, [(1, one)]), "vec_id", "embedding", 256.0), "id = 0").collect() == []


def test_components_of_paths_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(300, 301), (301, 302), (302, 300), (5, 5), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 141)} | {i: 7 for i in (7, *range(200, 260))} | {300: 300, 301: 300, 302: 300}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_top_k_of_every_length_and_of_large_components(spark):
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) for _ in range([4, 4, 4, 7][i % 4])]) for i in range(120)] + [(1000, []), (1001, None), (1002, [1e18] * 9)]
    q = pivot_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 256.0)
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in pivot_search.top_k(q, "id % 2 = 0", pivot_search.SearchParams(k=5)).collect())
    v = {i: [math.floor(256 * x) for x in e] for i, e in rows if e}
    want = []
    for i in v:
        near = sorted((-sum(a * b for a, b in zip(v[i], v[j])), j) for j in v if j != i and len(v[j]) == len(v[i]))[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(near)] if i % 2 == 0 else []
    assert got == sorted(want) and q.where("id = 1002").head().vec[0] == 256e18


@pytest.mark.parametrize("most", [0, 100])
@pytest.mark.parametrize("of", ["float", "double"])
def test_one_vector_for_each_id(spark, monkeypatch, most, of):
    monkeypatch.setattr(embedding_dedup, "REPEATED", most)
    rows = [(1, [2.0, 1.0]), (1, [1.0, 5.0]), (2, None), (2, [3.0]), (3, None), (None, [1.0]), (4, [0.5]), (4, [0.5])]
    out = embedding_dedup.one_per_id(spark.createDataFrame(rows, f"i long, v array<{of}>"), "i", "v")
    assert out.dtypes == [("id", "bigint"), ("vec", f"array<{of}>")]
    assert sorted((r.id, r.vec) for r in out.collect()) == [(1, [1.0, 5.0]), (2, [3.0]), (3, None), (4, [0.5])]
    once = embedding_dedup.one_per_id(spark.createDataFrame([(1, [1]), (2, None)], "i long, v array<int>"), "i", "v")
    assert sorted((r.id, r.vec) for r in once.collect()) == [(1, [1.0]), (2, None)]
