import functools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.test_functions import slow_lcs, slow_windows
from weftlink.functions import normalize as N
from weftlink.operators import assignment, blocking, evaluation, features, search, training, validation
from weftlink.operators.blocking import BlockingParams
from weftlink.plans.queries import View


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def records(spark, rows):
    return frame(spark, rows, "entity_id string, country string, name string, address string")


S1 = [("S1-1", "US", "acme steel works", "12 main street 33101"), ("S1-2", "US", "blue ocean", ""), ("S1-3", "FR", "nothing alike", "1 rue x")]
T = [("S2-1", "US", "acme steel works", "12 main street 33101"), ("S2-2", "US", "acme steel", "99 other road 44444"), ("S3-1", "US", "blueocean", "5 sea lane"), ("S3-2", "FR", "acme steel works", "12 main street 33101")]


def test_candidates(spark):
    a, t = records(spark, S1), records(spark, T)
    p = BlockingParams()
    assert {(r.s1_id, r.t_id, r.overlap) for r in blocking.overlap_join(a, t, p).collect()} == {("S1-1", "S2-1", 7), ("S1-1", "S2-2", 2)}
    assert {(r.s1_id, r.t_id) for r in blocking.squash_join(a, t, p).collect()} == {("S1-1", "S2-1"), ("S1-2", "S3-1")}
    found = {(r.s1_id, r.t_id): r.score for r in blocking.candidate_pairs(a, t, p).collect()}
    assert found[("S1-1", "S2-1")] == 100 and ("S1-2", "S3-1") in found and all(k[0] != "S1-3" for k in found)
    lists = {r.s1_id: r.candidates for r in blocking.id_lists(a, blocking.candidate_pairs(a, t, p), [F.col("source"), F.col("rank")], "candidates").collect()}
    assert lists["S1-3"] == "" and lists["S1-1"].startswith("S2-1")
    assert blocking.overlap_join(a, t, BlockingParams(max_df=1)).count() == 0


def test_both_ways_of_counting_shared_tokens_agree(spark, sf_dir):
    v = View(spark, sf_dir)
    rows = lambda dense, **kw: sorted(map(tuple, blocking.overlap_topk(v.s1, v.t, BlockingParams(dense=dense, **kw)).select("s1_id", "t_id", "overlap", "rank").collect()))
    for kw in ({"pool": 7}, {"max_df": 12, "pool": 3}):
        assert rows(0, **kw) == rows(1 << 40, **kw) != []


def test_cosine_in_blocks_equals_all_pairs(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 5)))
    rows = [(f"S{1 + i % 3}-{i}", ["US", "FR"][i % 2], " ".join(word() for _ in range(3)), " ".join(word() for _ in range(r.randint(0, 9)))) for i in range(60)]
    df = records(spark, rows)
    got = {(x.s1_id, x.t_id): x.sim for x in blocking.cosine_topk(blocking.count_vectors(df, 3, 4), df.where("entity_id NOT LIKE 'S1-%'"), 100, 0.08, block=7).collect()}

    def grams(name, address):
        out = {}
        for w in f"{name} {address}".split():
            w = f" {w} "
            for g in [w] if len(w) < 3 else [w[i:i + n] for n in (3, 4) for i in range(len(w) - n + 1)]:
                out[g] = out.get(g, 0) + 1
        return out

    want = {}
    for a in rows:
        for b in rows:
            if a[0].startswith("S1-") and not b[0].startswith("S1-") and a[1] == b[1]:
                x, y = grams(*a[2:]), grams(*b[2:])
                sim = sum(x[g] * y.get(g, 0) for g in x) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
                if sim >= 0.08:
                    want[a[0], b[0]] = sim
    assert got == pytest.approx(want, abs=1e-8) and want


def test_leading_squash_pairs_give_the_same_top_lists(spark):
    name = lambda i: ["blue ocean", "blueocean", "acme"][i % 3]
    where = lambda i: ["1 road 11111", "2 road 22222", ""][i // 3 % 3]
    a = records(spark, [(f"S1-{i}", "US", name(i), where(i)) for i in range(9)])
    t = records(spark, [(f"S{2 + i % 2}-{i}", "US", name(i // 2), where(i // 2)) for i in range(80)])
    for p in (BlockingParams(per_source=2), BlockingParams(per_source=4, max_df=30, pool=3)):
        whole = blocking.with_records(blocking.candidate_pool(a, t, p), a, t)
        want = {(r.s1_id, r.t_id, r["rank"], r.score) for r in blocking.top_candidates(blocking.dual_channel(blocking.postal_guard(whole, p), p), p).collect()}
        assert want == {(r.s1_id, r.t_id, r["rank"], r.score) for r in blocking.candidate_pairs(a, t, p).collect()}
        assert blocking.leading_squash_pairs(a, t, p).count() < blocking.squash_join(a, t, p).count()


def test_postal_guard(spark):
    rows = [("acme steel", "beta works", "33101", "44444"), ("acme steel", "acme steel", "33101", "44444"), ("a", "b", None, "44444"), ("a", "b", "33101", "33101")]
    df = frame(spark, rows, "a_name string, b_name string, a_postal string, b_postal string")
    assert blocking.postal_guard(df, BlockingParams()).count() == 3


def test_features_of_an_empty_pair(spark):
    a, t = records(spark, [("S1-1", "US", "", "")]), records(spark, [("S3-1", "US", "", "")])
    r = features.pair_features(frame(spark, [("S1-1", "S3-1")], "s1_id string, t_id string"), a, t).head()
    assert (r.n_ts_ratio, r.n_ratio, r.n_exact, r.n_len_ratio, r.addr_empty, r.a_first_num_match, r.is_s3, r.n_containment) == (0, 100, 0, 1, 1, 0.5, 1, 0)
    assert r.asDict().keys() == {"s1_id", "t_id", *features.FEATURES}


def plain_features(t_id, a, b):
    """The 22 features again, from their definitions."""
    (an, aa), (bn, ba) = a, b
    ratio = lambda x, y: 200.0 * slow_lcs(x, y) / (len(x) + len(y)) if x or y else 100.0
    ordered = lambda x: " ".join(sorted(x.split()))

    def sets(x, y):
        x, y = set(x.split()), set(y.split())
        if not x or not y:
            return 0.0
        both, left, right = (" ".join(sorted(z)) for z in (x & y, x - y, y - x))
        if both and (not left or not right):
            return 100.0
        whole = [f"{both} {z}".strip() for z in (left, right)]
        return max([ratio(*whole), *([ratio(both, w) for w in whole] if both else [])])

    contain = lambda x, y: len(set(x) & set(y)) / min(len(set(x)), len(set(y))) if x and y else 0.0
    digits = lambda x, low, high: [w for w in re.findall(r"\w+", x) if w.isdigit() and low <= len(w) <= high]
    aw, bw, an2, bn2, ap, bp = an.split(), bn.split(), set(digits(aa, 2, 6)), set(digits(ba, 2, 6)), set(digits(aa, 5, 6)), set(digits(ba, 5, 6))
    af, bf = digits(aa, 1, 99)[:1], digits(ba, 1, 99)[:1]
    empty = not aa or not ba
    squash = lambda x: functools.reduce(lambda c, w: c.replace(w, ""), N.SQUASH_STRONG, x)
    clean = lambda x: re.sub("[^a-z0-9]", "", squash(x))
    out = [sets(an, bn), ratio(ordered(an), ordered(bn)), ratio(an, bn), slow_windows(an, bn), ratio(clean(an), clean(bn)), an == bn != "", ratio(aw[0], bw[0]) if aw and bw else 0, bool(aw and bw and aw[0] == bw[0]), contain(aw, bw),
           min(len(an), len(bn)) / max(len(an), len(bn)) if an or bn else 1, abs(len(an) - len(bn))]
    if empty:
        out += [0, 0, 0, 0, 0, 0, 0, 0.5]
    else:
        out += [sets(aa, ba), ratio(ordered(aa), ordered(ba)), contain(aa.split(), ba.split()), len(an2 & bn2) / len(an2 | bn2) if an2 and bn2 else 0.5 if not an2 and not bn2 else 0,
                bool(an2 & bn2) if an2 and bn2 else 0.5 if not an2 and not bn2 else 0, bool(ap and bp and ap & bp), bool(ap and bp and not ap & bp), af == bf if af and bf else 0.5]
    return [float(x) for x in [*out, empty, t_id.startswith("S2-"), t_id.startswith("S3-")]]


def test_features_equal_a_plain_form(spark):
    r = random.Random(9)
    words = ["acme", "steel", "works", "blue", "ocean", "and", "12", "33101", "44444", "road", "caf\u00e9", "com", "7"]
    some = lambda k: " ".join(r.choice(words) for _ in range(k))
    rows = [(f"S{1 + i % 3}-{i}", "US", some(r.choice([0, 1, 3, 5])), some(r.choice([0, 2, 9, 60]))) for i in range(24)]
    by = {i: (n, a) for i, _, n, a in rows}
    pairs = [(a[0], b[0]) for a in rows for b in rows if a[0].startswith("S1-") and not b[0].startswith("S1-")]
    df = records(spark, rows)
    got = features.pair_features(frame(spark, pairs, "s1_id string, t_id string"), df, df).collect()
    assert len(got) == len(pairs)
    for x in got:
        assert [x[f] for f in features.FEATURES] == pytest.approx(plain_features(x.t_id, by[x.s1_id], by[x.t_id])), (by[x.s1_id], by[x.t_id])


def test_decision_and_exclusivity(spark):
    schema = "s1_id string, t_id string, p double, a_name string, b_name string, a_addr string, b_addr string"
    rows = [("S1-1", "S2-1", 0.85, "acme", "acme", "x", "x"), ("S1-2", "S2-1", 0.95, "acme b", "acme", "x", ""), ("S1-3", "S2-2", 0.85, "acme", "acme", "x", ""), ("S1-4", "S2-3", 0.85, "a", "a", "", ""), ("S1-5", "S2-1", 0.9, "acme", "acme", "x", "x")]
    kept = assignment.decide(frame(spark, rows, schema), 0.8)
    assert {r.s1_id for r in kept.collect()} == {"S1-1", "S1-2", "S1-4", "S1-5"}
    assert {(r.t_id, r.claims) for r in assignment.collisions(kept).collect()} == {("S2-1", 3)}
    ranks = {(r.s1_id, r.t_id): r["rank"] for r in assignment.exclusive(kept).collect()}
    assert ranks[("S1-1", "S2-1")] == 1 and ranks[("S1-5", "S2-1")] == 2 and sum(v == 1 for v in ranks.values()) == 2
    labels = frame(spark, [(0.95,), (0.85,), (0.6,), (0.1,)], "p double").select(assignment.confidence_label(F.col("p"), 0.8).alias("l")).collect()
    assert [r.l for r in labels] == ["High Confidence Match", "Match", "Borderline Non-Match", "Distinct Businesses"]


@pytest.mark.parametrize("found,true,want", [(["a", "b", "c"], ["a", "c"], 0.714286), (["a"], ["a", "b"], 0.833333), ([], [], 1.0), (["a"], [], 0.0), ([], ["a"], 0.0)])
def test_macro_f_beta(spark, found, true, want):
    pairs = lambda ids: frame(spark, [("S1-1", x) for x in ids], "s1_id string, t_id string")
    r = evaluation.macro_fbeta(records(spark, S1[:1]), pairs(found), pairs(true)).head()
    assert r.macro_f_beta == pytest.approx(want, abs=1e-6) and r.records == 1


def test_sweep_equals_counting(spark):
    rows = [(0.3, 0), (0.5, 1), (0.55, 0), (0.7, 1), (0.7, 0), (0.94, 1), (0.99, 1), (1.0, 0)]
    got = {round(r.threshold, 2): (r.tp, r.n_found) for r in evaluation.threshold_sweep(frame(spark, rows, "p double, label int")).collect()}
    for k in range(50, 95):
        t = k / 100
        assert got[t] == (sum(y for p, y in rows if p >= t), sum(p >= t for p, _ in rows))


HEADER = ("source1_entity_id", "matched_entity_ids")


def test_validation_rules(spark):
    lines = ["source1_entity_id\tMATCHED_entity_ids", "S1-1\tS2-1,S2-1", "S1-1\tS2-1", "S1-2\tS1-9", "S1-3\tX-1", "S1-4\tS2-1,", "S1-5 S2-1", "", "S1-6\tS2-77", "S1-9\t"]
    rows = validation.id_lists(spark.createDataFrame([(x,) for x in lines], "value string"), HEADER)
    required = spark.createDataFrame([(f"S1-{i}",) for i in (1, 2, 3, 4, 6, 7)], "entity_id string")
    known = spark.createDataFrame([("S2-1",)], "entity_id string")
    report = {r.rule: (r.n, r.examples) for r in validation.report(validation.list_findings(rows, required, known)).collect()}
    assert report == {"no_tab": (1, "S1-5 S2-1"), "duplicate_row": (1, "S1-1"), "duplicate_in_list": (1, "S1-1"), "reference_in_list": (1, "S1-9"), "bad_prefix": (2, "S1-3,S1-4"),
                      "unknown_id": (1, "S2-77"), "missing_record": (1, "S1-7"), "extra_record": (2, "S1-5 S2-1,S1-9")}
    r = validation.row_counts(rows).head()
    assert (r.n_rows, r.filled, r.empty) == (8, 6, 2)
    assert validation.header_findings(None, HEADER) == [("empty_file", "error")] and validation.header_findings("a,b", HEADER) == [("not_tab_separated", "error")]
    assert validation.header_findings("a\tb", HEADER) == [("wrong_header", "error")] and validation.header_findings("SOURCE1_entity_id\tmatched_entity_ids\n", HEADER) == []
    short = rows.where("id = 'S1-6'")
    assert validation.report([validation.not_candidates(short, rows.where("id = 'S1-1'"))]).head().n == 1


def test_search_and_hydration(spark):
    rows = records(spark, S1).withColumn("match_count", F.when(F.col("entity_id") == "S1-1", 2).otherwise(0))
    ids = lambda df: [r.entity_id for r in df.collect()]
    assert ids(search.entity_search(rows, "STEEL")) == ["S1-1"] and ids(search.entity_search(rows, country="fr")) == ["S1-3"] and ids(search.entity_search(rows, status="singleton")) == ["S1-2", "S1-3"]
    pairs = frame(spark, [("S1-1", "S2-1"), ("S1-1", "S2-404")], "s1_id string, t_id string")
    found = search.hydrated(pairs, records(spark, T))
    assert {(r.t_id, r["name"]) for r in found.collect()} == {("S2-1", "acme steel works"), ("S2-404", "Entity S2-404")}
    r = {r.entity_id: r for r in search.with_match_lists(records(spark, S1), found).collect()}
    assert r["S1-1"].match_count == 2 and r["S1-2"].is_singleton


def test_training_finds_copies(spark, sf_dir, tmp_path):
    v = View(spark, sf_dir)
    labelled = v.labelled().cache()
    matcher = training.train_matcher(labelled, training.MatcherParams(iterations=8, least=2))
    assert 0.5 <= matcher.threshold <= 0.94 and len(matcher.importances()) == 22
    matcher.save(str(tmp_path / "m"))
    again = training.Matcher.load(str(tmp_path / "m"))
    scores = again.score(labelled).groupBy("label").agg(F.avg("p").alias("p")).collect()
    by = {r.label: r.p for r in scores}
    assert by[1] > by[0] and again.threshold == matcher.threshold
    r = search.explain_pair(spark, again, {"name": "Acme Ltd", "address": "1 Main St"}, {"name": "ACME", "address": "1 main street"}).head()
    assert 0 <= r.match_probability <= 1 and len(json.loads(r.features)) == 19
    shown = json.loads(r.features)
    assert shown["name_exact_match"] is True and shown["target_source"] == "Source 2" and shown["first_street_number_match"] is True


def test_result_does_not_depend_on_partitions(spark, sf_dir):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("1", "4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(tuple, View(spark, sf_dir).exclusive().select("s1_id", "t_id", "combined", "rank").collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2] and seen[0]
    owners = [t for s, t, c, r in seen[0] if r == 1]
    assert len(owners) == len(set(owners))


def test_invariants(spark, sf_dir):
    v = View(spark, sf_dir, BlockingParams(max_df=40, pool=20, per_source=3))
    cand = {(r.s1_id, r.t_id, r.source) for r in v.candidates().collect()}
    match = {(r.s1_id, r.t_id) for r in v.matches().collect()}
    assert match <= {c[:2] for c in cand}
    per = {}
    for s, _, source in cand:
        per[s, source] = per.get((s, source), 0) + 1
    assert max(per.values()) <= 3
