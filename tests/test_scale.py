"""Queries on tables that their first forms were too slow or too large for."""

import math
import random

from pyspark.sql import functions as F

from tests.test_functions import slow_lcs
from tests.test_operators import records
from weftlink.functions import normalize as N
from weftlink.functions import similarity
from weftlink.operators import assignment, blocking, features
from weftlink.operators.blocking import BlockingParams


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some_records(spark, n=60, seed=5):
    r = random.Random(seed)
    some = lambda k: " ".join(r.choice(["acme", "steel", "works", "blue", "ocean", "12", "33101", "café", "x"]) for _ in range(k))
    return records(spark, [(f"S{1 + i % 3}-{i}", ["US", "FR", None][i % 5 % 3], some(3), some(r.choice([0, 4, 30]))) for i in range(n)])


def test_hashed_ngrams_moves_no_ngrams(spark):
    df = some_records(spark)
    got = blocking.hashed_ngrams(df)
    assert "Exchange" not in plan(got)
    twice = df.where("entity_id LIKE '%7'")
    whole = {(x.entity_id, x.place): x.value for x in blocking.hashed_ngrams(df.union(twice)).collect()}
    assert {(x.entity_id, x.place): round(x.value, 9) for x in got.collect()} == {k: round(v, 9) for k, v in whole.items()}


def test_blocks_count_rows_that_repeat_an_id(spark):
    df = some_records(spark)
    df = df.union(df.where("entity_id LIKE '%1'"))
    a, t = df.where("entity_id LIKE 'S1-%'"), df.where("entity_id NOT LIKE 'S1-%'")
    for kw in ({"pool": 4}, {"pool": 100}, {"pool": 3, "max_df": 9}):
        rows = lambda dense: {tuple(x) for x in blocking.overlap_topk(a, t, BlockingParams(dense=dense, **kw)).select("s1_id", "t_id", "overlap", "rank").collect()}
        assert rows(0) == rows(1 << 40) != set()


def test_joined_rows_are_counted_where_they_arise(spark):
    df = some_records(spark)
    a, t = df.where("entity_id LIKE 'S1-%'"), df.where("entity_id NOT LIKE 'S1-%'")
    p = BlockingParams()
    assert {c: x.rows for c, x in blocking.shared_tokens(a, t, p).items()} == {
        c: blocking.overlap_join(a.where(F.col("country") == c), t.where(F.col("country") == c), p).agg(F.sum("overlap")).head()[0] for c in ("US", "FR")}
    assert "FlatMapCoGroupsInPandas" in plan(blocking.overlap_topk(a, t, p))


def test_addresses_of_words_and_blanks_only(spark):
    r = random.Random(2)
    some = [" ".join(r.choice(["st", "rd", "nr", "st", "12", "rue", "été", "stone", "Dr"]) + r.choice(["", " ", ",", "-"]) for _ in range(r.randint(0, 9))) for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in [*some, "st", " st st  rd ", ""]], "a string")
    rows = df.select(N.normalize_address("a").alias("x"), N.normalize_address(F.concat("a", F.lit(" !"))).alias("y")).collect()
    assert all(x.y == f"{x.x} !".strip() for x in rows) and {"street", "street street road", ""} <= {x.x for x in rows}


def test_addresses_join_pairs_that_pass_the_guard(spark):
    df = some_records(spark)
    df = df.union(df.where("entity_id LIKE '%1'")).union(df.where("entity_id LIKE '%2'").withColumn("address", F.concat("address", F.lit(" 7"))))
    a, t = df.where("entity_id LIKE 'S1-%'"), df.where("entity_id NOT LIKE 'S1-%'")
    p = BlockingParams()
    pool = blocking.candidate_pool(a, t, p)
    want = blocking.postal_guard(blocking.with_records(pool, a, t), p)
    got = blocking.guarded(pool, a, t, p)
    rows = lambda x: sorted(map(repr, x.select(*sorted(want.columns)).collect()))
    assert rows(got) == rows(want) != [] and set(got.columns) == set(want.columns)


def test_counted_ngrams_equal_windows_of_words():
    r = random.Random(4)
    for _ in range(40):
        whole = "".join(r.choice("ab c\té\x1c 𝄞") for _ in range(r.randint(0, 60)))
        for least, most in ((3, 5), (2, 3), (5, 6)):
            want = {}
            for w in blocking.WORDS.findall(whole):
                w = f" {w} "
                for g in [w] if len(w) < least else [w[i:i + n] for n in range(least, most + 1) for i in range(len(w) - n + 1)]:
                    want[g] = want.get(g, 0) + 1
            ids, n = blocking.gram_counts(whole, least, most)
            assert sorted(n.tolist()) == sorted(want.values()) and len(set(ids.tolist())) == len(ids)


def test_cosine_blocks_travel_as_texts_and_put_repeated_ids_together(spark, monkeypatch):
    monkeypatch.setattr(blocking, "_PART", (5, 1 << 20))
    monkeypatch.setattr(blocking, "_OTHER", (4, 1 << 20))
    df = some_records(spark, 90)
    df = df.union(df.where("entity_id LIKE '%1'").withColumn("address", F.lit("other words")))  # ids again, with other texts
    df = df.union(df.where("entity_id LIKE '%3'").selectExpr("concat(substr(entity_id, 1, 3), '9', substr(entity_id, 4)) AS entity_id", "country", "name", "address"))  # texts again
    whole = {}
    for x in df.where("country IS NOT NULL").collect():
        whole.setdefault((x.entity_id, x.country), []).append(f"{x.name} {x.address}")
    for by_source, k in ((True, 3), (False, 4)):
        got = blocking.cosine_topk(blocking.tfidf_vectors(df, 3, 5, 3), df.where("entity_id NOT LIKE 'S1-%'"), k, 0.1, by_source, block=17)
        assert "texts#" in plan(got) and "weights" not in plan(got)
        tf = {e: blocking.gram_counts(" ".join(x), 3, 5) for e, x in whole.items()}
        df_, n = {}, {}
        for (_, c), (ids, _n) in tf.items():
            n[c] = n.get(c, 0) + 1
            for i in ids.tolist():
                df_[c, i] = df_.get((c, i), 0) + 1
        vec = {e: {i: (1 + math.log(m)) * (math.log((1 + n[e[1]]) / (1 + df_[e[1], i])) + 1) for i, m in zip(ids.tolist(), ms.tolist()) if df_[e[1], i] >= 3} for e, (ids, ms) in tf.items()}
        size = {e: math.sqrt(sum(w * w for w in v.values())) for e, v in vec.items()}
        want = set()
        for a in [e for e in vec if e[0].startswith("S1-")]:
            found = {}
            for b in [e for e in vec if e[1] == a[1] and not e[0].startswith("S1-")]:
                sim = round(sum(w * vec[b].get(i, 0.0) for i, w in vec[a].items()) / (size[a] * size[b]), 9) if size[a] and size[b] else 0.0
                if sim >= 0.1:
                    found.setdefault(b[0][:3] if by_source else "", []).append((-sim, b[0]))
            want |= {(a[0], t, i + 1) for x in found.values() for i, (_, t) in enumerate(sorted(x)[:k])}
        assert {(x.s1_id, x.t_id, x["rank"]) for x in got.collect()} == want != set()


def test_long_subsequences_take_a_step_for_each_character_of_the_shorter(monkeypatch):
    r = random.Random(6)
    some = lambda n: "".join(r.choice("abc é𝄞") for _ in range(n))
    long = some(900)
    pairs = [(some(r.randint(65, 200)), r.choice([long, some(r.randint(65, 400))])) for _ in range(40)]
    made = []
    places = similarity.Places
    monkeypatch.setattr(similarity, "Places", lambda text: made.append(text) or places(text))
    assert similarity.lcs_lengths(*zip(*pairs)).tolist() == [slow_lcs(*p) for p in pairs]
    assert made.count(long) == 1 and all(len(x) >= 65 for x in made)  # places of a longer side are made once


def test_features_send_names_and_addresses_only(spark):
    df = some_records(spark)
    a, t = df.where("entity_id LIKE 'S1-%'"), df.where("entity_id NOT LIKE 'S1-%'")
    rows = features.pair_features(blocking.overlap_join(a, t, BlockingParams()).select("s1_id", "t_id"), a, t)
    sent = [x for x in plan(rows).split("\n") if "REPARTITION_BY_NUM" in x]
    assert len(sent) == 2
    before = rows._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1:]
    assert len(before) == 2 and not any("addr_sorted" in x.split("Join")[0].split("\n", 1)[1] for x in before)


def plain_token_sets(x, y):
    x, y = set(x.split()), set(y.split())
    both, left, right = (" ".join(sorted(z)) for z in (x & y, x - y, y - x))
    if not x or not y:
        return 0.0
    if both and (not left or not right):
        return 100.0
    ratio = lambda s, t: 200.0 * slow_lcs(s, t) / (len(s) + len(t))
    whole = [f"{both} {z}".strip() for z in (left, right)]
    return max([ratio(*whole), *([ratio(both, w) for w in whole] if both else [])])


def test_token_sets_skip_subsequences_that_decide_nothing(monkeypatch):
    r = random.Random(8)
    some = lambda k: " ".join(r.choice(["acme", "steel", "works", "blue", "ocean", "12", "café", "x", "𝄞"]) + r.choice("ab ") for _ in range(k))
    pairs = [(some(r.choice([0, 1, 3, 9])), some(r.choice([0, 2, 12, 40]))) for _ in range(300)]
    monkeypatch.setattr(similarity, "_SETS", 200)
    asked = []
    lengths = similarity.lcs_lengths
    monkeypatch.setattr(similarity, "lcs_lengths", lambda a, b: asked.extend(zip(a, b)) or lengths(a, b))
    assert similarity.token_sets(*zip(*pairs)) == [plain_token_sets(*p) for p in pairs]
    asked.clear()
    short, long = "alpha beta gamma rest", "alpha beta gamma " + " ".join(f"word{i}" for i in range(60))
    assert similarity.token_sets([short], [long]) == [plain_token_sets(short, long)] and not asked


def test_blocks_give_ranked_rows_without_a_window(spark):
    df = some_records(spark)
    a, t = df.where("entity_id LIKE 'S1-%'"), df.where("entity_id NOT LIKE 'S1-%'")
    p = BlockingParams(pool=4)
    assert "Window" not in plan(blocking.overlap_topk(a, t, p)) and "counts" in plan(blocking.overlap_topk(a, t, p))
    a = a.union(a.where("country = 'US'").withColumn("country", F.lit("FR")))  # ids in two countries are ranked over both
    rows = lambda dense: {tuple(x) for x in blocking.overlap_topk(a, t, BlockingParams(dense=dense, pool=4)).select("s1_id", "t_id", "overlap", "rank").collect()}
    assert rows(0) == rows(1 << 40) != set()


def test_several_blocks_of_targets(spark, monkeypatch):
    monkeypatch.setattr(blocking, "_MOST", 8)
    df = some_records(spark, 90)
    a, t = df.where("entity_id LIKE 'S1-%'"), df.where("entity_id NOT LIKE 'S1-%'")
    for pool in (3, 100):
        rows = lambda dense: {tuple(x) for x in blocking.overlap_topk(a, t, BlockingParams(dense=dense, pool=pool)).select("s1_id", "t_id", "overlap", "rank").collect()}
        assert rows(0) == rows(1 << 40) != set()


def test_addresses_end_with_scoring(spark):
    name = lambda i: ["blue ocean", "blueocean", "acme", "acme steel"][i % 4]
    where = lambda i: ["1 road road 11111", "2 road 22222 some other", "", "  "][i // 4 % 4]
    a = records(spark, [(f"S1-{i}", "US", name(i), where(i)) for i in range(16)])
    t = records(spark, [(f"S{2 + i % 2}-{i}", "US", name(i // 2), where(i // 2)) for i in range(90)])
    p = BlockingParams(per_source=2)
    got = blocking.candidate_pairs(a, t, p)
    assert not {"a_addr", "b_addr"} & set(got.columns) and {"a_placed", "b_placed"} <= set(got.columns)
    sorted_ = [x for x in plan(got).split("\n") if "Exchange hashpartitioning(s1_id" in x and "source" in x]
    assert sorted_ and "_addr" not in plan(got).split("Window")[1]
    pool = blocking.scoring_pool(a, t, p)
    want = blocking.top_candidates(blocking.dual_channel(blocking.guarded(pool, a, t, p), p), p)
    columns = ["s1_id", "t_id", "rank", "score", "addr_score", "name_set"]
    assert sorted(got.select(*columns).collect()) == sorted(want.select(*columns).collect()) != []
    assert blocking.guarded(pool, a, t, p, scoring=True, best=True).count() < blocking.guarded(pool, a, t, p).count()
    light = blocking.candidate_pairs(a, t, p, all_sets=False)
    assert sorted(light.select(*columns[:4]).collect()) == sorted(want.select(*columns[:4]).collect())
    assert light.where("addr_set IS NULL").count() == light.where("a_squash <> '' AND a_squash = b_squash AND a_placed AND b_placed").count() > 0
    judged = lambda df: {(x.s1_id, x.t_id, x.combined, x["rank"]) for x in assignment.exclusive(assignment.decide(df.withColumn("p", F.col("score") / 100), 0.8)).collect()}
    assert judged(got) == judged(want) != set()
