import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tests.llm.awkward import docs
from weftlink.llm.quality import STATISTICS, QualityParams, RuleModel, fit_rules, score_quality, statistics, train_quality

LABELS = "doc_id long, quality int, toxic int"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_rules_find_a_conjunction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] <= 0.6)).astype(float)
    m = fit_rules(x, y, ("a", "b", "c", "d"), QualityParams())
    total = m.intercept + sum(w * np.all([(x[:, f] <= t) if le else (x[:, f] > t) for f, le, t in r], axis=0) for w, r in m.rules)
    assert ((total > 0) == y).mean() > 0.97 and len(m.rules) < 80
    assert fit_rules(x, y, ("a", "b", "c", "d"), QualityParams()) == m


def test_column_equals_numpy(spark):
    m = RuleModel(("a", "b"), -0.5, ((1.5, ((0, True, 0.4), (1, False, 0.2))), (-2.0, ((1, True, 0.9),))))
    rows = [(i / 10, j / 10) for i in range(11) for j in range(11)]
    df = spark.createDataFrame(rows, "a double, b double").select("a", "b", m.column(F.struct("a", "b")).alias("s"))
    for r in df.collect():
        assert r.s == pytest.approx(1 / (1 + np.exp(0.5 - 1.5 * (r.a <= 0.4 and r.b > 0.2) + 2.0 * (r.b <= 0.9))))


def plain_statistics(t):
    """The statistics again, character by character."""
    chars, words, lines = max(1, len(t)), regex.split(r"[ \n\t\r]+", t), t.split("\n")
    share = lambda kind: len(regex.findall(kind, t)) / chars
    return {"chars": len(t), "upper_share": share(r"\p{Lu}"), "digit_share": share("[0-9]"), "symbol_share": share(r"""[^\p{L}\p{N} \t\n\x0B\f\r.,;:!?'"()\-]""") if t else 1.0, "bang_share": share("!"), "bar_share": share(r"\|"),
            "stop_share": share(r"\."), "comma_share": share(","), "word_length": chars / len(words), "distinct_words": len(set(words)) / len(words), "line_length": chars / len(lines), "repeated_lines": 1 - len(set(lines)) / len(lines)}


def test_statistics_and_scores_equal_a_plain_form(spark):
    """Every statistic, and the score that follows from it, text by text."""
    sf = "/root/testdata/sf0.001"
    d = docs(spark).select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    model = train_quality(d, spark.read.parquet(f"{sf}/labels.parquet"))
    own = F.coalesce("text", F.lit(""))
    for r in d.select("text", statistics(own).alias("s"), F.transform(F.array(statistics(own)), lambda x: model.column(x))[0].alias("score")).collect():
        want = plain_statistics(r.text or "")
        assert r.s.asDict() == pytest.approx(want) and tuple(want) == STATISTICS
        x = [r.s[n] for n in STATISTICS]
        total = model.intercept + sum(w for w, rule in model.rules if all((x[f] <= t) if le else (x[f] > t) for f, le, t in rule))
        assert r.score == pytest.approx(1 / (1 + np.exp(-total)))


def test_ids_with_several_texts_are_learnt_once(spark):
    """Whatever their number and order."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    more = d.unionByName(d.withColumn("text", F.concat("text", F.lit(" more"), "text"))).unionByName(d)
    assert train_quality(more, labels) == train_quality(more.orderBy(F.desc("text")), labels)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = score_quality(d, train_quality(d, labels)).join(labels, "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert out and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == r.quality for r in out]) >= 0.95
    assert np.mean([r.predicted for r in out if r.quality == 1]) >= 0.97


def test_held_out_labels_have_no_say(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert train_quality(d, labels) == train_quality(d, turned)


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(1, None, 0), (None, 1, 0)], 0.5), ([(5, 1, 0), (7, 1, 0), (8, 1, 1)], 1.0)])
def test_awkward_documents(spark, labels, score):
    model = train_quality(docs(spark), spark.createDataFrame(labels, LABELS).withColumn("text", F.lit("x")))
    rows = score_quality(docs(spark), model).collect()
    assert len(rows) == 10 and all(r.score == pytest.approx(score, abs=1e-5) and r.predicted == 1 for r in rows)
    assert score_quality(docs(spark, []), model).collect() == []
    assert [r.held_out for r in rows if r.doc_id is None] == [True]
