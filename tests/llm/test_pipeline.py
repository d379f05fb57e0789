import corpus_pipeline
from tests.llm.awkward import ROWS, docs
from tests.llm.test_minhash_dedup import A, B, brute
from tests.llm.test_packing import check
from weftlink.llm import quality, secret_scan


def plain(spark, d, labels):
    """The first three stages again: classifier by its score, near copies from all pairs, secrets text by text."""
    model = quality.train_quality(d, labels)
    scores = {r.doc_id: r.predicted for r in quality.score_quality(d, model).collect()}
    rows = [r for r in d.collect() if scores[r.doc_id] == 1]
    classes = brute([(r.doc_id, r.text) for r in rows])
    rows = [r for r in rows if classes[r.doc_id] == r.doc_id]
    forest = secret_scan.default_forest()
    import numpy as np

    out = []
    for r in rows:
        found = secret_scan.candidates(r.text)
        s = forest.scores(np.asarray([secret_scan.features(r.text, a, b, forest.params.context) for a, b, _ in found])) if found else []
        text = r.text
        for (a, b, _), v in reversed(list(zip(found, s))):
            text = text[:a] + forest.params.mask + text[b:] if v >= forest.params.threshold else text
        out.append((r.doc_id, text))
    return out


def test_run_equals_the_plain_form(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain(spark, d, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert 0 < len(want) < d.count()
    check(corpus_pipeline.run(spark, sf_dir).collect(), want)


def test_stages_take_awkward_documents(spark, sf_dir):
    d = docs(spark, [*ROWS, (None, "some words here", None, None)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, sf_dir)
        assert out.columns == d.columns
        assert stage(spark, docs(spark, []), sf_dir).count() == 0
    kept = corpus_pipeline.near_dedup_stage(spark, d, sf_dir).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, [1, 2, 3, 5, 7, 8, 9, None]))
    assert corpus_pipeline.packing_stage(spark, d, sf_dir).count() >= 11 and corpus_pipeline.packing_stage(spark, docs(spark, []), sf_dir).count() == 0


def test_near_dedup_keeps_a_text_under_a_repeated_id(spark, sf_dir):
    d = docs(spark, [(3, A, "en", "a"), (5, A, "en", "a"), (5, B, "en", "a")])
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_dedup_stage(spark, d, sf_dir).collect()) == [(3, A), (5, B)]


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "secret scans", "best-fit packing"] and corpus_pipeline.ORACLE_SQL is None
