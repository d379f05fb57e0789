"""One query for each operator, over whole tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.functions import normalize as N
from weftlink.functions import similarity as K
from weftlink.operators import assignment, blocking, evaluation, features, search, training, validation
from weftlink.plans import batch
from weftlink.plans import entities as E
from weftlink.sources import tsv

#: The operators' own production values; tests give smaller limits, which bind on small tables.
PARAMS = blocking.BlockingParams()
THRESHOLD = 0.80
MATCHER = training.MatcherParams()


class View:
    """What the queries of one run share; every table is lazy.

    ``rows`` are computed where they are read, which is best for queries that read them once. ``s1`` and ``t`` stand on
    a persisted copy of the normalised records: joins read them up to eight times, and normalising is dearer than reading.
    A lost part of that copy is computed again from the table.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, params: blocking.BlockingParams = PARAMS):
        self.spark, self.sf_dir, self.params = spark, sf_dir, params
        self.raw = E.entities(E.spread(E.documents(spark, sf_dir)))
        self.rows = E.records(self.raw)

    @cached_property
    def kept(self) -> DataFrame:
        return self.rows.persist()

    @property
    def s1(self) -> DataFrame:
        return E.reference(self.kept)

    @property
    def t(self) -> DataFrame:
        return E.targets(self.kept)

    @property
    def truth(self) -> DataFrame:
        return E.truth(self.spark, self.sf_dir)

    def topk(self) -> DataFrame:
        return blocking.overlap_topk(self.s1, self.t, self.params)

    def pool(self) -> DataFrame:
        return blocking.with_records(blocking.candidate_pool(self.s1, self.t, self.params), self.s1, self.t)

    def scored(self) -> DataFrame:
        pool = blocking.candidate_pool(self.s1, self.t, self.params)
        return blocking.dual_channel(blocking.guarded(pool, self.s1, self.t, self.params, scoring=True), self.params)

    def candidates(self, all_sets: bool = False) -> DataFrame:
        return blocking.candidate_pairs(self.s1, self.t, self.params, all_sets)

    def judged(self, all_sets: bool = False) -> DataFrame:
        """Candidates with a probability: the fixed score, from 0 to 1."""
        return self.candidates(all_sets).withColumn("p", F.round(F.col("score") / 100.0, 6))

    def matches(self, all_sets: bool = False) -> DataFrame:
        return assignment.decide(self.judged(all_sets), THRESHOLD)

    def exclusive(self) -> DataFrame:
        return assignment.exclusive(self.matches(all_sets=True))

    def final(self) -> DataFrame:
        return self.exclusive().where("rank = 1")

    def labelled(self) -> DataFrame:
        """Training pairs: true ones and hard wrong ones, with features and label."""
        true = self.truth.withColumn("label", F.lit(1))
        wrong = training.hard_negatives(self.topk(), self.truth).select("s1_id", "t_id", F.lit(0).alias("label"))
        return features.pair_features(true.unionByName(wrong), self.s1, self.t)


def _joined(x: Column) -> Column:
    return F.array_join(x, ",")


def _r(*names: str) -> list[Column]:
    return [F.round(n, 4).alias(n) for n in names]


def _pair_kernel(kernel, name: str):
    def query(v: View) -> DataFrame:
        pairs = v.topk().join(v.s1.select(F.col("entity_id").alias("s1_id"), F.col("name").alias("a")), "s1_id").join(v.t.select(F.col("entity_id").alias("t_id"), F.col("name").alias("b")), "t_id")
        scored = K.with_token_set(pairs, "a", "b", "k") if kernel is K.token_set_ratio else pairs.withColumn("k", kernel(F.col("a"), F.col("b")))
        return scored.select("s1_id", "t_id", F.round("k", 4).alias(name))

    return query


def _squash(strong: bool):
    return lambda v: v.rows.select("entity_id", N.squash("name", strong).alias("squash"))


def _cosine(weight: str, least: int, most: int, min_df: int, k: int, min_sim: float, by_source: bool):
    def query(v: View) -> DataFrame:
        vectors = blocking.count_vectors(v.kept, least, most) if weight == "count" else blocking.tfidf_vectors(v.kept, least, most, min_df)
        return blocking.cosine_topk(vectors, v.t, k, min_sim, by_source).select("s1_id", "t_id", "sim", "rank")

    return query


def _result_file(v: View) -> tuple[DataFrame, DataFrame]:
    """A result file with one fault in most of its rows, and a candidate file."""
    faults = F.expr("""CASE doc_id % 8 WHEN 0 THEN 'S2-1,S2-1' WHEN 1 THEN 'S1-5' WHEN 2 THEN 'X-1' WHEN 3 THEN 'S2-4,' WHEN 4 THEN ''
        WHEN 5 THEN 'S3-99999999' WHEN 6 THEN 'S2-1' ELSE concat('S2-', 1 + doc_id - doc_id % 3) END""")
    docs = E.documents(v.spark, v.sf_dir).where("doc_id IS NOT NULL")
    rows = docs.select(E.entity_id().alias("id"), F.col("doc_id"), faults.alias("list")).withColumn("line", F.concat("id", F.when(F.col("doc_id") % 8 == 6, " ").otherwise("\t"), "list"))
    twice = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("doc_id") % 50 == 0, 1).otherwise(0)))).select("id", "list", "line")
    return twice, rows.select("id", F.when(F.col("doc_id") % 16 == 7, "").otherwise(F.col("list")).alias("list"), "line")


def _validate(v: View) -> DataFrame:
    """All rules on that file."""
    rows, candidates = _result_file(v)
    findings = validation.list_findings(rows, v.s1, v.t)
    return validation.report([*findings, validation.not_candidates(rows, candidates)])


def _search(v: View) -> DataFrame:
    counts = v.topk().groupBy(F.col("s1_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("match_count"))
    rows = v.s1.join(counts, "entity_id", "left").fillna(0, ["match_count"]).select("entity_id", "country", "name", "address", "match_count")
    return search.entity_search(rows, text="an", country="EN", status="MATCHED")


def _hydrated(v: View) -> DataFrame:
    pairs = v.topk().select("s1_id", F.when(F.col("rank") == PARAMS.pool, F.concat("t_id", F.lit("x"))).otherwise(F.col("t_id")).alias("t_id"))
    return search.hydrated(pairs, v.t)


def _lists(v: View) -> DataFrame:
    return blocking.id_lists(v.s1, v.candidates(), [F.col("source"), F.col("rank")], "candidates")


def _match_lists(v: View) -> DataFrame:
    return blocking.id_lists(v.s1, v.final(), [F.substring("t_id", 1, 2).alias("source"), (-F.col("score")).alias("down")], "matched")


def _importances(v: View) -> DataFrame:
    gains = training.train_matcher(v.labelled(), MATCHER).importances()[:8]
    return v.spark.createDataFrame(gains, "feature string, gain double")


def _gbt(v: View) -> DataFrame:
    matcher = training.train_matcher(v.labelled(), MATCHER)
    scored = matcher.score(features.pair_features(v.candidates().select("s1_id", "t_id"), v.s1, v.t)).select("s1_id", "t_id", "p")
    return assignment.decide(blocking.with_records(scored, v.s1, v.t), matcher.threshold).select("s1_id", "t_id", F.round("p", 4).alias("p"))


def _hashed(v: View) -> DataFrame:
    """Each vector in short: places, those with a positive value, the sum of all absolute values, and a sum that depends on every place."""
    value = F.col("value")
    by = blocking.hashed_ngrams(v.rows).groupBy("entity_id").agg(F.count(F.lit(1)).alias("places"), F.sum(F.when(value > 0, 1).otherwise(0)).alias("positive"),
                                                                 F.round(F.sum(F.abs(value)), 6).alias("total"), F.sum(F.col("place") * F.signum("value").cast("long")).alias("placed"))
    return by


def _shared(spark: SparkSession, name: str) -> str:
    """A new folder in the place that the cluster shares, or, on one machine without one, a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="weftlink-")
    return f"{place.rstrip('/')}/weftlink/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _batch(v: View) -> DataFrame:
    """From raw files to both result files, read back from them."""
    home = _shared(v.spark, "batch")
    paths = [f"{home}/source{i}.tsv" for i in (1, 2, 3)]
    for i, path in enumerate(paths, 1):
        tsv.write_entities(v.raw.where(F.col("entity_id").startswith(f"S{i}-")), path)
    done = batch.link(v.spark, paths[0], paths[1:], f"{home}/output", batch.by_score, THRESHOLD, v.params)
    read = lambda kind, path: tsv.read_id_lists(v.spark, path).select(F.lit(kind).alias("kind"), "s1_id", _joined(F.col("ids")).alias("ids"))
    return read("candidates", done.candidates).unionByName(read("matches", done.matches))


def _partitions(v: View) -> DataFrame:
    rows = v.rows.select(F.lit("test").alias("split"), N.source_of("entity_id").alias("source"), "country", "entity_id")
    return rows.groupBy("split", "source", "country").agg(F.count(F.lit(1)).alias("records"))


QUERIES: dict[str, Callable[[View], DataFrame]] = {
    "normalize_name": lambda v: v.raw.select("entity_id", N.normalize_name("business_name").alias("name")),
    "normalize_address": lambda v: v.raw.select("entity_id", N.normalize_address("business_address").alias("address")),
    "name_tokens": lambda v: v.rows.select("entity_id", N.name_tokens("name").alias("name_tokens")),
    "text_concat": lambda v: v.rows.select("entity_id", F.concat_ws(" ", "name", "address").alias("whole")),
    "blocking_tokens": lambda v: blocking.postings(v.rows),
    "squash_strong": _squash(True),
    "squash_weak": _squash(False),
    "postal_numbers": lambda v: v.rows.select("entity_id", N.first_postal_code("address").alias("postal"), N.first_number("address").alias("number"), _joined(F.array_sort(N.number_set("address"))).alias("numbers"), _joined(F.array_sort(N.number_set("address", 5, 6))).alias("postals")),
    "source_partitions": _partitions,
    "token_df": lambda v: blocking.token_frequency(v.t),
    "stop_token_prune": lambda v: blocking.pruned_postings(v.t, blocking.frequent_tokens(v.t, PARAMS)),
    "overlap_join": lambda v: blocking.overlap_join(v.s1, v.t, PARAMS),
    "overlap_topk": View.topk,
    "squash_join": lambda v: blocking.squash_join(v.s1, v.t, PARAMS),
    "candidate_pool": lambda v: blocking.candidate_pool(v.s1, v.t, PARAMS),
    "postal_guard": lambda v: blocking.postal_guard(v.pool(), PARAMS).select("s1_id", "t_id"),
    "dual_channel_score": lambda v: v.scored().select("s1_id", "t_id", *_r("sq_score", "name_score", "addr_score", "score")),
    "candidate_pairs": lambda v: v.candidates().select("s1_id", "t_id", "source", *_r("score"), "rank"),
    "candidate_list": _lists,
    "indel_ratio": _pair_kernel(K.ratio, "ratio"),
    "token_sort_ratio": _pair_kernel(K.token_sort_ratio, "ratio"),
    "token_set_ratio": _pair_kernel(K.token_set_ratio, "ratio"),
    "partial_ratio": _pair_kernel(K.partial_ratio, "ratio"),
    "ngram_cosine_topk": _cosine("count", 3, 4, 1, 15, 0.08, True),
    "tfidf_cosine_topk": _cosine("tfidf", 3, 5, 3, 25, 0.0, False),
    "hashed_ngrams": _hashed,
    "pair_features": lambda v: features.pair_features(v.candidates().select("s1_id", "t_id"), v.s1, v.t).select("s1_id", "t_id", *_r(*features.FEATURES)),
    "positive_pairs": lambda v: training.positive_pairs(v.truth, v.t),
    "target_sample": lambda v: training.target_sample(v.t, v.truth, 1, 4),
    "hard_negatives": lambda v: training.hard_negatives(v.topk(), v.truth),
    "entity_split": lambda v: training.entity_split(v.topk().select("s1_id", "t_id")),
    "threshold_sweep": lambda v: _sweep(v).select("threshold", "tp", "n_found", "n_true", *_r("precision", "recall", "f_beta")),
    "best_threshold": lambda v: evaluation.best_threshold(_sweep(v)).select("threshold", *_r("f_beta")),
    "decision_rule": lambda v: v.matches().select("s1_id", "t_id", *_r("p")),
    "collision_targets": lambda v: assignment.collisions(v.matches()),
    "exclusive_assignment": lambda v: v.exclusive().select("s1_id", "t_id", *_r("combined"), "rank"),
    "match_list": _match_lists,
    "pairwise_metrics": lambda v: evaluation.pairwise_metrics(v.final(), v.truth).select("tp", "fp", "fn", *_r("precision", "recall", "f_beta")),
    "macro_fbeta": lambda v: evaluation.macro_fbeta(v.s1, v.final(), v.truth).select("records", *_r("macro_f_beta")),
    "blocking_recall": lambda v: evaluation.blocking_recall(v.topk(), v.truth).select("true_pairs", "found_pairs", *_r("recall")),
    "cosine_recall": lambda v: evaluation.blocking_recall(_cosine("tfidf", 3, 5, 3, 25, 0.0, False)(v), v.truth).select("true_pairs", "found_pairs", *_r("recall")),
    "reduction_ratio": lambda v: evaluation.reduction_ratio(v.topk(), v.s1, v.t).select("pairs", "n_records", "n_targets", F.round("ratio", 6).alias("ratio")),
    "country_rollup": lambda v: evaluation.run_summary(v.s1, v.topk()),
    "validate_report": _validate,
    "validate_counts": lambda v: validation.row_counts(_result_file(v)[0]),
    "exclusivity_summary": lambda v: assignment.exclusivity_summary(v.exclusive()),
    "expand_states": lambda v: v.rows.select("entity_id", N.expand_states("address").alias("address")),
    "entity_search": _search,
    "match_hydration": _hydrated,
    "confidence_label": lambda v: v.judged().select("s1_id", "t_id", assignment.confidence_label(F.col("p"), THRESHOLD).alias("label")),
    "feature_importances": _importances,
    "gbt_match": _gbt,
    "batch_run": _batch,
}


def _sweep(v: View) -> DataFrame:
    true = v.truth.distinct().withColumn("label", F.lit(1))
    return evaluation.threshold_sweep(v.judged().join(true, ["s1_id", "t_id"], "left").select("p", F.coalesce("label", F.lit(0)).alias("label")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(View(spark, sf_dir))) for name, f in QUERIES.items()}
