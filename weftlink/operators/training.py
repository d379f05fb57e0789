"""Training pairs, entity-level splits, the boosted-tree matcher and its threshold.

Differences from the plain recipe, on purpose: targets are sampled by a hash for each source, so the
source doesn't give the label away, and train and test are split by record, so no record is on both sides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftlink.functions.normalize import source_of
from weftlink.operators.evaluation import best_threshold, threshold_sweep
from weftlink.operators.features import FEATURES


def bucket(x: Column, n: int) -> Column:
    """A number from 0 to n - 1 that depends on the string alone, the same in any engine that has md5."""
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("long") % n


def positive_pairs(truth: DataFrame, targets: DataFrame) -> DataFrame:
    """True pairs whose target is at hand."""
    return truth.join(targets.select(F.col("entity_id").alias("t_id")), "t_id", "left_semi").select("s1_id", "t_id")


def target_sample(targets: DataFrame, truth: DataFrame, keep: int, of: int) -> DataFrame:
    """Targets that are true matches, and a share of keep / of of all others of each source, by hash."""
    needed = truth.select(F.col("t_id").alias("entity_id")).distinct().withColumn("needed", F.lit(True))
    rows = targets.join(needed, "entity_id", "left")
    return rows.where(F.col("needed") | (bucket(F.col("entity_id"), of) < keep)).select("entity_id", source_of("entity_id").alias("source"), F.coalesce("needed", F.lit(False)).alias("needed"))


def hard_negatives(ranked: DataFrame, truth: DataFrame, per_record: int = 4) -> DataFrame:
    """The first wrong targets of each record by shared tokens (``ranked`` has s1_id, t_id, rank)."""
    wrong = ranked.join(truth, ["s1_id", "t_id"], "left_anti")
    order = W.partitionBy("s1_id").orderBy("rank")
    return wrong.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_record).select("s1_id", "t_id", "rn")


def entity_split(pairs: DataFrame, folds: int = 5) -> DataFrame:
    """Adds held_out: a fifth of the records, with all of their pairs."""
    return pairs.withColumn("held_out", bucket(F.col("s1_id"), folds) == 0)


@dataclass(frozen=True)
class MatcherParams:
    step: float = 0.06
    depth: int = 5
    iterations: int = 60  #: at most
    gain: float = 0.001  #: relative gain in log loss, on records kept for it, below which boosting stops
    subsample: float = 0.85
    features: str = "0.85"
    least: int = 20
    seed: int = 42


@dataclass(frozen=True)
class Matcher:
    model: PipelineModel
    threshold: float

    def score(self, features: DataFrame) -> DataFrame:
        """``features`` with p, the probability of a match."""
        out = self.model.transform(features)
        return out.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    def importances(self) -> list[tuple[str, float]]:
        gains = self.model.stages[-1].featureImportances.toArray().tolist()
        return sorted(zip(FEATURES, gains), key=lambda x: (-x[1], x[0]))

    def save(self, path: str) -> None:
        """Model and a one-row table of its threshold and features, in any store Spark writes to."""
        self.model.write().overwrite().save(f"{path}/model")
        from pyspark.sql import SparkSession

        row = [(self.threshold, list(FEATURES))]
        SparkSession.active().createDataFrame(row, "threshold double, features array<string>").write.mode("overwrite").parquet(f"{path}/about")

    @staticmethod
    def load(path: str) -> Matcher:
        from pyspark.sql import SparkSession

        about = SparkSession.active().read.parquet(f"{path}/about").head()
        return Matcher(PipelineModel.load(f"{path}/model"), about["threshold"])


def train_matcher(labelled: DataFrame, params: MatcherParams = MatcherParams()) -> Matcher:
    """Fit on rows with the features, s1_id and label, by log loss, until records kept apart gain no more; the threshold is the best one for records that are held out."""
    p = params
    rows = entity_split(labelled).persist()  # boosting reads them once for each tree
    learned = rows.where("NOT held_out").withColumn("judges", bucket(F.concat("s1_id", F.lit("/stop")), 8) == 0)
    learner = GBTClassifier(labelCol="label", featuresCol="features", stepSize=p.step, maxDepth=p.depth, maxIter=p.iterations, subsamplingRate=p.subsample,
                            featureSubsetStrategy=p.features, minInstancesPerNode=p.least, seed=p.seed, lossType="logistic", validationTol=p.gain)
    if learned.where("judges").head(1):
        learner.setValidationIndicatorCol("judges")
    model = Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), learner]).fit(learned)
    best = best_threshold(threshold_sweep(Matcher(model, 0.5).score(rows.where("held_out")))).head()
    rows.unpersist()
    return Matcher(model, best["threshold"] if best else 0.5)
