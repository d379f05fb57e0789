"""Decisions on scored pairs, and exclusive assignment of targets.

Targets belong to one record at most: of several, the one of the best combined similarity wins, ties going to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weftlink.functions.similarity import with_token_set


def _placed(pairs: DataFrame, side: str) -> Column:
    """Whether a side has an address; candidates say so in place of the address."""
    return F.col(f"{side}_placed") if f"{side}_placed" in pairs.columns else F.col(f"{side}_addr") != ""


def decide(scored: DataFrame, threshold: float, name_only: float = 0.90, name_ratio: float = 85.0) -> DataFrame:
    """Pairs that match. Where only the target lacks an address, both probability and name have to be high."""
    lacks = ~_placed(scored, "b") & _placed(scored, "a")
    rows = _with_sets(scored, name_only=True)
    strict = (F.col("p") >= name_only) & (F.col("name_set") >= name_ratio)
    return rows.where((~lacks & (F.col("p") >= threshold)) | (lacks & strict))


def confidence_label(p: Column, threshold: float) -> Column:
    return F.when(p >= 0.90, "High Confidence Match").when(p >= threshold, "Match").when(p >= 0.50, "Borderline Non-Match").otherwise("Distinct Businesses")


def collisions(matches: DataFrame) -> DataFrame:
    """(t_id, claims): targets that several records claim."""
    return matches.groupBy("t_id").agg(F.count(F.lit(1)).alias("claims")).where("claims > 1")


def _with_sets(pairs: DataFrame, name_only: bool = False) -> DataFrame:
    """Token set ratios of names and addresses, where scoring hasn't left them."""
    out = pairs if "name_set" in pairs.columns else with_token_set(pairs, "a_name", "b_name", "name_set")
    return out if name_only or "addr_set" in pairs.columns else with_token_set(out, "a_addr", "b_addr", "addr_set")


def exclusive(matches: DataFrame) -> DataFrame:
    """All claims (s1_id, t_id) with combined similarity and their rank for the target; rank 1 stays, the rest are eliminated."""
    both = _placed(matches, "a") & _placed(matches, "b")
    together = F.when(both, F.col("name_set") * 0.70 + F.col("addr_set") * 0.30).otherwise(F.col("name_set") * 0.85)
    ranked = _with_sets(matches).withColumn("combined", F.round(together, 6))
    best = W.partitionBy("t_id").orderBy(F.desc("combined"), "s1_id")
    return ranked.withColumn("rank", F.row_number().over(best))


def exclusivity_summary(ranked: DataFrame) -> DataFrame:
    """One row: claims, kept and eliminated ones, and targets that several records had claimed."""
    gone = F.sum(F.when(F.col("rank") > 1, 1).otherwise(0))
    return ranked.agg(F.count(F.lit(1)).alias("claims"), F.coalesce(F.count(F.lit(1)) - gone, F.lit(0)).alias("kept"), F.coalesce(gone, F.lit(0)).alias("eliminated"),
                      F.coalesce(F.sum(F.when(F.col("rank") == 2, 1).otherwise(0)), F.lit(0)).alias("contested"))
