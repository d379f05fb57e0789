"""The 22 features of a pair, in their fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftlink.functions import normalize as N
from weftlink.functions.similarity import partial_ratio, ratio, sorted_words, with_token_set

# Names and order of the features.
FEATURES = (
    "n_ts_ratio", "n_sort_ratio", "n_ratio", "n_partial", "n_sq_ratio", "n_exact", "n_first_token_ratio", "n_first_token_exact", "n_containment", "n_len_ratio", "len_diff",
    "a_ts_ratio", "a_sort_ratio", "a_containment", "num_jaccard", "num_exact", "a_postal_match", "a_postal_conflict", "a_first_num_match", "addr_empty", "is_s2", "is_s3",
)


def texts(records: DataFrame, side: str) -> DataFrame:
    return records.select(F.col("entity_id").alias("s1_id" if side == "a" else "t_id"), F.col("name").alias(f"{side}_name"), F.col("address").alias(f"{side}_addr"))


def prepared(rows: DataFrame, side: str) -> DataFrame:
    """``rows`` with word lists and number sets of one side's name and address."""
    name, address = f"{side}_name", f"{side}_addr"
    return rows.select(
        "*", N.squash(name).alias(f"{side}_squash"), N.words(name).alias(f"{side}_words"), F.array_distinct(N.words(address)).alias(f"{side}_places"),
        sorted_words(F.col(name)).alias(f"{side}_name_sorted"), sorted_words(F.col(address)).alias(f"{side}_addr_sorted"),
        N.number_set(address).alias(f"{side}_numbers"), N.number_set(address, 5, 6).alias(f"{side}_postals"), N.first_number(address).alias(f"{side}_first"))


def _flag(test: Column) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), 1.0).otherwise(0.0)


def _containment(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / F.greatest(least, F.lit(1))).otherwise(0.0)


def pair_features(pairs: DataFrame, records: DataFrame, targets: DataFrame) -> DataFrame:
    """s1_id, t_id and the features of each pair (other columns of ``pairs`` stay).

    Only names and addresses travel; what follows from them is several times as long, and is made behind the shuffle by target. That has a
    fixed number of parts, since pairs are small beside the work of comparing them and Spark would merge parts by size.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = prepared(pairs.join(texts(records, "a"), "s1_id").repartition(parts, "t_id"), "a")
    rows = a.join(prepared(texts(targets, "b").repartition(parts, "t_id"), "b"), "t_id")
    rows = with_token_set(with_token_set(rows, "a_name", "b_name", "names_as_sets"), "a_addr", "b_addr", "places_as_sets")
    c = F.col
    empty = (c("a_addr") == "") | (c("b_addr") == "")
    a_first, b_first = F.get("a_words", F.lit(0)), F.get("b_words", F.lit(0))
    worded = a_first.isNotNull() & b_first.isNotNull()
    long, short = F.greatest(F.length("a_name"), F.length("b_name")), F.least(F.length("a_name"), F.length("b_name"))
    none = (F.size("a_numbers") == 0) & (F.size("b_numbers") == 0)
    some = (F.size("a_numbers") > 0) & (F.size("b_numbers") > 0)
    shared = F.size(F.array_intersect("a_numbers", "b_numbers"))
    coded = (F.size("a_postals") > 0) & (F.size("b_postals") > 0)
    addressed = lambda x, other=0.0: F.when(empty, other).otherwise(x)
    values = {
        "n_ts_ratio": c("names_as_sets"),
        "n_sort_ratio": ratio(c("a_name_sorted"), c("b_name_sorted")),
        "n_ratio": ratio(c("a_name"), c("b_name")),
        "n_partial": partial_ratio(c("a_name"), c("b_name")),
        "n_sq_ratio": ratio(c("a_squash"), c("b_squash")),
        "n_exact": _flag((c("a_name") != "") & (c("a_name") == c("b_name"))),
        "n_first_token_ratio": F.when(worded, ratio(a_first, b_first)).otherwise(0.0),
        "n_first_token_exact": _flag(a_first == b_first),
        "n_containment": _containment(F.array_distinct("a_words"), F.array_distinct("b_words")),
        "n_len_ratio": F.when(long > 0, short / F.greatest(long, F.lit(1))).otherwise(1.0),
        "len_diff": (long - short).cast("double"),
        "a_ts_ratio": addressed(c("places_as_sets")),
        "a_sort_ratio": addressed(ratio(c("a_addr_sorted"), c("b_addr_sorted"))),
        "a_containment": addressed(_containment(c("a_places"), c("b_places"))),
        "num_jaccard": addressed(F.when(some, shared / F.greatest(F.size(F.array_union("a_numbers", "b_numbers")), F.lit(1))).when(none, 0.5).otherwise(0.0)),
        "num_exact": addressed(F.when(some, _flag(shared > 0)).when(none, 0.5).otherwise(0.0)),
        "a_postal_match": addressed(_flag(coded & F.arrays_overlap("a_postals", "b_postals"))),
        "a_postal_conflict": addressed(_flag(coded & ~F.arrays_overlap("a_postals", "b_postals"))),
        "a_first_num_match": addressed(F.when(c("a_first").isNotNull() & c("b_first").isNotNull(), _flag(c("a_first") == c("b_first"))).otherwise(0.5), 0.5),
        "addr_empty": _flag(empty),
        "is_s2": _flag(c("t_id").startswith("S2-")),
        "is_s3": _flag(c("t_id").startswith("S3-")),
    }
    return rows.select(*pairs.columns, *[values[n].alias(n) for n in FEATURES])
