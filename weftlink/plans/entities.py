"""The business registry that the queries run on, as a view of the documents table.

Each document is a record of one of three sources: the number of its source follows from its id, its country is
its language, the first five words are the business name, all other words of the text, with a number before and a postal code behind
them, the address. S1 is the reference source, S2 and S3 hold the targets. Documents of equal text are true matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.functions import normalize as N

NAME_WORDS = 5
#: Bytes for each core below which a table is dealt out.
SMALL = 32 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def entity_id() -> Column:
    return F.concat(F.lit("S"), (1 + F.col("doc_id") % 3).cast("string"), F.lit("-"), F.col("doc_id").cast("string"))


def entities(docs: DataFrame) -> DataFrame:
    """entity_id, country, business_name, business_address."""
    rows = docs.where("doc_id IS NOT NULL").select(entity_id().alias("entity_id"), F.col("lang").alias("country"), "n_chars", N.pieces(F.lower(F.coalesce("text", F.lit("")))).alias("w"))
    rest = F.slice("w", F.lit(NAME_WORDS + 1), F.greatest(F.size("w") - NAME_WORDS, F.lit(0)))
    return rows.select(
        "entity_id", "country", F.array_join(F.slice("w", 1, NAME_WORDS), " ").alias("business_name"),
        F.concat_ws(" ", (F.col("n_chars") % 100).cast("string"), F.array_join(rest, " "), (10000 + F.col("n_chars") % 50).cast("string")).alias("business_address"))


def spread(docs: DataFrame) -> DataFrame:
    """A small table that stands in few files dealt out over all cores, since work on whole texts is dear; a large one stays as it is read."""
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return docs.repartition(4 * cores) if size < cores * SMALL else docs


def records(rows: DataFrame) -> DataFrame:
    """Entities with normalised name and address."""
    return rows.select("entity_id", "country", N.normalize_name("business_name").alias("name"), N.normalize_address("business_address").alias("address"))


def reference(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("entity_id").startswith("S1-"))


def targets(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("entity_id").startswith("S1-"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1_id, t_id) of documents with equal text, joined by a digest of it."""
    rows = documents(spark, sf_dir).where("doc_id IS NOT NULL AND text IS NOT NULL").select(entity_id().alias("entity_id"), F.md5(F.col("text").cast("binary")).alias("digest"))
    left, right = reference(rows).withColumnRenamed("entity_id", "s1_id"), targets(rows).withColumnRenamed("entity_id", "t_id")
    return left.join(right, "digest").select("s1_id", "t_id")
