"""What the operators of this subpackage share: table access, staging, joins on hot keys and column checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it has more than this part of all rows, so there are fewer hot keys than this.
HOT_KEYS = 4000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, through Spark's reader, so that any path Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and everything runs on one
    machine (tests) is a temporary folder made, and kept in the session's settings for later calls.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.weftlink.staging", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="weftlink-")
        spark.conf.set("spark.weftlink.staging", named)
    return named.rstrip("/")


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/weftlink/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    ``discard`` removes the folder once nothing reads it any more, ``discard_all`` those of a whole application.
    """
    spark = df.sparkSession
    path = f"{_home(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Remove what ``staged`` wrote, for tables that no later action reads."""
    for df in tables:
        if path := getattr(df, "_staged_at", None):
            _delete(df.sparkSession, path)


def discard_all(spark: SparkSession) -> None:
    """Remove everything that this application has staged. Results not yet written are lost with it."""
    _delete(spark, _home(spark))


def is_empty(df: DataFrame) -> bool:
    return not df.head(1)


def join_hot(rows: DataFrame, keys: DataFrame, on: list[str], total: int, n: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``keys``, which has each key once and in ``n`` its number of rows; ``total`` is their sum at least.

    Keys of more than ``total / HOT_KEYS`` rows, fewer than HOT_KEYS therefore, are broadcast, so that their rows stay where they
    are; the rows of all others are shuffled by key.
    """
    most = max(1, total // HOT_KEYS)
    hot, cold = F.broadcast(keys.where(F.col(n) > most)), keys.where(F.col(n) <= most)
    return rows.join(hot, on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have (names compare without regard to case)."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the text operators read, null texts as empty ones."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
