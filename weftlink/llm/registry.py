"""Queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm import bpe, chat_format, embedding_dedup, license_scan, minhash_dedup, packing, pivot_search, quality, secret_scan, token_count
from weftlink.llm.common import table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.dedup_documents(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.PackParams(public_tokenizers.path("byte_bpe_50k.json")))


def op3_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes, decodes what it has encoded, and digests both."""
    params = bpe.BpeParams(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.encode(table(spark, sf_dir, "documents"), params)
    coded = coded.withColumn("decoded", bpe.decode_column(F.col("ids"), bpe.load_ranks(params.ranks)))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), token_count.CountParams(public_tokenizers.path("piece_bpe_32k.model")))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and conversation -7, and reads the digests back from the formatted text."""
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    messages = rows.unionByName(more).select("conv_id", "turn", "role", chat_format.text_parts(F.col("text")).alias("parts"))
    chats = chat_format.format_chats(messages)
    turns = chat_format.parse_formatted(F.col("formatted"))
    said_all = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    chats = chats.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(said_all.cast("binary"), 256).alias("turns_sha256"),
                         chat_format.loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return chats.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = pivot_search.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256.0)
    return pivot_search.top_k(vectors, "id % 50 = 0", pivot_search.SearchParams(k=5))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"), secret_scan.default_forest())


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train_quality(docs, table(spark, sf_dir, "labels")))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup_vectors(table(spark, sf_dir, "embeddings"))


_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_TOP_K_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE vec_id IS NOT NULL AND {_USABLE}),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

_DEDUP_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common c JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE c.n >= 0.8 * (p.n + q.n - c.n)),
reach(id, other) AS (SELECT doc_id, doc_id FROM words UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other),
classes AS (SELECT id, min(other) AS class_id FROM reach GROUP BY id)
SELECT id AS doc_id, class_id, coalesce(n, 0) AS n_shingles, id = class_id AS kept FROM classes LEFT JOIN sizes ON sizes.doc_id = id"""

_VECTOR_DEDUP_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {_USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(id, other) AS (
  SELECT vec_id, vec_id FROM embeddings WHERE vec_id IS NOT NULL
  UNION SELECT reach.id, p.b FROM reach JOIN p ON p.a = reach.other),
c AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT c.id AS vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.id = c.component_id AS kept FROM c LEFT JOIN n ON n.a = c.id"""


def _chat_sql() -> str:
    t = chat_format.ChatTemplate()

    def esc(x: str) -> str:
        out = f"replace({x}, '\\', '\\\\')"
        for c in t.controls:
            out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
        return out

    fixed = len(t.turn_open) + len(t.body_open) + len(t.turn_close)
    return f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, {esc('text')})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, {esc('text')}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({fixed} + length({esc('role')}) + length({esc('text')})) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_byte_level_bpe": op3_byte_level_bpe,
        "op4_token_counts": op4_token_counts,
        "op5_chat_formatting": op5_chat_formatting,
        "op6_exact_top_k": op6_exact_top_k,
        "op7_secret_scans": op7_secret_scans,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_license_scans": op9_license_scans,
        "op10_embedding_near_dedup": op10_embedding_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": _DEDUP_SQL, "op5_chat_formatting": _chat_sql(), "op6_exact_top_k": _TOP_K_SQL, "op10_embedding_near_dedup": _VECTOR_DEDUP_SQL}
