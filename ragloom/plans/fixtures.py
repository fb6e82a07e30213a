"""The engine's entities bound to the input tables, in Spark and in SQL: tenants are sources, collections languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions.text import content_hash
from ragloom.session import table

WS = r"[\x09-\x0d\x1c-\x20\x{85}\pZ]"


def sql_normal(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g'), '{WS}+', ' ', 'g'), '[。，！？.!?,;；：:]+$', '')"


def sql_hash(x: str) -> str:
    return f"sha256({sql_normal(x)})"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("user_id"), F.col("lang").alias("collection_id"), "text", "n_chars", (F.col("doc_id") % 10 == 0).alias("is_deleted"))


DOCS = "d AS (SELECT doc_id, source AS user_id, lang AS collection_id, text, n_chars, doc_id % 10 = 0 AS is_deleted FROM documents)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each line: chunk_id, document_id, user_id, chunk_index, content, content_hash, chunk_type, parent_chunk_id."""
    rows = documents(spark, sf_dir).select("doc_id", "user_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    cid = lambda i: F.sha2(F.concat_ws(":", F.col("doc_id"), i), 256)
    return rows.select(
        cid(F.col("chunk_index")).alias("chunk_id"), F.col("doc_id").alias("document_id"), "user_id", "chunk_index", "content", content_hash(F.col("content")).alias("content_hash"),
        F.when(F.col("chunk_index") == 0, "parent").otherwise("child").alias("chunk_type"), F.when(F.col("chunk_index") > 0, cid(F.lit(0))).alias("parent_chunk_id"), F.lit(1).alias("page_number"),
    )


CHUNKS = f"""l AS (SELECT doc_id, source AS user_id, unnest(range(len(p)))::INT AS chunk_index, unnest(p) AS content FROM (SELECT *, string_split(text, chr(10)) AS p FROM documents)),
c AS (SELECT sha256(doc_id || ':' || chunk_index) AS chunk_id, doc_id AS document_id, user_id, chunk_index, content, {sql_hash('content')} AS content_hash,
 CASE WHEN chunk_index = 0 THEN 'parent' ELSE 'child' END AS chunk_type, CASE WHEN chunk_index > 0 THEN sha256(doc_id || ':0') END AS parent_chunk_id FROM l)"""


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """content_hash, content (of the first chunk), ref_count (stale where the hash starts with 0), needs_embedding."""
    rows = chunks(spark, sf_dir).groupBy("content_hash").agg(F.min_by("content", F.struct("document_id", "chunk_index")).alias("content"), F.count(F.lit(1)).alias("n"))
    stale = F.col("content_hash").startswith("0")
    return rows.select("content_hash", "content", F.when(stale, F.col("n") + 1).otherwise(F.col("n")).alias("ref_count"), F.col("content_hash").startswith("1").alias("needs_embedding"))


POOL = """p AS (SELECT content_hash, arg_min(content, (document_id, chunk_index)) AS content, count(*) + CASE WHEN content_hash LIKE '0%' THEN 1 ELSE 0 END AS ref_count,
 content_hash LIKE '1%' AS needs_embedding FROM c GROUP BY content_hash)"""
