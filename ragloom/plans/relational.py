"""Tenant-scoped filters, projections, joins, aggregates, pages and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.functions.text import last_contained
from ragloom.operators import clients
from ragloom.operators import pool as pools
from ragloom.operators import retrieval as R
from ragloom.plans.fixtures import CHUNKS, DOCS, POOL, chunks, documents, pool
from ragloom.registry import query
from ragloom.session import table

TENANT = "src3"


@query(f"WITH {DOCS} SELECT doc_id, collection_id, left(text, 50) AS title, n_chars FROM d WHERE user_id = '{TENANT}' AND NOT is_deleted")
def flt1_flt2_tenant_live_documents(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).filter((F.col("user_id") == TENANT) & ~F.col("is_deleted")).select("doc_id", "collection_id", F.left("text", F.lit(50)).alias("title"), "n_chars")


def one_or_none(found: DataFrame) -> DataFrame:
    """The only row of a point lookup; a second one is an error."""
    two = found.limit(2)
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    checked = F.when(n > 1, F.raise_error(F.lit("more than one row"))).otherwise(F.lit(True)).cast("boolean")
    return two.withColumn("_one", checked).filter("_one").drop("_one")


@query(f"WITH {DOCS} SELECT doc_id, user_id FROM d WHERE doc_id = 7 AND user_id = 'src7' AND NOT is_deleted LIMIT 2")
def flt3_point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    found = documents(spark, sf).filter("doc_id = 7 and user_id = 'src7' and not is_deleted").select("doc_id", "user_id")
    return one_or_none(found)


TREE = "SELECT n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_regionkey * 5 END AS parent_id FROM nation"


@query(f"SELECT id, name FROM ({TREE}) WHERE parent_id IS NULL")
def flt4_root_collections(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_regionkey") * 5).alias("parent_id"))
    return rows.filter(F.col("parent_id").isNull()).select("id", "name")


def listed(docs: DataFrame, user: str, collection: str | None = None) -> DataFrame:
    """A tenant's documents; the collection predicate applies only if one is given."""
    found = docs.filter(F.col("user_id") == user)
    return found if collection is None else found.filter(F.col("collection_id") == collection)


@query(f"WITH {DOCS} SELECT doc_id, 'all' AS view FROM d WHERE user_id = '{TENANT}' UNION ALL SELECT doc_id, 'fr' FROM d WHERE user_id = '{TENANT}' AND collection_id = 'fr'")
def flt5_optional_collection(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return listed(docs, TENANT).select("doc_id", F.lit("all").alias("view")).unionByName(listed(docs, TENANT, "fr").select("doc_id", F.lit("fr").alias("view")))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def flt6_in_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "labels").filter("toxic = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query(f"WITH {CHUNKS}, {POOL} SELECT content_hash, ref_count FROM p WHERE ref_count <= 1 AND content_hash <> sha256('')")
def flt7_comparisons(spark: SparkSession, sf: str) -> DataFrame:
    return pool(spark, sf).filter((F.col("ref_count") <= 1) & (F.col("content_hash") != F.sha2(F.lit(""), 256))).select("content_hash", "ref_count")


@query("SELECT d.doc_id FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE e.embedding IS NOT NULL")
def flt8_has_vector(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").join(table(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left").filter(F.col("embedding").isNotNull()).select("doc_id")


@query("SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant')")
def flt9_enum_membership(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").filter(F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role")


@query("SELECT doc_id::VARCHAR AS id, source AS user_id, lang AS language, n_chars AS file_size, 'ready' AS processing_status FROM documents")
def prj1_prj2_document_response(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("user_id"), F.col("lang").alias("language"), F.col("n_chars").alias("file_size"), F.lit("ready").alias("processing_status"))


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name, NULL::VARCHAR AS description, NULL::VARCHAR AS icon, n_regionkey::VARCHAR AS parent_id, 'folder' AS type, n_nationkey AS sort_order FROM nation")
def prj1_collection_response(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), none.alias("description"), none.alias("icon"), F.col("n_regionkey").cast("string").alias("parent_id"), F.lit("folder").alias("type"), F.col("n_nationkey").alias("sort_order"))


@query("SELECT r_regionkey::VARCHAR AS id, r_name AS name, NULL::VARCHAR AS color FROM region")
def prj1_tag_response(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("color"))


@query("SELECT c_custkey::VARCHAR AS id, lower(c_name) || '@example.com' AS email, c_name AS display_name, greatest(round(c_acctbal), 0)::BIGINT AS storage_used FROM customer")
def prj1_user_response(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"), F.col("c_name").alias("display_name"), F.greatest(F.round("c_acctbal"), F.lit(0)).cast("long").alias("storage_used"))


@query("SELECT conv_id::VARCHAR AS id, left(arg_min(text, turn) FILTER (role = 'user'), 50) AS title, count(*) AS message_count, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def prj1_conversation_response(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.when(F.col("role") == "user", F.col("turn"))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.left(F.min_by("text", asked), F.lit(50)).alias("title"), F.count(F.lit(1)).alias("message_count"), F.max("turn").alias("last_turn"))
    return rows.select(F.col("conv_id").cast("string").alias("id"), "title", "message_count", "last_turn")


@query("SELECT conv_id || '-' || turn AS id, role, text AS content, CASE WHEN role = 'assistant' THEN 'model' END AS model_name FROM conversations")
def prj1_message_response(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "role", F.col("text").alias("content"), F.when(F.col("role") == "assistant", "model").alias("model_name"))


@query("SELECT doc_id, left(text, 50) AS title, left(text, 200) AS snippet, left(text, 500) AS stored FROM documents")
def prj3_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", *(F.left("text", F.lit(n)).alias(c) for n, c in ((50, "title"), (200, "snippet"), (500, "stored"))))


@query(f"WITH {CHUNKS} SELECT c.chunk_id, coalesce(nullif(q.content, ''), c.content) AS content FROM c LEFT JOIN c q ON q.chunk_id = c.parent_chunk_id")
def prj4_parent_content(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf)
    parents = c.filter("chunk_type = 'parent'").select(F.col("chunk_id").alias("parent_chunk_id"), F.col("content").alias("parent_content"))
    return c.join(parents, "parent_chunk_id", "left").select("chunk_id", F.coalesce(F.nullif("parent_content", F.lit("")), "content").alias("content"))


@query(f"WITH {CHUNKS}, {POOL}, r AS (SELECT c.*, p.content AS kept FROM c JOIN p USING (content_hash)) SELECT r.chunk_id, r.document_id, md5(r.kept) AS content_md5, md5(q.kept) AS parent_md5 FROM r LEFT JOIN r q ON q.chunk_id = r.parent_chunk_id AND q.user_id = r.user_id")
def join1_join2_hydrate(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk hydrated: its content from the pool, and its parent's."""
    c = chunks(spark, sf)
    hits = c.select(F.lit(0).alias("query_id"), "user_id", "chunk_id", F.lit(1.0).alias("score"))
    return R.hydrate(hits, c, pool(spark, sf)).select("chunk_id", "document_id", F.md5("content").alias("content_md5"), F.md5("parent_content").alias("parent_md5"))


@query(f"WITH {CHUNKS}, {POOL}, n AS (SELECT content_hash, count(*) AS actual FROM c WHERE document_id % 5 <> 0 GROUP BY 1) SELECT content_hash, ref_count, coalesce(actual, 0) AS actual FROM p LEFT JOIN n USING (content_hash) WHERE ref_count <> coalesce(actual, 0)")
def join3_agg2_reference_audit(spark: SparkSession, sf: str) -> DataFrame:
    return pools.audit(pool(spark, sf), chunks(spark, sf).filter("document_id % 5 <> 0"))


@query(f"WITH {CHUNKS} SELECT chunk_id, document_id FROM c JOIN embeddings e ON e.vec_id = c.document_id WHERE chunk_type = 'child' AND e.embedding IS NOT NULL AND c.document_id % 7 = 0")
def join4_vector_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Child chunks with a stored vector that the index (ids not divisible by 7) lacks."""
    e = table(spark, sf, "embeddings").filter(F.col("embedding").isNotNull()).select(F.col("vec_id").alias("document_id"))
    return chunks(spark, sf).filter("chunk_type = 'child' and document_id % 7 = 0").join(e, "document_id").select("chunk_id", "document_id")


@query(f"WITH {CHUNKS}, {POOL} SELECT c.document_id, c.chunk_index, c.content_hash, md5(p.content) AS content_md5 FROM c JOIN p USING (content_hash)")
def join5_clone_source(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("document_id", "chunk_index", "content_hash").join(pool(spark, sf), "content_hash").select("document_id", "chunk_index", "content_hash", F.md5("content").alias("content_md5"))


@query(f"WITH {CHUNKS}, {POOL} SELECT doc_id AS document_id FROM documents WHERE doc_id NOT IN (SELECT document_id FROM c JOIN p USING (content_hash) WHERE needs_embedding AND chunk_type = 'child')")
def join6_dml9_promote_ready(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).select(F.col("doc_id").alias("document_id"), F.lit("pending_embedding").alias("processing_status"))
    return pools.promotable(docs, chunks(spark, sf), pool(spark, sf)).select("document_id")


@query(f"WITH {CHUNKS}, {POOL} SELECT chunk_id FROM c WHERE content_hash IN (SELECT content_hash FROM p WHERE needs_embedding)")
def join7_chunks_of_pending_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).join(pool(spark, sf).filter("needs_embedding"), "content_hash", "left_semi").select("chunk_id")


@query(f"WITH {CHUNKS}, {POOL} SELECT content_hash FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.content_hash = p.content_hash AND c.document_id % 3 <> 0)")
def join8_unreferenced(spark: SparkSession, sf: str) -> DataFrame:
    return pool(spark, sf).join(chunks(spark, sf).filter("document_id % 3 <> 0"), "content_hash", "left_anti").select("content_hash")


@query("SELECT doc_id, EXISTS (SELECT 1 FROM documents o WHERE o.source = d.source AND o.doc_id < d.doc_id AND sha256(o.text) = sha256(d.text)) AS duplicate FROM documents d")
def join9_src10_duplicate_upload(spark: SparkSession, sf: str) -> DataFrame:
    """An upload is a duplicate if the same user sent the same bytes before."""
    hashed = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    first = hashed.groupBy("source", "h").agg(F.min("doc_id").alias("first"))
    return hashed.join(first, ["source", "h"]).select("doc_id", (F.col("first") < F.col("doc_id")).alias("duplicate"))


@query("""WITH u AS (SELECT doc_id, source, sha256(text) AS h FROM documents) SELECT doc_id, CASE WHEN min(doc_id) OVER (PARTITION BY source, h) < doc_id THEN 'reject'
WHEN min(doc_id) OVER (PARTITION BY h) < doc_id THEN 'clone' ELSE 'process' END AS route FROM u""")
def src10_upload_routes(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    own = u.groupBy("h", "source").agg(F.min("doc_id").alias("own"))
    every = own.groupBy("h").agg(F.min("own").alias("every"))
    return u.join(own, ["h", "source"]).join(every, "h").select("doc_id", F.when(F.col("own") < F.col("doc_id"), "reject").when(F.col("every") < F.col("doc_id"), "clone").otherwise("process").alias("route"))


@query("""WITH t AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS s, string_split(text, '. ') AS k FROM documents), c AS (SELECT doc_id, s, unnest(range(len(k)))::INT AS i, unnest(k) AS chunk FROM t)
SELECT doc_id, i, coalesce(list_max(list_filter(range(1, len(s) + 1), lambda j: contains(chunk, s[j]))), 0)::INT AS page FROM c""")
def join11_page_of_chunk(spark: SparkSession, sf: str) -> DataFrame:
    """For every chunk the last section that it contains gives its page; inside one row, so nothing is shuffled."""
    rows = table(spark, sf, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda x: x != "").alias("s"), F.split("text", "\\. ").alias("chunks"))
    return rows.select("doc_id", F.posexplode(last_contained("chunks", "s")).alias("i", "page"))


@query("SELECT d.doc_id, round(list_sum(list_transform(coalesce(e.embedding, list_transform(range(64), lambda i: 0::FLOAT)), lambda x: x::DOUBLE)), 5) AS total FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def join12_vectors_or_zero(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    vec = F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), 64))
    return table(spark, sf, "documents").select("doc_id").join(e, "doc_id", "left").select("doc_id", F.round(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(f"WITH {CHUNKS}, v AS (SELECT content_hash, min(document_id) AS vec_id FROM c JOIN embeddings e ON e.vec_id = c.document_id GROUP BY 1) SELECT content_hash, vec_id FROM v")
def join13_vector_of_hash(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("document_id"))
    return chunks(spark, sf).join(e, "document_id", "left_semi").groupBy("content_hash").agg(F.min("document_id").alias("vec_id"))


@query(f"WITH {CHUNKS}, {POOL} SELECT p.content_hash, min(e.label)::INT AS label FROM p JOIN c USING (content_hash) JOIN embeddings e ON e.vec_id = c.document_id WHERE p.needs_embedding GROUP BY 1")
def join14_backfilled_vectors(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf).select("content_hash", "document_id")
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("document_id"), "label")
    return pool(spark, sf).filter("needs_embedding").select("content_hash").join(c, "content_hash").join(e, "document_id").groupBy("content_hash").agg(F.min("label").cast("int").alias("label"))


@query(f"WITH {CHUNKS} SELECT user_id, count(*) AS n_chunks, count(DISTINCT document_id) AS n_documents FROM c GROUP BY 1")
def agg1_counts_per_tenant(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("document_id").alias("n_documents"))


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'error'")
def agg3_distinct_pending(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter("event_type = 'error'").select("user_id").distinct()


@query("""WITH r AS (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, array_to_string(list(event_type ORDER BY f), ',') AS types FROM r GROUP BY 1""")
def agg4_ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    firsts = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    return firsts.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"]), ",").alias("types"))


@query("SELECT event_id, round(value / CASE WHEN max(value) OVER w IS NULL OR max(value) OVER w = 0 THEN 1 ELSE max(value) OVER w END, 6) AS part FROM events WINDOW w AS (PARTITION BY user_id)")
def agg5_normalised_by_best(spark: SparkSession, sf: str) -> DataFrame:
    best = F.max("value").over(Window.partitionBy("user_id"))
    return table(spark, sf, "events").select("event_id", F.round(F.col("value") / F.when(best.isNull() | (best == 0), 1.0).otherwise(best), 6).alias("part"))


@query(f"WITH {CHUNKS} SELECT content_hash, count(DISTINCT document_id) AS doc_refs, count(*) AS chunk_refs FROM c GROUP BY 1")
def agg8_references(spark: SparkSession, sf: str) -> DataFrame:
    return pools.references(chunks(spark, sf))


@query("SELECT o_custkey AS user_id, greatest(sum(CASE WHEN o_orderstatus = 'F' THEN -round(o_totalprice)::BIGINT ELSE round(o_totalprice)::BIGINT END), 0)::BIGINT AS storage_used, count(*) * 2 AS message_count FROM orders GROUP BY 1")
def agg9_tenant_totals(spark: SparkSession, sf: str) -> DataFrame:
    size = F.round("o_totalprice").cast("long")
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.greatest(F.sum(F.when(F.col("o_orderstatus") == "F", -size).otherwise(size)), F.lit(0)).alias("storage_used"), (F.count(F.lit(1)) * 2).alias("message_count"))


@query("SELECT conv_id, string_agg(role || ': ' || left(text, 40), chr(10) ORDER BY turn) AS history FROM conversations GROUP BY 1")
def agg11_history(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat("role", F.lit(": "), F.left("text", F.lit(40)))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("history"))


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6")
def win3_last_messages(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, sf, "conversations").withColumn("r", rank).filter("r <= 6").select("conv_id", "turn", "text")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 10 = 1 ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def srt1_page(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").filter("o_custkey % 10 = 1").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_custkey")


@query("SELECT row_number() OVER (ORDER BY n_regionkey, n_name) AS place, n_name FROM nation")
def srt2_two_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.row_number().over(Window.orderBy("n_regionkey", "n_name")).cast("long").alias("place"), "n_name")


@query(f"WITH {CHUNKS}, {POOL} SELECT content_hash FROM p WHERE needs_embedding ORDER BY content_hash LIMIT 200")
def srt6_batch_pick(spark: SparkSession, sf: str) -> DataFrame:
    return pool(spark, sf).filter("needs_embedding").select("content_hash").orderBy("content_hash").limit(200)


@query("SELECT doc_id AS id, ((row_number() OVER (ORDER BY doc_id) - 1) // 1000)::INT AS page FROM documents")
def srt7_paged_scan(spark: SparkSession, sf: str) -> DataFrame:
    """All ids in pages of 1,000 by order of id: places come from range partitions' sizes, not from one task."""
    return pools.pages(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), "id", 1000)


@query("SELECT doc_id::VARCHAR AS id, 'missing' AS state FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT 'x' || vec_id, 'orphaned' FROM embeddings WHERE vec_id < 5")
def set1_index_difference(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"))
    foreign = table(spark, sf, "embeddings").filter("vec_id < 5").select(F.concat(F.lit("x"), F.col("vec_id").cast("string")).alias("id"))
    return pools.index_difference(ids, ids.filter("cast(id as long) % 7 <> 0").unionByName(foreign))


@query("SELECT vec_id, count(*) AS n, round(sum(score), 6) AS score FROM (SELECT vec_id, 0.5 AS score FROM embeddings WHERE label < 5 UNION ALL SELECT vec_id, 0.25 FROM embeddings WHERE label > 2) GROUP BY 1")
def set3_summed_union(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    both = e.filter("label < 5").select("vec_id", F.lit(0.5).alias("score")).unionByName(e.filter("label > 2").select("vec_id", F.lit(0.25).alias("score")))
    return both.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("score"))


@query("SELECT chunk_id, step FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY step) AS r FROM (SELECT vec_id AS chunk_id, 1 AS step FROM embeddings WHERE label < 5 UNION ALL SELECT vec_id, 2 FROM embeddings WHERE label > 2)) WHERE r = 1")
def set4_first_step_wins(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    both = e.filter("label < 5").select(F.col("vec_id").alias("chunk_id"), F.lit(1).alias("step")).unionByName(e.filter("label > 2").select(F.col("vec_id").alias("chunk_id"), F.lit(2).alias("step")))
    return both.groupBy("chunk_id").agg(F.min("step").alias("step"))


@query(f"WITH {CHUNKS} SELECT document_id, chunk_index, length(content) AS n, left(content, 80) AS preview FROM c")
def snk11_chunk_report(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf).select("document_id", "chunk_index", F.length("content").cast("long").alias("n"), F.left("content", F.lit(80)).alias("preview")).orderBy("document_id", "chunk_index")


UP = f"WITH {CHUNKS}, o AS (SELECT content_hash, arg_min(content, (document_id, chunk_index)) AS content, count(DISTINCT document_id) AS ref_count FROM c"


@query(f"{UP} GROUP BY 1) SELECT content_hash, md5(content) AS content_md5, ref_count FROM o")
def dml1_agg8_pool_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Documents below 300 first, then the others: the pool equals that of all at once, content is the first writer's."""
    c = chunks(spark, sf)
    empty = c.limit(0).select("content_hash", "content", F.lit(0).cast("long").alias("ref_count"))
    first = pools.upsert(empty, c.filter("document_id < 300"))
    return pools.upsert(first, c.filter("document_id >= 300")).select("content_hash", F.md5("content").alias("content_md5"), "ref_count")


@query(f"{UP} WHERE document_id % 10 <> 0 GROUP BY 1) SELECT content_hash, ref_count FROM o")
def dml3_delete_documents(spark: SparkSession, sf: str) -> DataFrame:
    t = pools.delete(tables(spark, sf), gone(spark, sf))
    return t.pool.select("content_hash", "ref_count")


def gone(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("doc_id % 10 = 0").select(F.col("doc_id").alias("document_id"))


def tables(spark: SparkSession, sf: str) -> pools.Tables:
    """Documents, chunks, a pool with true counts, and both indexes."""
    c = chunks(spark, sf).withColumn("cleanup_status", F.lit("done"))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("user_id"), F.lit(False).alias("is_deleted"), F.col("n_chars").alias("file_size"))
    full = pools.upsert(c.limit(0).select("content_hash", "content", F.lit(0).cast("long").alias("ref_count")), c)
    index = c.filter("chunk_type = 'child'").select("chunk_id", "user_id", "document_id", "content_hash")
    return pools.Tables(d, c, full, index, index)


@query(f"WITH {CHUNKS} SELECT chunk_id, CASE WHEN document_id % 10 = 0 THEN 'pending' ELSE 'done' END AS cleanup_status, chunk_type = 'child' AND document_id % 10 <> 0 AS in_vectors, chunk_type = 'child' AS in_texts FROM c")
def dml3_deferred_delete(spark: SparkSession, sf: str) -> DataFrame:
    """The text index is down: chunks stay, marked pending; the vector index is cleared already."""
    t = pools.delete(tables(spark, sf), gone(spark, sf), texts_ok=False)
    mark = lambda df, name: df.select("chunk_id", F.lit(True).alias(name))
    rows = t.chunks.select("chunk_id", "cleanup_status").join(mark(t.vectors, "v"), "chunk_id", "left").join(mark(t.texts, "t"), "chunk_id", "left")
    return rows.select("chunk_id", "cleanup_status", F.coalesce("v", F.lit(False)).alias("in_vectors"), F.coalesce("t", F.lit(False)).alias("in_texts"))


@query("SELECT source AS user_id, greatest(sum(n_chars) // 2 - coalesce(sum(n_chars) FILTER (doc_id % 10 = 0), 0), 0)::BIGINT AS storage_used, greatest(5 - coalesce(sum(len(string_split(text, chr(10)))) FILTER (doc_id % 10 = 0), 0), 0)::BIGINT AS vector_count FROM documents GROUP BY 1")
def dml3_agg9_tenant_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Counters that start too low never fall below 0."""
    t = tables(spark, sf)
    totals = t.documents.groupBy("user_id").agg(F.expr("sum(file_size) div 2").alias("storage_used"), F.lit(5).alias("vector_count"))
    out = pools.tenant_totals(totals, t.documents, t.chunks, gone(spark, sf))
    return out.select("user_id", F.col("storage_used").cast("long").alias("storage_used"), F.col("vector_count").cast("long").alias("vector_count"))


@query(f"{UP} WHERE document_id % 10 <> 0 GROUP BY 1) SELECT content_hash, ref_count, (SELECT count(*) FROM c WHERE document_id % 10 <> 0) AS n_chunks FROM o")
def dml6_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """A deletion that was deferred, tried again with both indexes up."""
    t = pools.reconcile(pools.delete(tables(spark, sf), gone(spark, sf), vectors_ok=False))
    return t.pool.select("content_hash", "ref_count").join(F.broadcast(t.chunks.agg(F.count(F.lit(1)).alias("n_chunks"))))


@query(f"WITH {CHUNKS}, {POOL} SELECT content_hash, (SELECT count(*) FROM c WHERE c.content_hash = p.content_hash) AS ref_count FROM p")
def dml7_repair_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Stale reference counts set right."""
    return pools.repair_counts(pool(spark, sf), chunks(spark, sf)).select("content_hash", "ref_count")


@query(f"""WITH {CHUNKS}, {POOL}, v AS (SELECT content_hash, arg_min(e.embedding, c.document_id) AS embedding FROM c JOIN embeddings e ON e.vec_id = c.document_id GROUP BY 1)
SELECT c.chunk_id, c.content_hash, round(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE)), 5) AS total, md5(left(p.content, 500)) AS snippet_md5 FROM c JOIN p USING (content_hash) JOIN v USING (content_hash) WHERE chunk_type = 'child' AND document_id % 7 = 0""")
def dml8_repair_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """What the vector index lacks, made from the pool's vectors."""
    c = chunks(spark, sf)
    there = c.filter("chunk_type = 'child' and document_id % 7 <> 0").select("chunk_id")
    out = pools.missing_rows(c, vector_pool(spark, sf), there)
    return out.select("chunk_id", "content_hash", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"), F.md5("snippet").alias("snippet_md5"))


def vector_pool(spark: SparkSession, sf: str) -> DataFrame:
    """The pool with vectors: of a hash's documents that have one, the first's."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("document_id"), "embedding")
    v = chunks(spark, sf).select("content_hash", "document_id").join(e, "document_id").groupBy("content_hash").agg(F.min_by("embedding", "document_id").alias("embedding"))
    return pool(spark, sf).join(v, "content_hash", "left")


@query(f"""WITH {CHUNKS}, {POOL}, b AS (SELECT content_hash FROM p WHERE needs_embedding ORDER BY content_hash LIMIT 200), w AS (SELECT DISTINCT document_id FROM c JOIN p USING (content_hash) WHERE needs_embedding AND chunk_type = 'child' AND content_hash NOT IN (SELECT content_hash FROM b))
SELECT doc_id AS document_id, CASE WHEN w.document_id IS NULL THEN 'ready' ELSE 'pending_embedding' END AS processing_status FROM documents LEFT JOIN w ON w.document_id = doc_id""")
def dml9_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """The next 200 hashes get vectors; documents that no longer wait for any become ready."""
    p = pool(spark, sf).withColumn("embedding", F.lit(None).cast("array<float>"))
    done = clients.embed(pools.batch(p).select("content_hash", F.col("content").alias("text")), {}, 64)
    docs = documents(spark, sf).select(F.col("doc_id").alias("document_id"), F.lit("pending_embedding").alias("processing_status"))
    return pools.promote(docs, chunks(spark, sf), pools.backfill(p, done)).select("document_id", "processing_status")


@query(f"WITH {CHUNKS} SELECT document_id, chunk_index, chunk_id, parent_chunk_id FROM c")
def dml2_insert_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk rows from a chunker's output: ids by rule, parents' places mapped to their ids."""
    made = chunks(spark, sf).select("document_id", "user_id", "chunk_index", F.lit(0).alias("parent_index"))
    rows = pools.insert_chunks(made, F.sha2(F.concat_ws(":", "document_id", "chunk_index"), 256))
    return rows.select("document_id", "chunk_index", "chunk_id", "parent_chunk_id")


@query(f"""WITH {CHUNKS}, k AS (SELECT *, 'copy-' || document_id AS target FROM c WHERE document_id % 2 = 1)
SELECT sha256(target || ':' || chunk_id) AS chunk_id, CASE WHEN parent_chunk_id IS NOT NULL THEN sha256(target || ':' || parent_chunk_id) END AS parent_chunk_id, target AS document_id, 'src9' AS user_id, content_hash FROM k""")
def dml4_clone_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every second document cloned for another tenant, parents mapped through the old and new ids."""
    docs = table(spark, sf, "documents").filter("doc_id % 2 = 1")
    pairs = docs.select(F.col("doc_id").cast("string").alias("source"), F.concat(F.lit("copy-"), F.col("doc_id").cast("string")).alias("target"), F.lit("src9").alias("owner"))
    return pools.clone_all(chunks(spark, sf), pairs).select("chunk_id", "parent_chunk_id", "document_id", "user_id", "content_hash")


@query(f"WITH {CHUNKS}, {POOL}, m AS (SELECT content_hash, count(DISTINCT document_id) AS more FROM c WHERE document_id % 2 = 1 GROUP BY 1) SELECT content_hash, ref_count + coalesce(more, 0) AS ref_count FROM p LEFT JOIN m USING (content_hash)")
def dml4_clone_references(spark: SparkSession, sf: str) -> DataFrame:
    """One more reference per hash and cloned document."""
    return pools.retain(pool(spark, sf), chunks(spark, sf).filter("document_id % 2 = 1")).select("content_hash", "ref_count")


@query(f"WITH {CHUNKS}, {POOL}, z AS (SELECT content_hash FROM p WHERE content_hash LIKE '0%') SELECT content_hash FROM z WHERE content_hash NOT IN (SELECT content_hash FROM c WHERE document_id % 2 = 0)")
def dml5_garbage(spark: SparkSession, sf: str) -> DataFrame:
    p = pool(spark, sf).withColumn("ref_count", F.when(F.col("content_hash").startswith("0"), 0).otherwise(F.col("ref_count")))
    return pools.collect_garbage(p, chunks(spark, sf).filter("document_id % 2 = 0"))


@query("SELECT user_id, event_type AS name, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def dml10_keyed_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    return pools.latest(table(spark, sf, "events"), "user_id", "event_id").select("user_id", F.col("event_type").alias("name"), "value")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'renamed' ELSE c_name END AS name, CASE WHEN c_custkey % 5 = 0 THEN 'none' ELSE c_mktsegment END AS segment, c_custkey % 7 = 0 AS is_deleted FROM customer")
def dml10_partial_update(spark: SparkSession, sf: str) -> DataFrame:
    """Only the fields that are set change; deleted rows are marked."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.lit(False).alias("is_deleted"))
    changes = c.filter("id % 3 = 0 or id % 5 = 0").select("id", F.when(F.col("id") % 3 == 0, "renamed").alias("name"), F.when(F.col("id") % 5 == 0, "none").alias("segment"))
    return pools.soft_delete(pools.update(c, changes, "id"), "id", c.filter("id % 7 = 0"))


@query("SELECT s_nationkey AS owner, s_name AS name, 'refused' AS state FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_nationkey, s_name, 'kept' FROM supplier")
def dml10_unique_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names that an owner has already are refused."""
    rows = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("owner"), F.col("s_name").alias("name"))
    old = table(spark, sf, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("owner"), F.col("s_name").alias("name"))
    kept, refused = pools.insert_unique(old, rows, ["owner", "name"])
    return kept.withColumn("state", F.lit("kept")).unionByName(refused.withColumn("state", F.lit("refused")))


@query("""WITH u AS (SELECT conv_id, count(*) FILTER (role = 'user') * 2 AS message_count, max(turn) AS last_turn, left(arg_min(text, turn) FILTER (role = 'user'), 50) AS asked, left(arg_min(text, turn) FILTER (role = 'assistant'), 50) AS answered FROM conversations GROUP BY 1)
SELECT conv_id, message_count, last_turn, CASE WHEN conv_id % 3 = 0 THEN 'given' WHEN conv_id % 2 = 0 THEN asked ELSE answered END AS title FROM u""")
def dml11_conversation_touch(spark: SparkSession, sf: str) -> DataFrame:
    """A title comes from the first question on the fixed path and from the first answer on the agent's, if none was given."""
    of = lambda role, value: F.when(F.col("role") == role, F.col(value))
    first = lambda role: F.left(F.min_by(of(role, "text"), of(role, "turn")), F.lit(50))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg((F.count_if(F.col("role") == "user") * 2).alias("message_count"), F.max("turn").alias("last_turn"), first("user").alias("asked"), first("assistant").alias("answered"))
    given = F.when(F.col("conv_id") % 3 == 0, "given")
    return rows.select("conv_id", "message_count", "last_turn", F.coalesce(given, F.when(F.col("conv_id") % 2 == 0, F.col("asked")).otherwise(F.col("answered"))).alias("title"))


STATES = ["pending", "parsing", "chunking", "embedding", "pending_embedding", "cloning", "ready", "failed"]
KNOWN = "('pending', 'parsing'), ('pending', 'cloning'), ('parsing', 'chunking'), ('parsing', 'failed'), ('chunking', 'embedding'), ('chunking', 'pending_embedding'), ('chunking', 'failed'), ('embedding', 'ready'), ('embedding', 'failed'), ('pending_embedding', 'ready'), ('cloning', 'ready'), ('cloning', 'failed')"


@query(f"SELECT doc_id, b, a, (b, a) IN ({KNOWN}) AS allowed FROM (SELECT doc_id, ({STATES})[doc_id % 8 + 1] AS b, ({STATES})[(doc_id // 8) % 8 + 1] AS a FROM documents)")
def dml12_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of states, and whether a document may go from one to the other."""
    name = lambda n: F.array(*map(F.lit, STATES))[(n % 8).cast("int")]
    rows = table(spark, sf, "documents").select("doc_id", name(F.col("doc_id")).alias("b"), name(F.floor(F.col("doc_id") / 8)).alias("a"))
    return rows.withColumn("allowed", pools.allowed(F.col("b"), F.col("a")))


@query(f"""WITH s AS (SELECT doc_id, ({STATES})[doc_id % 8 + 1] AS state, length(text) > 20 AS ok, doc_id % 3 <> 0 AS children, doc_id % 5 <> 0 AS api FROM documents)
SELECT doc_id, CASE state WHEN 'ready' THEN 'ready' WHEN 'failed' THEN 'failed' WHEN 'pending_embedding' THEN CASE WHEN api THEN 'ready' ELSE 'pending_embedding' END ELSE CASE WHEN NOT ok THEN 'failed' ELSE
 CASE state WHEN 'pending' THEN 'parsing' WHEN 'parsing' THEN 'chunking' WHEN 'chunking' THEN CASE WHEN api AND children THEN 'embedding' ELSE 'pending_embedding' END ELSE 'ready' END END END AS processing_status FROM s""")
def dml12_next_states(spark: SparkSession, sf: str) -> DataFrame:
    state = F.array(*map(F.lit, STATES))[(F.col("doc_id") % 8).cast("int")]
    return table(spark, sf, "documents").select("doc_id", pools.next_state(state, F.length("text") > 20, F.col("doc_id") % 3 != 0, F.col("doc_id") % 5 != 0).alias("processing_status"))
