"""Retrieval, evaluation, query understanding and agent rules over tables.

Searches ask every vector and every whole benchmark text whose id is divisible by 100, against all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import queries as Q
from ragloom.operators import agent, metrics
from ragloom.operators import retrieval as R
from ragloom.operators.ivf import IvfIndex
from ragloom.plans.fixtures import WS
from ragloom.registry import query
from ragloom.session import scratch_path, table
from ragloom.sinks.stores import TextTable, VectorTable


def hundredth_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector whose id is divisible by 100, so the query set grows with the table."""
    return table(spark, sf, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), "label")


def hundredth_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The whole texts of the benchmark items whose id is divisible by 100."""
    return table(spark, sf, "benchmark").filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "text")


def whole_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks of their tenants; every tenth is the parent of those after it."""
    d = table(spark, sf, "documents")
    parent = F.when(F.col("doc_id") % 10 != 0, F.col("doc_id") - F.col("doc_id") % 10)
    return d.select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("user_id"), F.coalesce("text", F.lit("")).alias("content"), F.col("doc_id").alias("document_id"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), (F.col("doc_id") % 7).cast("int").alias("page_number"), parent.alias("parent_chunk_id"),
    )


def whole_pool(spark: SparkSession, sf: str) -> DataFrame:
    docs = whole_documents(spark, sf).select("chunk_id", "content_hash", "content")
    return docs.join(docs.groupBy("content_hash").agg(F.min("chunk_id").alias("chunk_id")), ["content_hash", "chunk_id"]).select("content_hash", "content")


def owned_vectors(spark: SparkSession, sf: str) -> DataFrame:
    owner = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("user_id"))
    return table(spark, sf, "embeddings").join(owner, "vec_id").select("vec_id", "embedding", "user_id")


def owned_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts asked by the tenant of the document with the same id, with the vector of that id."""
    q = hundredth_texts(spark, sf)
    owner = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("source").alias("user_id"))
    vector = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return q.join(owner, "query_id").join(vector, "query_id")


VQ = "q AS (SELECT vec_id AS query_id, embedding AS qvec, label AS qlabel FROM embeddings WHERE vec_id % 100 = 0)"
DOT = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[])"
SIM = f"{DOT.format('qvec', 'embedding')} / ((sqrt({DOT.format('qvec', 'qvec')}) + 1e-8) * (sqrt({DOT.format('embedding', 'embedding')}) + 1e-8))"
VHITS = f"{VQ}, v AS (SELECT query_id, vec_id, {SIM} AS score FROM q, embeddings), vh AS (SELECT query_id, vec_id, score FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) <= 40)"


@query(f"WITH {VHITS} SELECT query_id, vec_id, round(score, 6) AS score FROM vh")
def ret1_srt3_vector_search(spark: SparkSession, sf: str) -> DataFrame:
    return R.vector_search(hundredth_vectors(spark, sf), table(spark, sf, "embeddings")).select("query_id", "vec_id", F.round("score", 6).alias("score"))


OWNED = "ov AS (SELECT vec_id, embedding, source AS user_id FROM embeddings JOIN documents ON doc_id = vec_id)"


@query(f"WITH {OWNED} SELECT q.vec_id AS query_id, o.vec_id, round({SIM.replace('qvec', 'q.embedding').replace('(embedding', '(o.embedding').replace(' embedding', ' o.embedding')}, 6) AS score FROM ov q JOIN ov o USING (user_id) WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round({SIM.replace('qvec', 'q.embedding').replace('(embedding', '(o.embedding').replace(' embedding', ' o.embedding')}, 12) DESC, o.vec_id) <= 40")
def ret1_flt1_tenant_vector_search(spark: SparkSession, sf: str) -> DataFrame:
    """A query sees its own tenant's vectors only."""
    own = owned_vectors(spark, sf)
    q = own.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), "user_id")
    return R.vector_search(q, own, tenant=True).select("query_id", "vec_id", F.round("score", 6).alias("score"))


def clustered(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest by an inverted-file index that is fitted, filled and searched."""
    vectors = table(spark, sf, "embeddings")
    index = IvfIndex(spark, scratch_path(spark, "ivf"))
    index.fit(vectors)
    index.insert(vectors)
    return index.search(hundredth_vectors(spark, sf), k=10)


@query(f"WITH {VHITS} SELECT query_id, vec_id, round(score, 6) AS score FROM vh QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10")
def ret2_clustered_search(spark: SparkSession, sf: str) -> DataFrame:
    return clustered(spark, sf).select("query_id", "vec_id", F.round("score", 6).alias("score"))


@query("SELECT vec_id AS query_id, true AS recalled, true AS few FROM embeddings WHERE vec_id % 100 = 0")
def ret2_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Whether at least nine of the ten nearest were found, and no more than a fifth of the vectors read in full."""
    got = clustered(spark, sf)
    exact = R.vector_search(hundredth_vectors(spark, sf), table(spark, sf, "embeddings"), k=10).select("query_id", "vec_id")
    n = table(spark, sf, "embeddings").agg(F.count("embedding").alias("n"))
    met = exact.join(got, ["query_id", "vec_id"], "left").groupBy("query_id").agg((F.count("vectors_read") >= 0.9 * F.count(F.lit(1))).alias("recalled"), F.max("vectors_read").alias("read"))
    return met.join(F.broadcast(n)).select("query_id", "recalled", (5 * F.col("read") <= F.col("n")).alias("few"))


@query(f"WITH {OWNED}, qq AS (SELECT vec_id AS query_id, user_id, embedding AS qvec FROM ov WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, {SIM} AS score FROM qq JOIN ov USING (user_id) WHERE vec_id % 10 <> 3) SELECT query_id, vec_id::VARCHAR AS chunk_id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id::VARCHAR) <= 40")
def snk1_snk2_snk5_vector_table(spark: SparkSession, sf: str) -> DataFrame:
    """The stored vector index, partitioned by tenant: created, filled, rid of some documents, searched."""
    own = owned_vectors(spark, sf)
    store = VectorTable(spark, scratch_path(spark, "vectors"))
    store.insert(own.select(F.col("vec_id").cast("string").alias("chunk_id"), "user_id", F.col("vec_id").cast("string").alias("document_id"), F.lit("").alias("content_hash"), "embedding", F.lit("").alias("snippet")))
    store.delete_documents(own.filter("vec_id % 10 = 3").select(F.col("vec_id").cast("string").alias("document_id")))
    q = own.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), "user_id")
    return store.search(q).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


RUNS = r"'[\p{L}\p{N}]+'"


def bm_sql(asked: str, tenant: bool) -> str:
    """Hits ``th`` of the queries ``asked`` (query_id, text[, user_id])."""
    own, also = ("user_id, ", " AND po.user_id = qw.user_id") if tenant else ("", "")
    clause = lambda dl, avg: f"qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * {dl} / {avg}))"
    return f"""t AS (SELECT doc_id AS chunk_id, source AS user_id, regexp_extract_all(lower(coalesce(text, '')), {RUNS}) AS w FROM documents),
e AS (SELECT chunk_id, user_id, w, len(w) AS dl, len(list_filter(w, lambda x: length(x) > 1)) AS dl_index FROM t),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avg_all, avg(dl_index) AS avg_index FROM e),
po AS (SELECT chunk_id, user_id, dl, dl_index, term, count(*) AS tf FROM (SELECT chunk_id, user_id, dl, dl_index, unnest(w) AS term FROM e) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
qs AS (SELECT query_id, {own}regexp_extract_all(lower(text), {RUNS}) AS w FROM {asked}),
qn AS (SELECT query_id, {own}greatest(1, floor((CASE WHEN 2 * len(w) - 1 <= 2 THEN 100 WHEN 2 * len(w) - 1 <= 4 THEN 75 ELSE 60 END) * len(w) / 100)) AS need, unnest(w) AS term FROM qs),
qw AS (SELECT query_id, {own}need, term, count(*) AS qtf FROM qn GROUP BY ALL),
bm AS (SELECT query_id, chunk_id, any_value(need) AS need, sum(CASE WHEN length(term) > 1 THEN {clause('dl_index', 'avg_index')} END) AS s1, sum(CASE WHEN length(term) > 1 THEN qtf END) AS m1, sum({clause('dl', 'avg_all')}) AS s2, sum(qtf) AS m2
 FROM qw JOIN po USING (term) JOIN df USING (term), st WHERE true{also} GROUP BY 1, 2),
th AS (SELECT query_id, chunk_id, round(CASE WHEN coalesce(m1, 0) >= need THEN s1 ELSE 0 END + CASE WHEN m2 >= need THEN s2 ELSE 0 END, 9) AS score FROM bm WHERE coalesce(m1, 0) >= need OR m2 >= need
 QUALIFY score >= 1 AND row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 40)"""


TEXTS = "(SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 100 = 0)"
BM = bm_sql(TEXTS, False)


def text_hits(spark: SparkSession, sf: str, asked: DataFrame | None = None) -> DataFrame:
    """Untenanted text hits, scores to nine digits."""
    asked = hundredth_texts(spark, sf) if asked is None else asked
    return R.bm25(asked, R.matching_postings(whole_documents(spark, sf), R.asked_terms(asked)), tenant=False, digits=9)


@query(f"WITH {BM} SELECT query_id, chunk_id, round(score, 6) AS score FROM th")
def ret3_ret4_srt4_flt10_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return text_hits(spark, sf).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {bm_sql(TEXTS, False).replace('FROM documents)', 'FROM documents WHERE doc_id % 10 <> 3)', 1).replace('ORDER BY score DESC, chunk_id', 'ORDER BY score DESC, chunk_id::VARCHAR')} SELECT query_id, chunk_id::VARCHAR AS chunk_id, round(score, 6) AS score FROM th")
def snk3_snk4_snk5_snk12_text_table(spark: SparkSession, sf: str) -> DataFrame:
    """The stored text index: created, filled in two steps, some chunks written again, rid of some documents, searched."""
    docs = whole_documents(spark, sf)
    store = TextTable(spark, scratch_path(spark, "postings"))
    store.insert(docs.filter("chunk_id % 2 = 0"))
    store.backfill(docs)
    store.insert(docs.filter("chunk_id % 50 = 0"))
    store.delete_documents(docs.filter("document_id % 10 = 3").select("document_id"))
    return store.search(hundredth_texts(spark, sf), tenant=False, digits=9).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def cover_sql(asked: str, tenant: bool) -> str:
    """Fallback hits ``cv`` of the queries ``asked``."""
    own, use = ("user_id, ", "(term, user_id)") if tenant else ("", "(term)")
    return f"""ix AS (SELECT doc_id AS chunk_id, source AS user_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), {RUNS}), lambda x: length(x) > 1) AS w FROM documents),
pl AS (SELECT chunk_id, user_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM ix),
qd AS (SELECT query_id, {own}len(w) AS need, unnest(w) AS term FROM (SELECT query_id, {own}list_distinct(regexp_extract_all(lower(text), {RUNS})) AS w FROM {asked})),
oc AS (SELECT query_id, chunk_id, need, term, pos FROM pl JOIN qd USING {use}),
ok AS (SELECT query_id, chunk_id FROM oc GROUP BY 1, 2 HAVING count(DISTINCT term) = any_value(need)),
a2 AS (SELECT oc.*, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY pos) AS i FROM oc JOIN ok USING (query_id, chunk_id)),
lt AS (SELECT n.query_id, n.chunk_id, n.i, b.term, max(b.i) AS li, any_value(n.need) AS need FROM a2 n JOIN a2 b ON b.query_id = n.query_id AND b.chunk_id = n.chunk_id AND b.i <= n.i GROUP BY 1, 2, 3, 4),
co AS (SELECT query_id, chunk_id, i, min(li) AS bi FROM lt GROUP BY 1, 2, 3 HAVING count(*) = any_value(need)),
mc AS (SELECT query_id, chunk_id, bi, min(i) AS ei FROM co GROUP BY 1, 2, 3),
cs AS (SELECT mc.query_id, mc.chunk_id, round(sum(0.1 / (1 + (z.pos - b.pos) - (ei - bi))), 9) AS score FROM mc JOIN a2 b ON b.query_id = mc.query_id AND b.chunk_id = mc.chunk_id AND b.i = bi JOIN a2 z ON z.query_id = mc.query_id AND z.chunk_id = mc.chunk_id AND z.i = ei GROUP BY 1, 2),
cv AS (SELECT query_id, chunk_id, score FROM cs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 40)"""


#: Queries of a few words, all of which some documents hold: the first five of the benchmark texts asked.
SHORT = "(SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 100 = 0 UNION ALL SELECT -1 - item_id, array_to_string(string_split(text, ' ')[1:3], ' ') FROM benchmark WHERE item_id % 100 = 0)"


@query(f"WITH {cover_sql(SHORT, False)} SELECT query_id, chunk_id, round(score, 6) AS score FROM cv")
def ret5_all_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Each text whole and, as a second query, its first three words, over all tenants."""
    whole = hundredth_texts(spark, sf)
    short = whole.select((-1 - F.col("query_id")).alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("text"))
    return R.cover_rank(whole.unionByName(short), whole_documents(spark, sf), digits=9, tenant=False).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


PLACED = """hv AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS r, max(score) OVER (PARTITION BY query_id) AS m FROM {v}),
ht AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS r, max(score) OVER (PARTITION BY query_id) AS m FROM {t}),
nv AS (SELECT query_id, chunk_id, r, score / (CASE WHEN m = 0 THEN 1 ELSE m END) AS norm FROM hv), nt AS (SELECT query_id, chunk_id, r, score / (CASE WHEN m = 0 THEN 1 ELSE m END) AS norm FROM ht)"""
FUSED = f"{VHITS}, {BM}, v9 AS (SELECT query_id, vec_id AS chunk_id, round(score, 9) AS score FROM vh), {PLACED.format(v='v9', t='th')}"


def vector_hits(spark: SparkSession, sf: str) -> DataFrame:
    return R.vector_search(hundredth_vectors(spark, sf), table(spark, sf, "embeddings")).select("query_id", F.col("vec_id").alias("chunk_id"), F.round("score", 9).alias("score"))


@query(f"WITH {FUSED} SELECT query_id, chunk_id, round(sum(s), 9) AS score FROM (SELECT query_id, chunk_id, 0.7 * norm / (60 + r + 1) AS s FROM nv UNION ALL SELECT query_id, chunk_id, 0.3 * norm / (60 + r + 1) FROM nt) GROUP BY 1, 2")
def ret7_join10_win1_agg6_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return R.fuse(vector_hits(spark, sf), text_hits(spark, sf), keep=None).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


ASKING = "aq AS (SELECT item_id AS query_id, b.text, d.source AS user_id, e.embedding AS qvec FROM benchmark b JOIN documents d ON d.doc_id = item_id JOIN embeddings e ON e.vec_id = item_id WHERE item_id % 100 = 0)"
TENANT_V = f"{ASKING}, {OWNED}, tv AS (SELECT query_id, vec_id AS chunk_id, round({SIM}, 9) AS score FROM aq JOIN ov USING (user_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {SIM} DESC, vec_id) <= 40)"
KEYWORD = r"""regexp_matches(text, '"[^\n]+?"|''[^\n]+?''|[\pL\pN_]{8,}-[\pL\pN_]{4,}')"""


@query(f"""WITH {TENANT_V}, {cover_sql('aq', True)}, {PLACED.format(v='tv', t='cv')}, n AS (SELECT DISTINCT query_id FROM cv), w AS (SELECT aq.query_id, 0.3 * CASE WHEN n.query_id IS NOT NULL THEN 0.5 ELSE 1 END AS tw, CASE WHEN n.query_id IS NOT NULL THEN 1 - 0.3 * 0.5 ELSE 0.7 END AS vw FROM aq LEFT JOIN n USING (query_id))
SELECT query_id, chunk_id, round(sum(s), 9) AS score FROM (SELECT query_id, chunk_id, vw * norm / (60 + r + 1) AS s FROM nv JOIN w USING (query_id) UNION ALL SELECT query_id, chunk_id, tw * norm / (60 + r + 1) FROM nt JOIN w USING (query_id)) GROUP BY 1, 2""")
def ret6_failover(spark: SparkSession, sf: str) -> DataFrame:
    """The text engine is down: the fallback engine's hits, with its weights, in the fused list."""
    q = owned_queries(spark, sf).withColumns({"vector_weight": F.lit(0.7), "text_weight": F.lit(0.3)})
    return R.single_search(q, whole_documents(spark, sf), owned_vectors(spark, sf), text_engine=False, digits=9).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


SHOWN = "SELECT query_id, chunk_id, round(score, 6) AS score, rerank_source, md5(content) AS content_md5, md5(coalesce(parent, '')) AS parent_md5 FROM y QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10"


def search_sql(vector: str, text: str, rest: str = SHOWN) -> str:
    """The whole path up to the scored candidates ``y``, and what is made of them."""
    return f"""WITH {TENANT_V}, {bm_sql('aq', True)}, {PLACED.format(v='tv', t='th')}, w AS (SELECT query_id, qvec, user_id, ({vector})::DOUBLE AS vw, ({text})::DOUBLE AS tw FROM aq),
f AS (SELECT query_id, chunk_id, sum(s) AS score, min(vr) AS vr, min(tr) AS tr FROM (SELECT query_id, chunk_id, vw * norm / (60 + r + 1) AS s, r AS vr, NULL AS tr FROM nv JOIN w USING (query_id)
 UNION ALL SELECT query_id, chunk_id, tw * norm / (60 + r + 1), NULL, r FROM nt JOIN w USING (query_id)) GROUP BY 1, 2),
b AS (SELECT f.*, w.qvec, w.user_id FROM f JOIN w USING (query_id) JOIN documents d ON d.doc_id = chunk_id AND d.source = w.user_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vr NULLS LAST, tr NULLS LAST, chunk_id) <= 40),
dh AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS h, coalesce(text, '') AS text FROM documents), pl2 AS (SELECT h, arg_min(text, doc_id) AS content FROM dh GROUP BY 1),
y AS (SELECT b.query_id, b.chunk_id, pc.content, pp.content AS parent, CASE WHEN count(*) OVER (PARTITION BY query_id) > 1 AND e.embedding IS NOT NULL THEN {DOT.format('qvec', 'embedding')} / (sqrt({DOT.format('qvec', 'qvec')}) * sqrt({DOT.format('embedding', 'embedding')})) ELSE b.score END AS score,
 CASE WHEN count(*) OVER (PARTITION BY query_id) > 1 AND e.embedding IS NOT NULL THEN 'vector' ELSE 'fusion' END AS rerank_source
 FROM b JOIN dh c ON c.doc_id = b.chunk_id JOIN pl2 pc ON pc.h = c.h LEFT JOIN ov e ON e.vec_id = b.chunk_id LEFT JOIN dh p ON b.chunk_id % 10 <> 0 AND p.doc_id = b.chunk_id - b.chunk_id % 10 AND p.source = b.user_id LEFT JOIN pl2 pp ON pp.h = p.h)
{rest}"""


def found(spark: SparkSession, sf: str, weights: tuple[float, float] | None = None) -> DataFrame:
    return R.search(owned_queries(spark, sf), whole_documents(spark, sf), whole_pool(spark, sf), owned_vectors(spark, sf), weights=weights, digits=9)


def shown(results: DataFrame) -> DataFrame:
    return results.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rerank_source", F.md5("content").alias("content_md5"), F.md5(F.coalesce("parent_content", F.lit(""))).alias("parent_md5"))


BY_KIND = (f"CASE WHEN {KEYWORD} THEN 0.3 ELSE 0.7 END", f"CASE WHEN {KEYWORD} THEN 0.7 ELSE 0.3 END")


@query(search_sql(*BY_KIND))
def ret8_ret9_ret10_ret11_srt5_search(spark: SparkSession, sf: str) -> DataFrame:
    """The whole path in each tenant: analysis, two searches, fusion, hydration to 40, local rerank to 10."""
    return shown(found(spark, sf))


@query(search_sql("0.5", "0.5"))
def ret12_callers_weights(spark: SparkSession, sf: str) -> DataFrame:
    """The same path with the caller's weights, without history or decomposition."""
    return shown(found(spark, sf, (0.5, 0.5)))


@query(search_sql(*BY_KIND, """, rk AS (SELECT query_id, coalesce(nullif(parent, ''), content) AS t, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS i FROM y QUALIFY i <= 10),
cu AS (SELECT *, sum(length(t)) OVER (PARTITION BY query_id ORDER BY i) AS s FROM rk)
SELECT query_id, count(*)::INT AS n_used, md5(string_agg('[' || i || '] ' || t, chr(10) || chr(10) ORDER BY i)) AS context_md5 FROM cu WHERE s <= 8000 GROUP BY 1"""))
def ret13_search_context(spark: SparkSession, sf: str) -> DataFrame:
    """What a model would be shown of the search's results."""
    return R.pack_context(found(spark, sf)).select("query_id", "n_used", F.md5("context").alias("context_md5"))


@query("""WITH r AS (SELECT conv_id AS query_id, turn, text, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations)
SELECT query_id, string_agg('[' || (turn + 1) || '] ' || text, chr(10) || chr(10) ORDER BY turn) AS context, count(*)::INT AS n_used FROM r WHERE s <= 2000 GROUP BY 1""")
def ret13_win2_context_pack(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("chunk_id"), (-F.col("turn")).alias("score"), F.col("text").alias("content"), F.lit(None).cast("string").alias("parent_content"))
    return R.pack_context(rows, 2000)


@query("SELECT DISTINCT source AS user_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 50 = 1)")
def ret14_lost_data(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("user_id"))
    asking = docs.select("user_id").distinct().withColumn("query_id", F.col("user_id"))
    results = docs.filter("doc_id % 50 = 1").select(F.col("user_id").alias("query_id"))
    return R.lost_data(asking, results, docs).select("user_id")


@query("SELECT doc_id AS query_id, doc_id AS chunk_id, 1.0::DOUBLE AS score, left(text, 200) AS snippet FROM documents")
def ret15_citations(spark: SparkSession, sf: str) -> DataFrame:
    return R.citations(table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("chunk_id"), F.lit(1.0).alias("score"), F.col("text").alias("content")))


EVAL = f"""{VHITS}, rl AS (SELECT query_id, vh.vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vh.vec_id) - 1 AS rank0, e.label = q.qlabel AS rel
 FROM vh JOIN q USING (query_id) JOIN embeddings e ON e.vec_id = vh.vec_id WHERE vh.vec_id <> query_id),
nr AS (SELECT query_id, count(*) AS n FROM q JOIN embeddings e ON e.label = q.qlabel AND e.vec_id <> query_id GROUP BY 1),
mt AS (SELECT query_id, count(*) FILTER (rel AND rank0 < 5) / any_value(n) AS recall_5, count(*) FILTER (rel AND rank0 < 10) / any_value(n) AS recall_10, coalesce(1.0 / (min(rank0) FILTER (rel) + 1), 0) AS mrr,
 coalesce(sum(1 / log2(rank0 + 2)) FILTER (rel AND rank0 < 10), 0) / (SELECT sum(1 / log2(i + 2)) FROM range(10) t(i) WHERE i < any_value(n)) AS ndcg_10 FROM rl JOIN nr USING (query_id) GROUP BY 1)"""


def relevant_counts(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, n_relevant: how many other vectors have the query's label."""
    counts = table(spark, sf, "embeddings").groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_relevant"))
    return hundredth_vectors(spark, sf).select("query_id", "label").join(counts, "label").select("query_id", "n_relevant")


def label_judge(spark: SparkSession, sf: str):
    """Whether a chunk's vector has the label of the query's, and is another one; a query -1 - n is judged as n."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("_got"))
    q = hundredth_vectors(spark, sf).select(F.col("query_id").alias("_of"), F.col("label").alias("_wanted"))

    def judge(rows: DataFrame) -> DataFrame:
        named = rows.withColumn("_of", F.when(F.col("query_id") < 0, -1 - F.col("query_id")).otherwise(F.col("query_id")))
        both = named.join(e, "chunk_id", "left").join(q, "_of", "left")
        return both.withColumn("hit", F.coalesce((F.col("_got") == F.col("_wanted")) & (F.col("chunk_id") != F.col("_of")), F.lit(False))).drop("_of", "_got", "_wanted")

    return judge


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    q, e = hundredth_vectors(spark, sf), table(spark, sf, "embeddings")
    hits = R.vector_search(q, e).filter("vec_id <> query_id").withColumn("score", F.round("score", 12))
    rank = R.ranked(hits, "vec_id").join(e.select("vec_id", "label"), "vec_id").join(q.select("query_id", F.col("label").alias("wanted")), "query_id")
    return metrics.evaluate_hits(relevant_counts(spark, sf), rank.select("query_id", "rank0", (F.col("label") == F.col("wanted")).alias("hit")))


@query(f"WITH {EVAL} SELECT query_id, round(recall_5, 6) AS recall_5, round(recall_10, 6) AS recall_10, round(mrr, 6) AS mrr, round(ndcg_10, 6) AS ndcg_10 FROM mt")
def eva1_eva2_eva3_win4_set2_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluated(spark, sf).select("query_id", *(F.round(c, 6).alias(c) for c in ("recall_5", "recall_10", "mrr", "ndcg_10")))


@query(f"WITH {EVAL} SELECT round(avg(recall_5), 6) AS recall_at_5, round(avg(recall_10), 6) AS recall_at_10, round(avg(mrr), 6) AS mrr, round(avg(ndcg_10), 6) AS ndcg_at_10, count(*)::INT AS total_queries FROM mt")
def eva4_agg7_macro(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics.macro(evaluated(spark, sf))
    return m.select(*(F.round(c, 6).alias(c) for c in ("recall_at_5", "recall_at_10", "mrr", "ndcg_at_10")), "total_queries")


LABELLED = f"{VQ}, rv AS (SELECT query_id, vec_id AS chunk_id FROM q JOIN embeddings e ON e.label = q.qlabel AND e.vec_id <> query_id), rn AS (SELECT query_id, count(*) AS n FROM rv GROUP BY 1)"


@query(f"""WITH {FUSED}, rv AS (SELECT query_id, vec_id AS chunk_id FROM q JOIN embeddings e ON e.label = q.qlabel AND e.vec_id <> query_id), rn AS (SELECT query_id, count(*) AS n FROM rv GROUP BY 1),
g AS (SELECT k, vw FROM (SELECT unnest([10, 30, 60, 100]) AS k), (SELECT unnest([0.3, 0.5, 0.7]::DOUBLE[]) AS vw)),
s AS (SELECT k, vw, query_id, chunk_id, sum(s) AS score, min(vr) AS vr, min(tr) AS tr FROM (SELECT k, vw, query_id, chunk_id, vw * norm / (k + r + 1) AS s, r AS vr, NULL AS tr FROM nv, g UNION ALL SELECT k, vw, query_id, chunk_id, (1 - vw) * norm / (k + r + 1), NULL, r FROM nt, g) GROUP BY 1, 2, 3, 4),
p AS (SELECT k, vw, query_id, chunk_id, row_number() OVER (PARTITION BY k, vw, query_id ORDER BY score DESC, vr NULLS LAST, tr NULLS LAST, chunk_id) - 1 AS rank0 FROM s),
c AS (SELECT p.k, p.vw, p.query_id, count(*) FILTER (rank0 < 5) AS h5, count(*) FILTER (rank0 < 10) AS h10 FROM p JOIN rv USING (query_id, chunk_id) GROUP BY 1, 2, 3)
SELECT g.k::INT AS k, g.vw AS vector_weight, round(avg(coalesce(h5, 0) / n), 6) AS recall_at_5, round(avg(coalesce(h10, 0) / n), 6) AS recall_at_10 FROM rn, g LEFT JOIN c ON c.k = g.k AND c.vw = g.vw AND c.query_id = rn.query_id GROUP BY 1, 2""")
def eva5_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve parameter pairs in one job: fused scores for all, then metrics per pair."""
    return metrics.sweep(R.contributions(vector_hits(spark, sf), text_hits(spark, sf)), relevant_counts(spark, sf), label_judge(spark, sf)).withColumns({c: F.round(c, 6) for c in ("recall_at_5", "recall_at_10")})


@query(f"""WITH {LABELLED}, {bm_sql(SHORT, False)}, {cover_sql(SHORT, False)}, sm AS (SELECT query_id AS id, query_id, n FROM rn UNION ALL SELECT -1 - query_id, query_id, n FROM rn),
a AS (SELECT query_id AS id, chunk_id FROM th QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10), b AS (SELECT query_id AS id, chunk_id FROM cv QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 10),
r AS (SELECT sm.id, (SELECT count(*) FROM a JOIN rv ON rv.query_id = sm.query_id AND rv.chunk_id = a.chunk_id WHERE a.id = sm.id) / sm.n AS ra, (SELECT count(*) FROM b JOIN rv ON rv.query_id = sm.query_id AND rv.chunk_id = b.chunk_id WHERE b.id = sm.id) / sm.n AS rb FROM sm)
SELECT round(avg(ra), 6) AS primary_recall, round(avg(rb), 6) AS fallback_recall, CASE WHEN avg(ra) > 0 THEN printf('%.1f%%', round((1 - avg(rb) / avg(ra)) * 100, 6)) ELSE 'N/A' END AS degradation FROM r""")
def eva6_engines(spark: SparkSession, sf: str) -> DataFrame:
    """Both text engines on the same queries (whole texts and their first words), judged by the label of the query's vector."""
    whole = hundredth_texts(spark, sf)
    short = whole.select((-1 - F.col("query_id")).alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("text"))
    asked = whole.unionByName(short)
    docs = whole_documents(spark, sf)
    rel = relevant_counts(spark, sf)
    samples = rel.unionByName(rel.withColumn("query_id", -1 - F.col("query_id")))
    first = R.bm25(asked, R.matching_postings(docs, R.asked_terms(asked)), 10, tenant=False, digits=9)
    second = R.cover_rank(asked, docs, 10, digits=9, tenant=False)
    return metrics.compare_engines(samples, label_judge(spark, sf), first, second)


#: Queries made of every turn of every conversation, so that each rule meets many texts.
TEMPLATES = ["请问 {t} 吗", "请教一下{t}和别的方案的区别 呢", "{t}", '"{t}" 在哪里', "帮我看看 '{t}' 哈", "ABCDEFGH-1234 {t}", "{t}对比{t}和缓存的关系", "说说{t}与缓存之间", "向量检索以及{t}的关系 嘛", "它的{t}怎么样", "这个和那个", "versus {t}"]
ASKED = f"(SELECT conv_id * 100 + turn AS id, replace(([{', '.join(chr(39) + t.replace(chr(39), chr(39) * 2) + chr(39) for t in TEMPLATES)}])[(conv_id + turn) % {len(TEMPLATES)} + 1], '{{t}}', text) AS query FROM conversations)"


def asked(spark: SparkSession, sf: str) -> DataFrame:
    pick = F.element_at(F.array(*map(F.lit, TEMPLATES)), ((F.col("conv_id") + F.col("turn")) % len(TEMPLATES) + 1).cast("int"))
    return table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.replace(pick, F.lit("{t}"), F.col("text")).alias("query"))


def stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


REWRITE = stripped(rf"regexp_replace(regexp_replace({stripped('query')}, '^(请问|请教一下|我想知道|帮我|告诉我|能说下|可以说下|说说|讲讲){WS}*', ''), '{WS}+(吗|呢|吧|啊|呀|哈|嘛|哦){WS}*$', '')")
ANALYSED = rf"""a AS (SELECT id, {stripped('query')} AS query, {REWRITE} AS rewritten, regexp_matches(query, '"[^\n]+?"|''[^\n]+?''|[\pL\pN_]{{8,}}-[\pL\pN_]{{4,}}') AS kw,
regexp_matches(query, '对比|区别|不同|差异|比较|分别|各自|vs|versus|和[^\n]*的区') AS c, regexp_matches(query, '(和|与|以及|跟|同)[^\n]*(的|之间|关系|联系)') AS m FROM {ASKED}),
k AS (SELECT *, CASE WHEN kw THEN 'keyword' WHEN c AND m THEN 'multi_hop' WHEN c THEN 'compare' WHEN m THEN 'multi_hop' ELSE 'semantic' END AS kind FROM a)"""


def analysed(spark: SparkSession, sf: str) -> DataFrame:
    return asked(spark, sf).select("id", Q.analyse(F.col("query")).alias("a")).select("id", "a.*")


@query(f"WITH {ANALYSED} SELECT id, rewritten, kind, kw AS has_keyword, CASE WHEN kw THEN 0.3 ELSE 0.7 END::DOUBLE AS vector_weight, CASE WHEN kw THEN 0.7 ELSE 0.3 END::DOUBLE AS text_weight FROM k")
def qry1_qry2_qry4_qry6_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return analysed(spark, sf).select("id", "rewritten", "kind", "has_keyword", "vector_weight", "text_weight")


def _split_sql(joints: list[str]) -> str:
    left, right = (lambda j: stripped(f"left(query, strpos(query, '{j}') - 1)")), (lambda j: stripped(f"substr(query, strpos(query, '{j}') + {len(j)})"))
    arms = " ".join(f"WHEN strpos(query, '{j}') > 0 AND length({left(j)}) > 1 AND length({right(j)}) > 1 THEN [{left(j)}, {right(j)}]" for j in joints)
    return f"CASE {arms} ELSE [query] END"


@query(f"WITH {ANALYSED}, p AS (SELECT id, CASE WHEN kind = 'multi_hop' AND c AND m THEN {_split_sql(['和', '与', '以及', '跟'])} ELSE [rewritten] END AS s FROM k) SELECT id, unnest(range(len(s)))::INT AS i, unnest(s) AS sub_query FROM p")
def qry5_qry7_decompose(spark: SparkSession, sf: str) -> DataFrame:
    return analysed(spark, sf).select("id", F.posexplode("sub_queries").alias("i", "sub_query"))


def _answer(n: Column) -> Column:
    """What a model might say: JSON, fenced JSON, an unknown type, an array, broken text."""
    fence = F.lit("```")
    return (
        F.when(n % 5 == 0, '{"query_type": "compare", "sub_types": ["compare", "multi_hop"], "has_keyword": true}')
        .when(n % 5 == 1, F.concat(F.lit("So: "), fence, F.lit('json\n{"query_type": "semantic"}\n'), fence))
        .when(n % 5 == 2, '{"query_type": "poem"}').when(n % 5 == 3, '["compare"]').otherwise("no idea")
    )


@query(f"""WITH {ANALYSED} SELECT id, CASE WHEN kw THEN 'keyword' WHEN id % 5 = 0 THEN 'compare' WHEN id % 5 IN (1, 2) THEN 'semantic' ELSE kind END AS kind,
array_to_string(CASE WHEN kw THEN ['keyword'] WHEN id % 5 = 0 THEN ['compare', 'multi_hop'] WHEN id % 5 = 1 THEN ['semantic'] WHEN id % 5 = 2 THEN ['poem'] WHEN c AND m THEN ['compare', 'multi_hop'] ELSE [kind] END, ',') AS sub_types, kw OR id % 5 = 0 AS has_keyword FROM k""")
def qry3_model_class(spark: SparkSession, sf: str) -> DataFrame:
    """A model's classes, parsed; the rules where the answer is no JSON object."""
    c = Q.classify(F.col("query"), _answer(F.col("id")))
    return asked(spark, sf).select("id", c.alias("c")).select("id", "c.kind", F.array_join("c.sub_types", ",").alias("sub_types"), "c.has_keyword")


def conversations_asked(spark: SparkSession, sf: str) -> DataFrame:
    """Per conversation the last turn, made a question that refers back, and the turns before it."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.concat("text", F.when(F.col("turn") % 2 == 0, "的索引").otherwise("")).alias("content"))
    rows = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("t"))
    opening = F.element_at(F.array(*map(F.lit, ["它", "这个", "这", "plain ", "上面"])), (F.col("conv_id") % 5 + 1).cast("int"))
    before = F.transform(F.slice("t", F.lit(1), F.size("t") - 1), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return rows.select("conv_id", F.concat(opening, F.element_at("t", -1)["content"]).alias("query"), before.alias("history"))


ASKED_BACK = """c AS (SELECT conv_id, turn, role, text || CASE WHEN turn % 2 = 0 THEN '的索引' ELSE '' END AS content FROM conversations),
z AS (SELECT conv_id, max(turn) AS last FROM c GROUP BY 1), qy AS (SELECT c.conv_id, (['它', '这个', '这', 'plain ', '上面'])[c.conv_id % 5 + 1] || content AS query FROM c JOIN z ON z.conv_id = c.conv_id AND turn = last),
h AS (SELECT c.*, row_number() OVER (PARTITION BY c.conv_id ORDER BY turn DESC) AS back FROM c JOIN z ON z.conv_id = c.conv_id AND turn < last),
u AS (SELECT conv_id, count(*) AS n, arg_max(content, turn) FILTER (role = 'user' AND back <= 4) AS near, arg_max(content, turn) FILTER (role = 'user') AS far FROM h GROUP BY 1),
j AS (SELECT qy.*, coalesce(n, 0) AS n, far, list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(near, ''), '([一-鿿A-Za-z0-9\\s\\-\\.]{2,15})(?:的|之)', 1), lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: length(x) >= 2)) AS tp FROM qy LEFT JOIN u USING (conv_id))""".replace("\\\\", "\\")


@query(rf"""WITH {ASKED_BACK}, g AS (SELECT *, n > 0 AND regexp_matches(query, '它|他|她|这个|那个|这|那|其|此|上面|前面|刚刚') AS gated, CASE WHEN regexp_matches(query, '^(它|他|她|这个|那个)') AND len(tp) = 1 THEN tp[1] || regexp_replace(query, '^(它|他|她|这个|那个)', '') ELSE query END AS fast FROM j)
SELECT conv_id, gated, CASE WHEN NOT gated THEN query WHEN fast <> query THEN fast WHEN far IS NOT NULL THEN far || '，' || query ELSE query END AS resolved FROM g""")
def qry8_qry9_qry10_qry13_coreference(spark: SparkSession, sf: str) -> DataFrame:
    q, h = F.col("query"), F.col("history")
    return conversations_asked(spark, sf).select("conv_id", Q.needs_context(q, h).alias("gated"), Q.resolve(q, h).alias("resolved"))


@query(rf"""WITH {ASKED_BACK}, sd AS (SELECT conv_id, string_agg(content, ' ' ORDER BY turn) AS said, string_agg(CASE WHEN role = 'user' THEN 'Q: ' ELSE 'A: ' END || left(content, 200), chr(10) ORDER BY turn) FILTER (back <= 6) AS lines FROM h GROUP BY 1),
w AS (SELECT j.*, said, lines, CASE WHEN j.conv_id % 3 = 0 THEN query || ' Zanzibar' WHEN j.conv_id % 3 = 1 THEN coalesce(far, '') || query ELSE 'ab' END AS whole FROM j LEFT JOIN sd USING (conv_id)), l AS (SELECT * , {stripped("string_split(" + stripped("whole") + ", chr(10))[1]")} AS new FROM w),
x AS (SELECT *, list_filter(list_distinct(regexp_extract_all(new, '[一-鿿]{{2,8}}|[A-Z][a-zA-Z0-9\-]+')), lambda y: NOT list_contains(regexp_extract_all(query, '[一-鿿]{{2,8}}|[A-Z][a-zA-Z0-9\-]+'), y)) AS added FROM l)
SELECT conv_id, md5(coalesce(lines, '')) AS lines_md5, length(new) > 2 AND len(added) > 0 AND len(list_filter(added, lambda y: NOT contains(coalesce(said, ''), y))) = 0 AND length(new) <= 3 * length(query) AS valid FROM x""")
def qry11_qry12_set5_model_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """Rewrites as a model might send them: an invented name, words of the last user turn, too short a line."""
    rows = conversations_asked(spark, sf)
    n, q, h = F.col("conv_id"), F.col("query"), F.col("history")
    said = F.when(n % 3 == 0, F.concat(q, F.lit(" Zanzibar"))).when(n % 3 == 1, F.concat(F.coalesce(Q.last_user(h), F.lit("")), q)).otherwise("ab")
    new = Q.model_rewrite(F.concat(said, F.lit("\nsecond line")))
    return rows.select("conv_id", F.md5(Q.history_lines(h)).alias("lines_md5"), F.coalesce(Q.valid_rewrite(q, new, h), F.lit(False)).alias("valid"))


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS seq, CASE role WHEN 'user' THEN 'status' WHEN 'assistant' THEN 'token' ELSE 'error' END AS type, text AS data FROM conversations")
def snk6_answer_events(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation as the events that a client is streamed."""
    kind = F.when(F.col("role") == "user", "status").when(F.col("role") == "assistant", "token").otherwise("error")
    return agent.event_rows(table(spark, sf, "conversations").select("conv_id", "turn", kind.alias("type"), F.col("text").alias("data")), "conv_id", "turn")


#: A try of each conversation: its number and three scores follow from the id, so that all rules and ties occur.
JUDGED = "jd AS (SELECT conv_id, (conv_id % 5)::INT AS retry, (1 + conv_id % 5)::INT AS relevance, (1 + conv_id // 3 % 5)::INT AS groundedness, (1 + conv_id // 7 % 5)::INT AS consistency, arg_min(text, turn) AS original FROM conversations GROUP BY 1)"


def judged(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("run_id")
    first = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("run_id")).agg(F.min_by("text", "turn").alias("original"))
    score = lambda of: (1 + F.floor(n / of) % 5).cast("int")
    return first.select("run_id", (n % 5).cast("int").alias("retry"), score(1).alias("relevance"), score(3).alias("groundedness"), score(7).alias("consistency"), "original")


@query(f"""WITH {JUDGED}, s AS (SELECT *, least(relevance, groundedness, consistency) AS low, least(retry, 2) AS level FROM jd),
w AS (SELECT *, CASE WHEN groundedness = low THEN 'g' WHEN relevance = low THEN 'r' ELSE 'c' END AS d FROM s)
SELECT conv_id AS run_id, turn::INT AS step, (CASE WHEN d = 'g' THEN CASE WHEN level >= 2 THEN 60 ELSE 40 END WHEN d = 'r' THEN least(40 + 20 * (level + 1), 100) ELSE 50 END)::INT AS top_k,
(CASE WHEN d = 'g' AND level < 2 THEN 0.5 WHEN d = 'c' THEN 0.6 ELSE 0.7 END)::DOUBLE AS vector_weight, CASE WHEN d = 'g' AND level >= 2 THEN 'fulltext_search' ELSE 'hybrid_search' END AS tool,
CASE WHEN d = 'r' AND level >= 2 THEN original ELSE text END AS query FROM w JOIN conversations USING (conv_id) WHERE retry < 3
UNION ALL SELECT conv_id, 0, 100, 0.5, 'hybrid_search', original FROM w WHERE retry >= 3""")
def agt7_agg10_adjust(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation's turns as the steps of a plan that did not pass."""
    c = table(spark, sf, "conversations")
    steps = c.select(F.col("conv_id").alias("run_id"), F.col("turn").cast("int").alias("step"), F.lit("q").alias("id"), F.lit(agent.HYBRID).alias("tool"), F.col("text").alias("query"), F.lit(40).alias("top_k"), F.lit(0.7).alias("vector_weight"), F.array().cast("array<string>").alias("depends_on"))
    return agent.adjust(steps, judged(spark, sf)).select("run_id", "step", "top_k", "vector_weight", "tool", "query")


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, first(text) OVER (PARTITION BY conv_id ORDER BY turn) AS whole FROM conversations)
SELECT conv_id AS run_id, (i - 1)::INT AS step, 't' || turn AS id, CASE WHEN turn % 3 = 1 THEN 'fulltext_search' ELSE 'hybrid_search' END AS tool, CASE WHEN trim(text) = '' THEN whole ELSE trim(text) END AS query, least(30 + 30 * turn, 100)::INT AS top_k FROM c WHERE conv_id % 3 <> 2 AND i <= 3
UNION ALL SELECT conv_id, 0, 'q1', 'hybrid_search', whole, 40 FROM c WHERE conv_id % 3 = 2 AND i = 1""")
def agt3_agt13_plans(spark: SparkSession, sf: str) -> DataFrame:
    """Plans as a model might write them of each conversation's turns: bare, in a fence amid prose, or broken."""
    step = F.struct(F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"), F.element_at(F.array(F.lit(agent.HYBRID), F.lit(agent.FULLTEXT), F.lit("magic")), (F.col("turn") % 3 + 1).cast("int")).alias("tool"), F.col("text").alias("query"), F.struct((30 + 30 * F.col("turn")).alias("top_k")).alias("args"))
    turns = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("run_id")).agg(F.sort_array(F.collect_list(F.struct("turn", step.alias("s")))).alias("t"), F.min_by("text", "turn").alias("query"))
    plan = F.to_json(F.struct(F.transform("t", lambda x: x["s"]).alias("sub_queries")))
    kind = F.col("run_id") % 3
    answer = F.when(kind == 0, plan).when(kind == 1, F.concat(F.lit("Here it is:\n```json\n"), plan, F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("{broken "), F.left(plan, F.lit(20))))
    return agent.plan_steps(turns.select("run_id", "query", answer.alias("answer"))).select("run_id", "step", "id", "tool", "query", "top_k")


@query(f"WITH {ANALYSED} SELECT id, kind, CASE WHEN kind = 'keyword' OR kind = 'semantic' THEN 'simple' ELSE 'complex' END AS intent FROM k")
def agt2_intent(spark: SparkSession, sf: str) -> DataFrame:
    return analysed(spark, sf).select("id", "kind", agent.intent(F.col("kind"), F.size("sub_queries")).alias("intent"))


DIMENSION = "CASE WHEN relevance = least(relevance, groundedness, consistency) THEN 'relevance' WHEN groundedness = least(relevance, groundedness, consistency) THEN 'groundedness' ELSE 'consistency' END"


@query(f"""WITH {JUDGED}, s AS (SELECT *, least(relevance, groundedness, consistency) AS low, {DIMENSION} AS dim FROM jd)
SELECT conv_id AS run_id, CASE WHEN retry = 0 THEN '⚠️ 回答质量校验遇到异常，建议核实关键信息或换一种方式提问。' WHEN retry = 1 THEN '⚠️ 回答质量校验未通过（已重试 ' || retry || ' 次），请谨慎参考。'
 WHEN low <= 1 THEN '⚠️ 回答中可能存在事实性错误（' || dim || ' 评分 ' || low || '/5），建议直接查阅原始文档确认。' WHEN low <= 2 THEN '⚠️ 部分回答内容缺乏文档依据（' || dim || ' 评分 ' || low || '/5），建议对关键结论进行二次确认。'
 WHEN low <= 3 THEN '💡 回答质量中等（最低维度 ' || low || '/5），部分信息可能不够准确。' ELSE '回答质量尚可，但仍有提升空间（最低维度 ' || low || '/5）。' END AS warning FROM s""")
def agt9_warning(spark: SparkSession, sf: str) -> DataFrame:
    """Notes on each conversation's answer; the first try's check failed, the second has no scores."""
    dims = ("relevance", "groundedness", "consistency")
    rows = judged(spark, sf)
    low = F.when(F.col("retry") != 1, agent.lowest(*dims))
    return rows.select("run_id", agent.warning(F.when(F.col("retry") == 0, "parse_failed").otherwise("low quality"), low, F.least(*dims), F.col("retry")).alias("warning"))
