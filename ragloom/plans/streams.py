"""Batch forms of the keyed-state operators, metrics and logs over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.operators import clients
from ragloom.registry import query
from ragloom.session import table
from ragloom.sinks import metrics as M
from ragloom.streaming import operators as S


def _windows_sql(key: str, seconds: int) -> str:
    return f"""WITH RECURSIVE e AS (SELECT {key} AS k, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS r FROM events),
s AS (SELECT k, event_id, r, us AS opened, 1 AS n FROM e WHERE r = 1 UNION ALL
 SELECT e.k, e.event_id, e.r, CASE WHEN e.us >= s.opened + {seconds}000000 THEN e.us ELSE s.opened END, CASE WHEN e.us >= s.opened + {seconds}000000 THEN 1 ELSE s.n + 1 END FROM s JOIN e ON e.k = s.k AND e.r = s.r + 1)"""


@query(f"{_windows_sql('user_id', 3600)} SELECT k AS user_id, event_id, n <= 1 AS allowed FROM s")
def str1_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    return S.rate_limit(table(spark, sf, "events"), limit=1)


@query(f"{_windows_sql('event_type', 300)} SELECT k AS event_type, event_id, n <= 1 AS got FROM s")
def str3_processing_lock(spark: SparkSession, sf: str) -> DataFrame:
    """Each request's chance of the lock of its key, which is held for 300 seconds."""
    return S.processing_lock(table(spark, sf, "events"), "event_type")


@query("""WITH m AS (SELECT date_trunc('minute', ts) AS m, quantile_disc(value, 0.95) AS p FROM events GROUP BY 1), s AS (SELECT time_bucket(INTERVAL 5 MINUTE, m) AS w, min(p) > 40 AS slow_alert FROM m GROUP BY 1)
SELECT epoch(w)::BIGINT AS start_s, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(quantile_disc(value, 0.95), 6) AS p95, count(*) FILTER (event_type = 'error') > 0.05 * count(*) AS error_alert, any_value(slow_alert) AS slow_alert
FROM events JOIN s ON w = time_bucket(INTERVAL 5 MINUTE, ts) GROUP BY w""")
def str8_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return S.alerts(table(spark, sf, "events"), slow=40.0).withColumn("p95", F.round("p95", 6))


@query("SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_s, event_type, count(*) AS n, count(*) > CASE event_type WHEN 'signup' THEN 1 ELSE 2 END AS alert FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1, 2, event_type")
def str8_hourly_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Two kinds of events that must not come too often in an hour."""
    return S.hourly_alerts(table(spark, sf, "events"), {"signup": 1, "purchase": 2})


@query("""WITH a AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS place FROM a WHERE event_type = 'error') SELECT user_id, event_id FROM b WHERE place = 3""")
def str8_failover_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Three failed checks in a row."""
    return S.failing_streaks(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") != "error").select("user_id", "event_id")


@query("SELECT conv_id AS answer_id, string_agg(text, '' ORDER BY turn) AS answer FROM conversations WHERE turn < 6 AND turn <> 1 GROUP BY 1")
def str5_token_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as a model server sends them: turn 1 is broken JSON, turn 6 the sentinel."""
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    line = F.when(F.col("turn") == 1, "data: {broken").when(F.col("turn") == 6, "data: [DONE]").otherwise(F.concat(F.lit("data: "), body))
    return S.token_stream(table(spark, sf, "conversations").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("i"), line.alias("line")))


CACHED = "SELECT md5(text) AS key FROM documents WHERE doc_id % 3 = 0 AND doc_id % 4 <> 0"


@query(f"SELECT doc_id, md5(text) AS key, CASE WHEN md5(text) IN ({CACHED}) THEN 'cache' ELSE 'dummy' END AS source, 64::INT AS dim, 1.0::DOUBLE AS norm FROM documents WHERE text IS NOT NULL")
def ret16_ret17_str2_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """The embedding chain over all documents: entries in their time to live first, then clients (here one that fails), then
    the deterministic default; each distinct miss is computed once."""
    docs = table(spark, sf, "documents").filter("text is not null")
    now = F.lit("2024-06-30 00:00:00").cast("timestamp")
    age = F.when(F.col("doc_id") % 4 == 0, 8 * 86400).otherwise(86400)
    kept = docs.filter("doc_id % 3 = 0").select(F.md5("text").alias("key"), F.array_repeat(F.lit(0.125).cast("float"), 64).alias("embedding"), (now - F.make_interval(secs=age)).alias("stored_at"))
    made = clients.embed(docs.select("doc_id", "text"), {"api": Broken()}, 64, S.live_entries(kept, now))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return made.select("doc_id", "key", "source", F.size("embedding").alias("dim"), F.round(norm, 4).alias("norm"))


class Broken:
    """An embedding client that is down."""

    def encode(self, texts: list[str]) -> list[list[float]] | None:
        raise ConnectionError("down")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def str6_snk7_win7_status_changes(spark: SparkSession, sf: str) -> DataFrame:
    return S.status_changes(table(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


BOUNDS = {
    0: ("agent_execution_duration_seconds", [0.5, 1, 2, 5, 10, 30]), 1: ("embedding_api_duration_seconds", [0.1, 0.3, 0.5, 1, 3, 5]), 2: ("intent_classify_duration_seconds", [0.01, 0.05, 0.1, 0.3, 1]), 3: ("rag_llm_duration_seconds", [1, 3, 5, 10, 30, 60]),
    4: ("ocr_api_duration_seconds", [0.5, 1, 2, 5, 10]), 5: ("agent_reflection_scores", [1, 2, 3, 4, 5]), 6: ("rerank_api_duration_seconds", [0.1, 0.3, 0.5, 1, 2]), 7: ("rag_rerank_duration_seconds", [0.1, 0.3, 0.5, 1, 2, 5]),
    8: ("rag_results_count", [1, 3, 5, 10, 20]), 9: ("rag_retrieval_duration_seconds", [0.5, 1, 2, 5, 10, 30]), 10: ("agent_tool_call_duration_seconds", [0.1, 0.3, 0.5, 1, 2, 5]),
}
METRICS = "(VALUES " + ", ".join(f"({i}, '{name}', {b}::DOUBLE[])" for i, (name, b) in BOUNDS.items()) + ") m(i, metric, bounds)"


@query(f"""WITH v AS (SELECT metric, event_type AS dimension, bounds, value FROM events JOIN {METRICS} ON i = event_id % 11), l AS (SELECT *, unnest(bounds) AS le FROM v)
SELECT metric, dimension, le, count(*) FILTER (value <= le) AS n FROM l GROUP BY 1, 2, 3 UNION ALL SELECT metric, dimension, NULL, count(*) FROM v GROUP BY 1, 2""")
def agg12_snk9_histograms(spark: SparkSession, sf: str) -> DataFrame:
    """All eleven histograms; an event is taken for an observation of the metric that its id names."""
    names = F.array(*(F.lit(name) for _, (name, _) in sorted(BOUNDS.items())))
    rows = table(spark, sf, "events").select(names[(F.col("event_id") % 11).cast("int")].alias("metric"), F.col("event_type").alias("dimension"), "value")
    return M.histograms(rows, "dimension")


@query("""SELECT CASE event_type WHEN 'error' THEN 'api_error_total' WHEN 'click' THEN 'agent_api_calls_total' ELSE 'agent_retry_total' END AS metric,
CASE event_type WHEN 'error' THEN '{"service":"s' || user_id % 3 || '"}' WHEN 'click' THEN '{"service":"s' || user_id % 3 || '","node":"n' || user_id % 2 || '"}' ELSE '{}' END AS labels, count(*) AS total FROM events GROUP BY 1, 2""")
def snk9_counters(spark: SparkSession, sf: str) -> DataFrame:
    metric = F.when(F.col("event_type") == "error", "api_error_total").when(F.col("event_type") == "click", "agent_api_calls_total").otherwise("agent_retry_total")
    label = lambda name, n: (F.lit(name), F.concat(F.lit(name[0]), (F.col("user_id") % n).cast("string")))
    rows = table(spark, sf, "events").select(metric.alias("metric"), F.lit(1).alias("by"), F.create_map(*label("service", 3), *label("node", 2)).alias("labels"))
    return M.counters(rows)


@query("SELECT 'model_memory_bytes' AS metric, event_type AS label, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 2")
def snk9_gauge(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.lit("model_memory_bytes").alias("metric"), F.col("event_type").alias("label"), "value", F.struct("ts", "event_id").alias("at"))
    return M.gauges(rows)


@query("""SELECT event_id, '{"timestamp":"' || strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || '","level":"' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || '","logger":"' || event_type || '","message":"user ' || user_id || '"}' AS line FROM events""")
def snk10_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    return table(spark, sf, "events").select("event_id", M.log_line(F.col("ts"), level, F.col("event_type"), F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("line"))
