"""Metrics and log lines as tables: histograms with fixed bounds, counters, gauges, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of each histogram's buckets.
HISTOGRAMS = {
    "rag_retrieval_duration_seconds": (0.5, 1, 2, 5, 10, 30),
    "rag_results_count": (1, 3, 5, 10, 20),
    "rag_rerank_duration_seconds": (0.1, 0.3, 0.5, 1, 2, 5),
    "rag_llm_duration_seconds": (1, 3, 5, 10, 30, 60),
    "embedding_api_duration_seconds": (0.1, 0.3, 0.5, 1, 3, 5),
    "rerank_api_duration_seconds": (0.1, 0.3, 0.5, 1, 2),
    "ocr_api_duration_seconds": (0.5, 1, 2, 5, 10),
    "agent_execution_duration_seconds": (0.5, 1, 2, 5, 10, 30),
    "agent_tool_call_duration_seconds": (0.1, 0.3, 0.5, 1, 2, 5),
    "intent_classify_duration_seconds": (0.01, 0.05, 0.1, 0.3, 1),
    "agent_reflection_scores": (1, 2, 3, 4, 5),
}
#: Counters and gauges, with their labels.
COUNTERS = {"api_error_total": ("service",), "agent_retry_total": (), "agent_degrade_total": (), "intent_classify_total": ("intent",), "agent_api_calls_total": ("service", "node"), "rag_data_loss_total": ()}
GAUGES = {"model_memory_bytes": ("model_name",)}


def histograms(observed: DataFrame, *labels: str) -> DataFrame:
    """metric, labels, le, n: cumulative counts of observed(metric, value, labels); le is null for all values."""
    bounds = F.create_map(*(x for name, le in HISTOGRAMS.items() for x in (F.lit(name), F.array(*(F.lit(float(b)) for b in le)))))
    each = observed.filter(F.col("metric").isin(*HISTOGRAMS)).withColumn("bounds", bounds[F.col("metric")])
    # a value counts once, in the first bucket that holds it; sums over the buckets below make the counts cumulative
    first = F.filter("bounds", lambda b: b >= F.col("value"))
    each = each.select("metric", *labels, "bounds", F.get(first, F.lit(0)).alias("own"))
    counts = each.groupBy("metric", *labels, "bounds", "own").agg(F.count(F.lit(1)).alias("n"))
    series = counts.groupBy("metric", *labels, "bounds").agg(F.collect_list(F.struct("own", "n")).alias("c"), F.sum("n").alias("total"))
    cumulative = F.transform("bounds", lambda b: F.struct(b.alias("le"), F.aggregate(F.filter("c", lambda x: x["own"] <= b), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n")))
    every = F.array(F.struct(F.lit(None).cast("double").alias("le"), F.col("total").alias("n")))
    return series.select("metric", *labels, F.inline(F.concat(cumulative, every)))


def counters(increments: DataFrame) -> DataFrame:
    """metric, labels (JSON, of those that the metric has), total of increments(metric, by, labels as a map)."""
    known = F.create_map(*(x for name, own in COUNTERS.items() for x in (F.lit(name), F.array(*map(F.lit, own)).cast("array<string>"))))
    own = F.map_filter("labels", lambda k, v: F.array_contains(known[F.col("metric")], k))
    rows = increments.filter(F.col("metric").isin(*COUNTERS)).select("metric", "by", F.to_json(F.coalesce(own, F.create_map().cast("map<string,string>"))).alias("labels"))
    return rows.groupBy("metric", "labels").agg(F.sum("by").alias("total"))


def gauges(settings: DataFrame) -> DataFrame:
    """metric, label, value last set; settings(metric, label, value, at)."""
    return settings.filter(F.col("metric").isin(*GAUGES)).groupBy("metric", "label").agg(F.max_by("value", "at").alias("value"))


def log_line(at: Column, level: Column, name: Column, message: Column) -> Column:
    """One JSON line."""
    return F.to_json(F.struct(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("timestamp"), level.alias("level"), name.alias("logger"), message.alias("message")))
