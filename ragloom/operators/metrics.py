"""Retrieval-quality metrics over ranked lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def recall_at(retrieved: Column, relevant: Column, k: int) -> Column:
    """Share of the relevant ids among the first k; 0 without relevant ids."""
    met = F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant))
    return F.when(F.size(relevant) > 0, met / F.size(F.array_distinct(relevant))).otherwise(F.lit(0.0))


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    ranks = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda x: x.isNotNull())
    return F.when(F.size(ranks) > 0, 1.0 / ranks[0]).otherwise(F.lit(0.0))


def ndcg_at(retrieved: Column, relevant: Column, k: int) -> Column:
    gain = F.aggregate(F.transform(F.slice(retrieved, 1, k), lambda x, i: F.when(F.array_contains(relevant, x), 1.0 / F.log2(i + 2.0)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    most = F.least(F.size(relevant), F.lit(k))
    ideal = F.when(most > 0, F.aggregate(F.sequence(F.lit(1), most), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0)))
    return F.when(most > 0, gain / ideal).otherwise(F.lit(0.0))


def evaluate(samples: DataFrame, results: DataFrame) -> DataFrame:
    """Per query: recall_5, recall_10, mrr, ndcg_10; samples(query_id, relevant), results(query_id, id, rank0). No result counts as empty."""
    lists = results.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank0", "id"))), lambda x: x["id"]).alias("retrieved"))
    both = samples.join(lists, "query_id", "left")
    kind = dict(lists.dtypes)["retrieved"]
    got, rel = F.coalesce("retrieved", F.array().cast(kind)), F.col("relevant")
    return both.select("query_id", recall_at(got, rel, 5).alias("recall_5"), recall_at(got, rel, 10).alias("recall_10"), reciprocal_rank(got, rel).alias("mrr"), ndcg_at(got, rel, 10).alias("ndcg_10"))


def evaluate_hits(samples: DataFrame, hits: DataFrame) -> DataFrame:
    """The same without lists of relevant ids: samples(query_id, n_relevant), hits(query_id, rank0, hit)."""
    good = hits.filter("hit").groupBy("query_id").agg(
        F.count_if(F.col("rank0") < 5).alias("h5"), F.count_if(F.col("rank0") < 10).alias("h10"), F.min("rank0").alias("first"),
        F.sum(F.when(F.col("rank0") < 10, 1.0 / F.log2(F.col("rank0") + 2.0))).alias("gain"),
    )
    both = samples.join(good, "query_id", "left")
    share = lambda c: recall(c, F.col("n_relevant"))
    most = F.least(F.col("n_relevant"), F.lit(10)).cast("int")
    ideal = F.aggregate(F.sequence(F.lit(1), most), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    ndcg = F.when(most > 0, F.coalesce("gain", F.lit(0.0)) / ideal).otherwise(F.lit(0.0))
    return both.select("query_id", share(F.col("h5")).alias("recall_5"), share(F.col("h10")).alias("recall_10"), F.coalesce(1.0 / (F.col("first") + 1), F.lit(0.0)).alias("mrr"), ndcg.alias("ndcg_10"))


def sweep(lists: DataFrame, samples: DataFrame, judge: Callable[[DataFrame], DataFrame], ks: tuple[int, ...] = (10, 30, 60, 100), vector_weights: tuple[float, ...] = (0.3, 0.5, 0.7)) -> DataFrame:
    """k, vector_weight, recall_at_5, recall_at_10 for every pair of parameters, in one job.

    lists(query_id, chunk_id, engine, rank0, norm) as ``retrieval.contributions`` makes them; samples(query_id,
    n_relevant); ``judge`` adds ``hit`` to rows(query_id, chunk_id): is the chunk relevant? Only the best ten are judged.
    """
    grid = F.broadcast(lists.sparkSession.createDataFrame([(k, w) for k in ks for w in vector_weights], "k int, vector_weight double"))
    weight = F.when(F.col("engine") == "v", F.col("vector_weight")).otherwise(1 - F.col("vector_weight"))
    place = lambda e: F.min(F.when(F.col("engine") == e, F.col("rank0")))
    fused = lists.join(grid).groupBy("k", "vector_weight", "query_id", "chunk_id").agg(F.sum(weight * F.col("norm") / (F.col("k") + F.col("rank0") + 1)).alias("score"), place("v").alias("v"), place("t").alias("t"))
    order = Window.partitionBy("k", "vector_weight", "query_id").orderBy(F.desc("score"), F.asc_nulls_last("v"), F.asc_nulls_last("t"), F.asc("chunk_id"))
    top = judge(fused.withColumn("rank0", F.row_number().over(order) - 1).filter("rank0 < 10"))
    got = top.groupBy("k", "vector_weight", "query_id").agg(F.count_if(F.col("hit") & (F.col("rank0") < 5)).alias("h5"), F.count_if("hit").alias("h10"))
    each = samples.join(grid).join(got, ["k", "vector_weight", "query_id"], "left")
    mean = lambda k: F.avg(recall(F.col(f"h{k}"), F.col("n_relevant"))).alias(f"recall_at_{k}")
    return each.groupBy("k", "vector_weight").agg(mean(5), mean(10))


def recall(hits: Column, relevant: Column) -> Column:
    """Hits out of relevant ones; 0 where there is none."""
    return F.when(relevant > 0, F.coalesce(hits, F.lit(0)) / relevant).otherwise(F.lit(0.0))


def compare_engines(samples: DataFrame, judge: Callable[[DataFrame], DataFrame], first: DataFrame, second: DataFrame, k: int = 10) -> DataFrame:
    """primary_recall, fallback_recall and degradation (a percentage, N/A without primary recall): mean recall at k.

    samples(query_id, n_relevant); hits (query_id, chunk_id, score) of both engines; ``judge`` as in ``sweep``.
    """
    rows = samples
    for name, hits in (("a", first), ("b", second)):
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
        top = judge(hits.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)).groupBy("query_id").agg(F.count_if("hit").alias(name))
        rows = rows.join(top, "query_id", "left")
    means = rows.agg(*(F.coalesce(F.avg(recall(F.col(c), F.col("n_relevant"))), F.lit(0.0)).alias(c) for c in ("a", "b")))
    lost = F.format_string("%.1f%%", F.round((1 - F.col("b") / F.col("a")) * 100, 6))
    return means.select(F.round("a", 6).alias("primary_recall"), F.round("b", 6).alias("fallback_recall"), F.when(F.col("a") > 0, lost).otherwise("N/A").alias("degradation"))


class LastResult:
    """The last evaluation's result, kept as a table that every session can read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, per_query: DataFrame) -> None:
        macro(per_query).write.mode("overwrite").parquet(f"{self.path}/macro")
        per_query.write.mode("overwrite").parquet(f"{self.path}/details")

    def load(self) -> tuple[DataFrame, DataFrame] | None:
        """(macro means, details per query), None if nothing was evaluated yet."""
        try:
            return self.spark.read.parquet(f"{self.path}/macro"), self.spark.read.parquet(f"{self.path}/details")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None


def macro(per_query: DataFrame) -> DataFrame:
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(n) for c, n in (("recall_5", "recall_at_5"), ("recall_10", "recall_at_10"), ("mrr", "mrr"), ("ndcg_10", "ndcg_at_10"))]
    return per_query.agg(*means, F.count(F.lit(1)).cast("int").alias("total_queries"))
