"""Exact deduplication with a heavy-hitter split, in DataFrame functions only.

Each row is reduced to the SHA-256 of its normalised text (A-Z lower-cased; null counts as empty) and only these
digests move. A Misra-Gries frequent-items summary (mergeable, ``capacity`` counters per task; every digest on more
than about rows/``capacity`` rows is in it) names candidates for the hot digests. Their exact counts are taken with
map-side aggregation, and those that are really hot (at most ``heavy`` rows, so the broadcast has a fixed bound) are
answered map-side: no hot group is ever shuffled. All other digests use an ordinary shuffled aggregation and join.

Defined cases: null text equals empty text; among repeated rows of the winning doc_id exactly one is kept; a null
doc_id sorts below every other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Most digests that are broadcast.
HEAVY = 1000
#: Counters of the frequent-items summary.
CAPACITY = 10_000


def normalised(text: Column) -> Column:
    """Lower-cases A-Z alone. Pure ASCII, where lower() does the same, takes the byte-wise path."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest and a row number, stored in the shared folder: text is read once."""
    return stored(docs.select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")


def grouped(rows: DataFrame) -> DataFrame:
    best = F.max(F.struct("doc_id", "row"))
    return rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))


def heavy_groups(rows: DataFrame, heavy: int = HEAVY, capacity: int = CAPACITY) -> DataFrame:
    """Exact groups of the digests that hold at least 1/``heavy`` of all rows: at most ``heavy`` of them."""
    top = rows.agg(F.expr(f"approx_top_k(digest, {heavy}, {capacity})").alias("top"), F.count(F.lit(1)).alias("n_rows"))
    found = top.select("n_rows", F.explode("top.item").alias("digest"))
    exact = rows.join(F.broadcast(found), "digest").groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size"), F.max("n_rows").alias("n_rows"))
    return exact.filter((F.col("group_size") > 1) & (F.col("group_size") * heavy >= F.col("n_rows"))).drop("n_rows")


def exact_dedup(docs: DataFrame, heavy: int = HEAVY, capacity: int = CAPACITY, rows: DataFrame | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = digests(docs) if rows is None else rows
    hot = F.broadcast(heavy_groups(rows, heavy, capacity))
    light = rows.join(hot.select("digest"), "digest", "left_anti")
    both = rows.join(hot, "digest").unionByName(light.join(grouped(light), "digest"))
    return both.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that exact_dedup drops; all columns stay as they were."""
    rows = digests(docs)
    verdict = stored(exact_dedup(docs, rows=rows).select("doc_id", "text_sha256", "kept"), "verdict")
    own, one, two = (fresh(name, docs.columns) for name in ("digest", "id", "other"))
    keyed = docs.withColumn(own, F.sha2(normalised(F.col("text")), 256))
    gone = verdict.filter(~F.col("kept")).select(F.col("doc_id").alias(one), F.col("text_sha256").alias(two)).distinct()
    both = verdict.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("k"), F.min("kept").alias("m"))
    if both.filter(F.col("k") & ~F.col("m")).isEmpty():
        out = keyed.join(gone, keyed["doc_id"].eqNullSafe(gone[one]) & (keyed[own] == gone[two]), "left_anti")
    else:  # rows repeat a kept doc_id and text: one of each stays
        stay = both.filter("k").select(F.col("doc_id").alias(one), F.col("text_sha256").alias(two))
        out = keyed.join(stay, keyed["doc_id"].eqNullSafe(stay[one]) & (keyed[own] == stay[two]), "left_semi").dropDuplicates(["doc_id", own])
    return out.select(*docs.columns)


ORACLE = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
