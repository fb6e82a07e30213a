"""The content-addressed pool and the documents around it: upserts, audits and repair, deletion, cloning, backfill."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.session import kept

from ragloom.functions.text import parent_link


class Tables(NamedTuple):
    """What a consistency job reads and gives back. ``vectors`` and ``texts`` are the two indexes' chunks."""

    documents: DataFrame
    chunks: DataFrame
    pool: DataFrame
    vectors: DataFrame
    texts: DataFrame


def references(chunks: DataFrame) -> DataFrame:
    """content_hash, doc_refs (distinct documents, as written), chunk_refs (rows, as audited)."""
    return chunks.groupBy("content_hash").agg(F.countDistinct("document_id").alias("doc_refs"), F.count(F.lit(1)).alias("chunk_refs"))


def upsert(pool: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pool after the chunks' documents were added: new hashes come in, old ones keep content and vector and gain references."""
    order = F.struct("document_id", "chunk_index")
    new = chunks.groupBy("content_hash").agg(F.min_by("content", order).alias("new_content"), F.countDistinct("document_id").alias("new_refs"))
    both = pool.join(new, "content_hash", "full")
    return both.select("content_hash", F.coalesce("content", "new_content").alias("content"), (F.coalesce("ref_count", F.lit(0)) + F.coalesce("new_refs", F.lit(0))).cast("long").alias("ref_count"))


def insert_chunks(made: DataFrame, chunk_id: Column) -> DataFrame:
    """Rows of the chunk table from a document's chunks: made(document_id, user_id, chunk_index, parent_index, ...).

    ``chunk_id`` names a chunk by document_id and chunk_index; parents get theirs by the same rule.
    """
    place = parent_link(F.col("chunk_index"), F.col("parent_index"))
    parents = made.select("document_id", F.col("chunk_index").alias("_p"), chunk_id.alias("parent_chunk_id"))
    rows = made.withColumn("chunk_id", chunk_id).withColumn("_p", place)
    return rows.join(parents, ["document_id", "_p"], "left").drop("_p", "parent_index")


def audit(pool: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pool rows whose stored reference count is not the counted one."""
    counted = chunks.groupBy("content_hash").agg(F.count(F.lit(1)).alias("actual"))
    return pool.join(counted, "content_hash", "left").select("content_hash", "ref_count", F.coalesce("actual", F.lit(0)).alias("actual")).filter("ref_count <> actual")


def repair_counts(pool: DataFrame, chunks: DataFrame) -> DataFrame:
    """The pool with audited reference counts."""
    fixed = audit(pool, chunks).select("content_hash", F.col("actual").alias("_actual"))
    return pool.join(fixed, "content_hash", "left").withColumn("ref_count", F.coalesce("_actual", "ref_count")).drop("_actual")


def release(pool: DataFrame, chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """Pool after the documents in ``gone`` (document_id) went: a document counts once per hash, counts floor at 0, empty rows go."""
    lost = chunks.join(gone, "document_id", "left_semi").groupBy("content_hash").agg(F.countDistinct("document_id").alias("_lost"))
    left = pool.join(lost, "content_hash", "left").withColumn("ref_count", F.greatest(F.col("ref_count") - F.coalesce("_lost", F.lit(0)), F.lit(0))).drop("_lost")
    return left.filter("ref_count > 0")


def delete_documents(pool: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pool, chunks) after the documents in ``gone`` went from both indexes."""
    return release(pool, chunks, gone), chunks.join(gone, "document_id", "left_anti")


def delete(t: Tables, gone: DataFrame, vectors_ok: bool = True, texts_ok: bool = True) -> Tables:
    """Documents deleted by their owner: both indexes first; only if both answered do chunks and references go too.

    Otherwise the chunks are marked ``pending`` for ``reconcile``. The documents are soft-deleted either way.
    chunks need a cleanup_status, documents an is_deleted column.
    """
    away = lambda df: df.join(gone, "document_id", "left_anti")
    mark = gone.select("document_id", F.lit(True).alias("_gone"))
    documents = t.documents.join(mark, "document_id", "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("_gone", F.lit(False))).drop("_gone")
    vectors, texts = (away(t.vectors) if vectors_ok else t.vectors), (away(t.texts) if texts_ok else t.texts)
    if vectors_ok and texts_ok:
        pool, chunks = delete_documents(t.pool, t.chunks, gone)
    else:
        pool, chunks = t.pool, t.chunks.join(mark, "document_id", "left").withColumn("cleanup_status", F.when(F.col("_gone"), "pending").otherwise(F.col("cleanup_status"))).drop("_gone")
    return Tables(documents, chunks, pool, vectors, texts)


def tenant_totals(totals: DataFrame, documents: DataFrame, chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """user_id, storage_used, vector_count after the documents in ``gone`` went; neither falls below 0."""
    size = documents.join(gone, "document_id", "left_semi").groupBy("user_id").agg(F.sum("file_size").alias("_size"))
    count = chunks.join(gone, "document_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = totals.join(size, "user_id", "left").join(count, "user_id", "left")
    less = lambda c, by: F.greatest(F.coalesce(c, F.lit(0)) - F.coalesce(by, F.lit(0)), F.lit(0))
    return rows.select("user_id", less("storage_used", "_size").alias("storage_used"), less("vector_count", "_n").alias("vector_count"))


def pending_documents(chunks: DataFrame) -> DataFrame:
    return chunks.filter("cleanup_status = 'pending'").select("document_id").distinct()


def reconcile(t: Tables, vectors_ok: bool = True, texts_ok: bool = True) -> Tables:
    """Deletions that are pending, tried again."""
    return delete(t, pending_documents(t.chunks), vectors_ok, texts_ok)


def collect_garbage(pool: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hashes to drop: no references stored and none left in chunks."""
    return pool.filter("ref_count <= 0").join(chunks, "content_hash", "left_anti").select("content_hash")


def clone(chunks: DataFrame, source: str, target: str, owner: str) -> DataFrame:
    """A document's chunks for another user: new ids derived from the target, parents mapped through the same rule."""
    pair = chunks.sparkSession.createDataFrame([(source, target, owner)], "source string, target string, owner string")
    return clone_all(chunks, pair)


def clone_all(chunks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Chunks of every clone in pairs(source, target, owner). A parent outside the document keeps its id."""
    rows = chunks.join(pairs, F.col("document_id").cast("string") == F.col("source"))
    new_id = lambda c: F.sha2(F.concat_ws(":", F.col("target"), c), 256)
    ids = rows.select("target", F.col("chunk_id").alias("parent_chunk_id"), new_id(F.col("chunk_id")).alias("_parent"))
    mapped = rows.join(ids, ["target", "parent_chunk_id"], "left")
    return mapped.withColumns({"chunk_id": new_id(F.col("chunk_id")), "parent_chunk_id": F.coalesce("_parent", "parent_chunk_id"), "document_id": F.col("target"), "user_id": F.col("owner")}).drop("source", "target", "owner", "_parent")


def retain(pool: DataFrame, clones: DataFrame) -> DataFrame:
    """The pool with one more reference per hash and cloned document."""
    more = clones.groupBy("content_hash").agg(F.countDistinct("document_id").alias("_more"))
    return pool.join(more, "content_hash", "left").withColumn("ref_count", F.col("ref_count") + F.coalesce("_more", F.lit(0))).drop("_more")


def index_difference(stored_ids: DataFrame, indexed_ids: DataFrame) -> DataFrame:
    """id, state: 'missing' in the index or 'orphaned' there."""
    missing = stored_ids.select("id").join(indexed_ids, "id", "left_anti").withColumn("state", F.lit("missing"))
    return missing.unionByName(indexed_ids.select("id").join(stored_ids, "id", "left_anti").withColumn("state", F.lit("orphaned")))


def index_rows(chunks: DataFrame, pool: DataFrame) -> DataFrame:
    """chunk_id, user_id, document_id, content_hash, embedding, snippet: the vector index's rows of child chunks with a vector."""
    child = chunks.filter("chunk_type = 'child'").select("chunk_id", "user_id", "document_id", "content_hash")
    known = pool.filter(F.col("embedding").isNotNull()).select("content_hash", "embedding", F.left("content", F.lit(500)).alias("snippet"))
    return child.join(known, "content_hash")


def missing_rows(chunks: DataFrame, pool: DataFrame, vectors: DataFrame) -> DataFrame:
    """The rows that the vector index lacks, made from the pool: no text is embedded again."""
    return index_rows(chunks, pool).join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def promotable(documents: DataFrame, chunks: DataFrame, pool: DataFrame) -> DataFrame:
    """Pending documents none of whose child chunks still waits for a vector."""
    waiting = chunks.filter("chunk_type = 'child'").join(pool.filter("needs_embedding"), "content_hash", "left_semi").select("document_id")
    return documents.filter("processing_status = 'pending_embedding'").join(waiting, "document_id", "left_anti")


def backfill(pool: DataFrame, embedded: DataFrame) -> DataFrame:
    """The pool after the hashes in embedded(content_hash, embedding) got their vectors."""
    new = embedded.select("content_hash", F.col("embedding").alias("_new"))
    rows = pool.join(new, "content_hash", "left")
    done = F.col("_new").isNotNull()
    return rows.withColumns({"embedding": F.coalesce("_new", "embedding"), "needs_embedding": F.col("needs_embedding") & ~done}).drop("_new")


def batch(pool: DataFrame, size: int = 200) -> DataFrame:
    """The next hashes to embed, in order of hash."""
    return pool.filter("needs_embedding").orderBy("content_hash").limit(size)


def promote(documents: DataFrame, chunks: DataFrame, pool: DataFrame) -> DataFrame:
    ready = promotable(documents, chunks, pool).select("document_id", F.lit(True).alias("_ready"))
    return documents.join(ready, "document_id", "left").withColumn("processing_status", F.when(F.col("_ready"), "ready").otherwise(F.col("processing_status"))).drop("_ready")


#: Rows of a range in which places are counted.
RANGE_ROWS = 1 << 20


def placed(rows: DataFrame, key: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``place``, from 0 in order of the unique ``key``: a two-level scan over as many ranges as the rows need.

    Rows are dealt to ranges of the key, sorted and stored with their places there. Ranges' counts are summed in groups of
    ranges and the groups' counts after, so no task sees more than a range's rows, or a group's ranges.
    """
    ranges = max(1, -(-rows.count() // range_rows))
    group = 1 << 10
    dealt = rows.repartitionByRange(ranges, key).sortWithinPartitions(key).withColumn("_m", F.monotonically_increasing_id())
    dealt = kept(dealt.withColumns({"_part": F.shiftright("_m", 33), "_i": F.col("_m").bitwiseAND((1 << 33) - 1)}).drop("_m"), "placed")
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_grp", F.floor(F.col("_part") / group))
    within = F.sum("_n").over(Window.partitionBy("_grp").orderBy("_part")) - F.col("_n")
    totals = counts.groupBy("_grp").agg(F.sum("_n").alias("_all"))
    before = totals.select("_grp", (F.sum("_all").over(Window.orderBy("_grp")) - F.col("_all")).alias("_before"))
    starts = counts.withColumn("_within", within).join(before, "_grp").select("_part", (F.col("_within") + F.col("_before")).alias("_start"))
    return dealt.join(starts, "_part").withColumn("place", F.col("_start") + F.col("_i")).drop("_part", "_i", "_start")


def pages(ids: DataFrame, key: str, size: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``ids`` with the page that each falls on, in order of ``key``."""
    return placed(ids, key, range_rows).withColumn("page", F.floor(F.col("place") / size).cast("int")).drop("place")


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Keyed overwrite: of each key the row with the highest version stays."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).filter("_r = 1").drop("_r")


def update(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Partial update: a column of ``changes`` that is null leaves the row's value."""
    fields = [c for c in changes.columns if c != key]
    named = changes.select(key, *(F.col(c).alias(f"_{c}") for c in fields))
    return rows.join(named, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in fields}).drop(*(f"_{c}" for c in fields))


def insert_unique(rows: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with the new ones, new rows that are refused): a key that is taken, also by an earlier new row, is refused."""
    order = Window.partitionBy(*keys).orderBy(*([c for c in new.columns if c not in keys] or keys))
    first = new.withColumn("_r", F.row_number().over(order)).join(rows.select(*keys).distinct().withColumn("_taken", F.lit(True)), keys, "left")
    good = first.filter("_r = 1 and _taken is null").drop("_r", "_taken")
    return rows.unionByName(good), first.filter("_r > 1 or _taken").drop("_r", "_taken")


def soft_delete(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    mark = gone.select(key, F.lit(True).alias("_gone"))
    return rows.join(mark, key, "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("_gone", F.lit(False))).drop("_gone")


#: What a document's state may become.
TRANSITIONS = {
    "pending": ("parsing", "cloning"), "parsing": ("chunking", "failed"), "chunking": ("embedding", "pending_embedding", "failed"),
    "embedding": ("ready", "failed"), "pending_embedding": ("ready",), "cloning": ("ready", "failed"), "ready": (), "failed": (),
}


def allowed(before: Column, after: Column) -> Column:
    """Is this change of a document's state one that the machine knows?"""
    out = F.lit(False)
    for state, then in TRANSITIONS.items():
        out = F.when(before == state, after.isin(*then) if then else F.lit(False)).otherwise(out)
    return out


def next_state(state: Column, ok: Column, has_children: Column, api_ok: Column) -> Column:
    """The state after one step of processing: ``ok`` if the step succeeded."""
    return (
        F.when(state.isin("ready", "failed"), state).when((state == "pending_embedding"), F.when(api_ok, "ready").otherwise(state)).when(~ok, "failed")
        .when(state == "pending", "parsing").when(state == "parsing", "chunking")
        .when(state == "chunking", F.when(api_ok & has_children, "embedding").otherwise("pending_embedding"))
        .when(state.isin("embedding", "cloning"), "ready").otherwise(state)
    )
