"""Index tables on any file system that Spark writes: vectors by tenant, block-max postings by bucket of their term.

Both are tables of runs (``LogTable``): inserts and deletions write in proportion to themselves, readers keep their version.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions.text import query_terms, snippet
from ragloom.operators import retrieval as R
from ragloom.session import kept
from ragloom.sinks.logtable import LogTable

#: Characters of a text that the vector table keeps beside a vector.
SNIPPET = 500
#: Folders that terms and chunks are dealt to; more for larger tables.
BUCKETS = 8
#: Chunks of a tenant that share a range, and bytes of their texts: a block holds one term's postings in one range.
RANGE_CHUNKS = 128
RANGE_BYTES = 4 << 20
#: Most ids of changed chunks that are broadcast; more are joined with all chunks and their terms.
FEW = 1 << 19
#: Bytes of texts that one task makes blocks of.
TASK_BYTES = 32 << 20
#: Ranges of each query that are scored before the others are judged.
SEEDS = 4
VECTOR = "chunk_id string, document_id string, content_hash string, embedding array<float>, snippet string, user_id string"
BLOCK = "term string, rng long, user_id string, bucket int, best_tf long, least_dl int, least_dl_index int, rows array<struct<chunk_id:string,tf:long,dl:int,dl_index:int>>, places array<array<int>>"
CHUNK = "chunk_id string, document_id string, user_id string, rng long, dl int, dl_index int, terms array<string>"
TERM = "term string, df long, bucket int"
STALE = "chunk_id string, rng long, bucket int"


class VectorTable:
    """The vector index: one row for each child chunk, partitioned by tenant."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = LogTable(spark, path, VECTOR, ["chunk_id"], "user_id")

    def read(self, where: Column | None = None) -> DataFrame:
        return self.table.read(where)

    def insert(self, rows: DataFrame) -> None:
        """rows(chunk_id, user_id, document_id, content_hash, embedding, snippet); a chunk that is there already is replaced."""
        self.table.upsert(rows.withColumn("snippet", F.left(snippet(F.col("snippet")), F.lit(SNIPPET))))

    def search(self, queries: DataFrame, k: int = R.CANDIDATES) -> DataFrame:
        """query_id, chunk_id, score[, ...]; queries(query_id, user_id, qvec) see their own tenant's vectors."""
        rows = self.read().withColumnRenamed("chunk_id", "vec_id")
        return R.vector_search(queries, rows, k, tenant=True).withColumnRenamed("vec_id", "chunk_id").join(self.read().select("chunk_id", "document_id", "content_hash", "snippet"), "chunk_id")

    def delete_documents(self, gone: DataFrame) -> None:
        self.table.delete(self.read().join(gone.select("document_id"), "document_id", "left_semi").select("chunk_id"))

    def vectors(self, ids: DataFrame, dim: int) -> DataFrame:
        """chunk_id, embedding in every row of ids(chunk_id); zeros where there is none."""
        zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
        return ids.join(self.read().select("chunk_id", "embedding"), "chunk_id", "left").withColumn("embedding", F.coalesce("embedding", zero))

    def vector_of_hash(self, hashes: DataFrame) -> DataFrame:
        """content_hash, embedding of one chunk of each hash (the smallest id)."""
        return self.read().join(hashes, "content_hash", "left_semi").groupBy("content_hash").agg(F.min_by("embedding", "chunk_id").alias("embedding"))


def _range_blocks(chunks: pa.Table) -> pa.Table:
    """The blocks of one range's chunks (rng, user_id, chunk_id, w): for each word its postings, and places of words of two or more characters."""
    w, n = chunks["w"].combine_chunks(), chunks.num_rows
    dl = w.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
    words = w.flatten().dictionary_encode()
    code, doc = words.indices.to_numpy().astype(np.int64), np.repeat(np.arange(n), dl)
    long = pc.greater(pc.utf8_length(words.dictionary), 1).to_numpy(zero_copy_only=False)[code]
    seen = np.concatenate([[0], np.cumsum(long)])
    pos = seen[:-1] - seen[np.cumsum(dl) - dl][doc]
    dl_index = np.bincount(doc[long], minlength=n).astype(np.int32)
    order = np.argsort(code * n + doc, kind="stable")
    key = (code * n + doc)[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))  # a posting's first word
    term, of = np.divmod(key[first], n)
    tf = np.diff(first, append=len(key))
    begin = np.flatnonzero(np.diff(term, prepend=-1))  # a block's first posting
    ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    each = ends(np.diff(begin, append=len(term)))
    least = lambda x: np.minimum.reduceat(x[of], begin) if len(begin) else x[:0]
    rows = pa.StructArray.from_arrays([chunks["chunk_id"].combine_chunks().take(pa.array(of)), pa.array(tf, pa.int64()), pa.array(dl[of]), pa.array(dl_index[of])], ["chunk_id", "tf", "dl", "dl_index"])
    places = pa.ListArray.from_arrays(ends(np.where(long[order][first], tf, 0)), pa.array(pos[order][long[order]], pa.int32()))
    same = lambda name: chunks[name].combine_chunks().take(pa.array(np.zeros(len(begin), np.int64)))
    return pa.table({
        "term": words.dictionary.take(pa.array(term[begin])), "rng": same("rng"), "user_id": same("user_id"), "best_tf": pa.array(np.maximum.reduceat(tf, begin) if len(begin) else tf, pa.int64()),
        "least_dl": pa.array(least(dl)), "least_dl_index": pa.array(least(dl_index)), "rows": pa.ListArray.from_arrays(each, rows), "places": pa.ListArray.from_arrays(each, places),
    })


class TextTable:
    """The text index: blocks of postings with bounds, kept frequencies and lengths.

    A tenant's chunks are dealt to ranges of about ``RANGE_CHUNKS`` as they are inserted; a block is a term's postings in
    one range, with the largest tf and the least lengths, whose product bounds every score in it under any average. A
    range's texts meet in one group, so an insertion shuffles each text once and writes its blocks from there. Terms'
    frequencies and the corpus' sums are kept and changed with each insertion. A replaced or deleted chunk's postings
    stay in their blocks and are named in ``stale`` until ``rewrite``. One writer at a time; chunk ids are strings.
    """

    def __init__(self, spark: SparkSession, path: str, range_chunks: int = RANGE_CHUNKS, buckets: int = BUCKETS):
        self.spark, self.range_chunks, self.buckets = spark, range_chunks, buckets
        make = lambda name, schema, key, by, deal=True: LogTable(spark, f"{path.rstrip('/')}/{name}", schema, key, by, deal)
        self.blocks, self.chunks = make("blocks", BLOCK, ["term", "rng"], "bucket", False), make("chunks", CHUNK, ["chunk_id"], None)
        self.terms, self.stale = make("terms", TERM, ["term"], "bucket"), make("stale", STALE, ["chunk_id", "rng"], "bucket")

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int").alias("bucket")

    def total(self) -> dict:
        """n_docs, sum_all and sum_index (words of all chunks) and the number of insertions, kept with the chunks' version."""
        return {"n_docs": 0, "sum_all": 0, "sum_index": 0, "inserts": 0} | self.chunks.state().get("note", {})

    def _changed(self, added: DataFrame | None, gone: DataFrame | None) -> dict:
        """Brings terms' frequencies up to date with chunks that came and went (rows of ``chunks``); the new sums."""
        signed = [df.withColumn("by", F.lit(by)) for df, by in ((added, 1), (gone, -1)) if df is not None]
        both = reduce(DataFrame.unionByName, signed)
        by = both.select("by", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("by").alias("by"))
        self.terms.upsert(by.join(self.terms.read().drop("bucket"), "term", "left").select("term", (F.coalesce("df", F.lit(0)) + F.col("by")).alias("df"), self._bucket("term")))
        sums = both.agg(F.sum("by").alias("n_docs"), F.sum(F.col("dl") * F.col("by")).alias("sum_all"), F.sum(F.col("dl_index") * F.col("by")).alias("sum_index")).first().asDict()
        old = self.total()
        return {c: old[c] + (sums[c] or 0) for c in sums} | {"inserts": old["inserts"] + 1}

    def _forget(self, ids: DataFrame) -> DataFrame | None:
        """The postings of chunks ids(chunk_id) are stale; the chunks as they were, if there are any."""
        there = kept(self.chunks.read().select("chunk_id").join(ids, "chunk_id", "left_semi"), "there")
        n = there.count()
        if not n:
            return None
        gone = kept(self.chunks.read(some=[F.broadcast(there) if n <= FEW else there]), "gone")
        self.stale.upsert(gone.select("chunk_id", "rng", self._bucket("chunk_id")))
        return gone

    def _placed(self, named: DataFrame) -> tuple[DataFrame, int]:
        """The chunks with their range, and their bytes. A range is a share of one tenant's chunks."""
        sizes = named.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("content").cast("long")).alias("size"))
        sizes = kept(sizes.withColumn("shares", F.ceil(F.greatest(F.col("n") / self.range_chunks, F.col("size") / RANGE_BYTES))), "tenants")
        # tenants of one range need no row here, so there are at most as many rows as ranges
        large = kept(sizes.filter("shares > 1").select(F.col("user_id").alias("owner"), "shares"), "large")
        share = F.pmod(F.xxhash64("chunk_id"), F.coalesce("shares", F.lit(1)))
        rng = F.xxhash64("user_id", F.lit(self.total()["inserts"]), share)
        placed = named.join(large, F.col("user_id").eqNullSafe(F.col("owner")), "left").withColumn("rng", rng).drop("owner", "shares")
        return placed, sizes.agg(F.sum("size").alias("n")).first().n or 0

    def _named(self, chunks: DataFrame) -> DataFrame:
        ids = (F.col(c).cast("string").alias(c) for c in ("chunk_id", "document_id", "user_id"))
        return chunks.select(*ids, "content").filter("chunk_id is not null and content is not null")

    def insert(self, chunks: DataFrame) -> None:
        """chunks(chunk_id, document_id, user_id, content); a chunk that is there already is replaced."""
        placed, size = self._placed(self._named(chunks))
        tasks = max(-(-size // TASK_BYTES), min(self.spark.sparkContext.defaultParallelism, -(-size // RANGE_BYTES)), 1)
        w, long = F.col("w"), F.filter("w", lambda t: F.length(t) > 1)
        fresh = placed.withColumn("w", query_terms(F.col("content"))).select("chunk_id", "document_id", "user_id", "rng", F.size(w).alias("dl"), F.size(long).alias("dl_index"), F.array_distinct(w).alias("terms"))
        run, fresh = self.chunks.prepare(fresh)
        gone = self._forget(fresh.select("chunk_id")) if self.chunks.versions() else None
        # sorted as texts: words are made when their range's turn comes
        dealt = placed.repartition(tasks, "rng").sortWithinPartitions("rng").select("rng", "user_id", "chunk_id", query_terms(F.col("content")).alias("w"))
        blocks = dealt.groupBy("rng").applyInArrow(_range_blocks, ", ".join(x for x in BLOCK.split(", ") if x != "bucket int"))
        self.blocks.upsert(blocks.withColumn("bucket", self._bucket("term")))
        self.chunks.append(run, note=self._changed(fresh, gone))

    def backfill(self, chunks: DataFrame) -> None:
        """Chunks that the index lacks."""
        self.insert(kept(self._named(chunks).join(self.chunks.read().select("chunk_id"), "chunk_id", "left_anti"), "lacking"))

    def delete_documents(self, gone: DataFrame) -> None:
        documents = gone.select(F.col("document_id").cast("string").alias("document_id")).distinct()
        old = self._forget(self.chunks.read().select("chunk_id", "document_id").join(documents, "document_id", "left_semi").select("chunk_id"))
        if old is not None:
            self.chunks.delete(old.select("chunk_id"), note=self._changed(None, old))

    def rewrite(self) -> None:
        """Stale postings go from the blocks that hold them."""
        stale = self.stale.read().drop("bucket")
        hit = self.blocks.read(some=[stale.select("rng").distinct()])
        rows = hit.select("term", "rng", "user_id", "bucket", F.explode(F.arrays_zip("rows", "places")).alias("p")).select("term", "rng", "user_id", "bucket", "p.rows.*", "p.places").join(stale, ["chunk_id", "rng"], "left_anti")
        both = F.collect_list(F.struct(F.struct("chunk_id", "tf", "dl", "dl_index").alias("row"), "places")).alias("both")
        left = rows.groupBy("term", "rng", "user_id", "bucket").agg(F.max("tf").alias("best_tf"), F.min("dl").alias("least_dl"), F.min("dl_index").alias("least_dl_index"), both)
        left = left.withColumns({"rows": F.col("both.row"), "places": F.col("both.places")})
        now = kept(left.select(*self.blocks.columns), "blocks")
        empty = hit.select("term", "rng").join(now.select("term", "rng"), ["term", "rng"], "left_anti")
        self.blocks.delete(empty)
        self.blocks.upsert(now)
        self.stale.delete(stale)

    def postings(self) -> DataFrame:
        """All live postings: chunk_id, user_id, dl, dl_index, term, tf; a row with an empty term for every chunk."""
        each = self.blocks.read().select("term", "rng", "user_id", F.explode("rows").alias("p")).select("term", "rng", "user_id", "p.*").join(self.stale.read().select("chunk_id", "rng"), ["chunk_id", "rng"], "left_anti")
        marks = self.chunks.read().select("chunk_id", "user_id", "dl", "dl_index", F.lit("").alias("term"), F.lit(0).cast("long").alias("tf"))
        return each.select("chunk_id", "user_id", "dl", "dl_index", "term", "tf").unionByName(marks)

    def asked_blocks(self, queries: DataFrame, tenant: bool) -> DataFrame:
        """The blocks of the queries' terms (not their postings), with what scoring needs: need, qtf, df and the corpus' sums."""
        asked = R.asked_terms(queries if tenant else queries.drop("user_id"))
        where, total, words = self._where(asked), self.total(), self._words(asked)
        n = max(1, total["n_docs"])
        heads = self.blocks.read(where, some=[words]).drop("rows", "places", *([] if tenant else ["user_id"]))
        known = asked.join(self.terms.read(where, some=[words]).select("term", "df"), "term")
        stats = {"n_docs": F.lit(total["n_docs"]), "avg_all": F.lit(total["sum_all"] / n), "avg_index": F.lit(total["sum_index"] / n)}
        return heads.join(known, ["term", *(["user_id"] if tenant else [])]).withColumns(stats)

    def _words(self, asked: DataFrame) -> DataFrame:
        """These terms as a table of their own, whose size Spark knows: few are broadcast, and no other block is shuffled."""
        return kept(asked.select("term").distinct(), "words")

    def _where(self, asked: DataFrame) -> Column | None:
        """The folders of these terms, where there are many."""
        if self.buckets <= 2 * BUCKETS:
            return None
        return F.col("bucket").isin([r.bucket for r in asked.select(self._bucket("term")).distinct().collect()])

    def score_bounds(self, blocks: DataFrame) -> DataFrame:
        """query_id, rng, bound, n_blocks: no chunk of the range scores more; ranges without enough of the words are left out."""
        top = blocks.withColumn("tf", F.col("best_tf"))
        sure = F.when(F.length("term") > 1, R.bm25_part(F.col("least_dl_index"), F.col("avg_index"))).otherwise(0.0) + R.bm25_part(F.col("least_dl"), F.col("avg_all"))
        summed = top.groupBy("query_id", "rng").agg(F.sum(sure).alias("bound"), F.sum("qtf").alias("m"), F.max("need").alias("need"), F.count(F.lit(1)).alias("n_blocks"))
        return summed.filter("m >= need").select("query_id", "rng", "bound", "n_blocks")

    def _scored(self, some: DataFrame, blocks: DataFrame, digits: int | None) -> DataFrame:
        """Exact scores of the chunks in the query's ranges some(query_id, rng)."""
        own = kept(blocks.join(some.select("query_id", "rng"), ["query_id", "rng"]).drop("user_id", "best_tf", "least_dl", "least_dl_index"), "own")
        # by their terms first: these are few, whatever the number of ranges
        read = self.blocks.read(self._where(own), some=[self._words(own), kept(own.select("term", "rng").distinct(), "pairs")])
        rows = own.join(read.select("term", "rng", "rows"), ["term", "rng"]).withColumn("p", F.explode("rows")).select("*", "p.*").drop("rows", "p")
        return R.bm25_sums(rows.join(self.stale.read().select("chunk_id", "rng"), ["chunk_id", "rng"], "left_anti"), digits=digits)

    def ranges(self, queries: DataFrame, k: int, tenant: bool, digits: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(the first ranges' scores, the other ranges that can reach the k best, the queries' blocks)."""
        blocks = kept(self.asked_blocks(queries, tenant), "heads")
        bounds = self.score_bounds(blocks)
        first = R.top_k(bounds, SEEDS, "query_id", [F.desc("bound"), F.asc("rng")])
        seen = kept(self._scored(first, blocks, digits), "seen")
        kth = R.top_k(seen, k, "query_id", [F.desc("score"), F.asc("chunk_id")]).groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
        least = F.when(F.col("n") >= k, F.col("least")).otherwise(0.0)
        slack = 1e-6 if digits is None else 10.0**-digits  # sums in another order, and rounding
        rest = bounds.join(first.select("query_id", "rng"), ["query_id", "rng"], "left_anti").join(kth, "query_id", "left").filter(F.col("bound") + slack >= F.coalesce(least, F.lit(0.0)))
        return seen, rest, blocks

    def search(self, queries: DataFrame, k: int = R.CANDIDATES, tenant: bool = True, digits: int | None = None) -> DataFrame:
        """query_id, chunk_id, score: the same as ``retrieval.bm25`` over all live postings."""
        seen, rest, blocks = self.ranges(queries, k, tenant, digits)
        return R.top_k(seen.unionByName(self._scored(rest, blocks, digits)), k, "query_id", [F.desc("score"), F.asc("chunk_id")])

    def cover_search(self, queries: DataFrame, k: int = R.CANDIDATES, tenant: bool = True, digits: int | None = None) -> DataFrame:
        """query_id, chunk_id, score: the same as ``retrieval.cover_rank``, from the stored places.

        Only ranges that hold all of a query's words are read."""
        asked = R.asked_places(queries, tenant)
        own = ["user_id"] * tenant
        words = self._words(asked)
        heads = self.blocks.read(self._where(asked), some=[words]).select("term", "rng", *own).join(asked, ["term", *own])
        full = heads.groupBy("query_id", "rng", "need").agg(F.count(F.lit(1)).alias("met")).filter("met = need").select("query_id", "rng")
        placed = F.explode(F.arrays_zip("rows.chunk_id", "places")).alias("p")
        blocks = self.blocks.read(self._where(asked), some=[words]).select("term", "rng", "rows", "places").join(heads.select("query_id", "rng", "term", "need", "name"), ["term", "rng"]).join(full, ["query_id", "rng"])
        rows = blocks.select("query_id", "rng", "need", "name", placed).select("query_id", "rng", "need", "name", "p.chunk_id", F.explode("p.places").alias("pos"))
        return R.covered(rows.join(self.stale.read().select("chunk_id", "rng"), ["chunk_id", "rng"], "left_anti"), k, digits)

    def blocks_read(self, queries: DataFrame, k: int = R.CANDIDATES, tenant: bool = True) -> tuple[int, int]:
        """How many blocks a search reads, and how many its queries' terms have."""
        _, rest, blocks = self.ranges(queries, k, tenant, None)
        bounds = self.score_bounds(blocks)
        first = R.top_k(bounds, SEEDS, "query_id", [F.desc("bound"), F.asc("rng")])
        count = lambda df: df.agg(F.sum("n_blocks").alias("n")).first().n or 0
        return count(first) + count(rest), blocks.count()

    def expire(self, versions: int = 1, seconds: float = 0.0) -> None:
        for table in (self.blocks, self.chunks, self.terms, self.stale):
            table.expire(versions, seconds)
