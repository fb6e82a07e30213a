"""Hybrid retrieval for a table of queries: vector and text search, fusion, hydration, reranking, context packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions import queries as Q
from ragloom.functions.text import index_terms, least_matches, query_terms
from ragloom.operators.clients import Embedder, Reranker, embed, first_of
from ragloom.session import kept

#: Queries that one pass over the vectors may hold; larger sets go in blocks of this size.
QUERY_BLOCK = 4096
RRF_K = 60
K1, B = 1.2, 0.75
CANDIDATES, KEPT = 40, 10
CONTEXT_CHARS = 8000


def _unit(rows) -> np.ndarray:
    v = np.stack(rows).astype(float)
    return v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-8)


#: Products of queries and vectors that a task makes at a time, and hits that it gathers before it cuts them.
PRODUCTS, GATHERED = 1 << 20, 1 << 18


class _Best:
    """The k best vectors of each query that a task has seen, ties by id; memory is bounded whatever the task reads."""

    def __init__(self, mat: np.ndarray, k: int):
        self.mat, self.k, self.least = mat, k, np.full(len(mat), -np.inf)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def see(self, q: np.ndarray, vectors: np.ndarray, vid: np.ndarray) -> None:
        """Queries ``q`` against these vectors."""
        step = max(64, PRODUCTS // max(1, len(q)))
        for at in range(0, len(vectors), step):
            sims = self.mat[q] @ vectors[at : at + step].T
            least = self.least[q]
            if sims.shape[1] > self.k:  # of one slice the k best and what ties with the last of them
                least = np.fmax(least, np.partition(sims, sims.shape[1] - self.k, axis=1)[:, sims.shape[1] - self.k])
            row, col = np.nonzero(np.isfinite(sims) & (sims >= least[:, None]))
            self.parts.append((q[row], vid[at : at + step][col], sims[row, col]))
            self.n += len(row)
            if self.n > max(GATHERED, 2 * self.k * len(self.mat)):
                self._cut()

    def _cut(self) -> None:
        q, vid, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = pd.DataFrame({"q": q, "score": -score, "vid": vid}).sort_values(["q", "score", "vid"]).index.to_numpy()
        q = q[order]
        begin = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        place = np.arange(len(q)) - np.repeat(begin, np.diff(begin, append=len(q)))
        order, last = order[place < self.k], order[place == self.k - 1]
        self.least[q[place == self.k - 1]] = score[last]
        q = q[place < self.k]
        self.parts, self.n = [(q, vid[order], score[order])], len(order)

    def hits(self, ids: np.ndarray) -> Iterator[pd.DataFrame]:
        if self.n:
            self._cut()
            q, vid, score = self.parts[0]
            for at in range(0, len(q), GATHERED):
                yield pd.DataFrame({"query_id": ids[q[at : at + GATHERED]], "vec_id": vid[at : at + GATHERED], "score": score[at : at + GATHERED]})


def _in_blocks(queries: DataFrame, schema: str, search) -> DataFrame:
    """The union of ``search`` over blocks of queries, which reach the driver a block at a time."""
    out, block = queries.sparkSession.createDataFrame([], schema), []
    for row in queries.orderBy("query_id").toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            out, block = out.unionByName(search(block)), []
    return out.unionByName(search(block)) if block else out


#: Tenants of a block of queries that are pushed to the scan as a list.
FEW_TENANTS = 1000


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = CANDIDATES, tenant: bool = False) -> DataFrame:
    """query_id, vec_id, score: exact cosine top-k; queries(query_id, qvec[, user_id]), vectors(vec_id, embedding[, user_id]).

    A block of queries is one matrix that every task multiplies its batches with, a slice at a time, keeping its own best k
    per query; only those meet in the final ranking. With ``tenant`` a query sees vectors of its own user_id only: a block's tenants are
    pushed to the scan (a table partitioned by tenant reads their folders alone), and a task multiplies each tenant's
    vectors with that tenant's queries, so work is in proportion to pairs of one tenant. A null tenant sees nothing.
    """
    own = ["user_id"] * tenant
    schema = f"query_id {dict(queries.dtypes)['query_id']}, vec_id {dict(vectors.dtypes)['vec_id']}, score double"

    def search(block: list) -> DataFrame:
        ids, mat = np.array([r.query_id for r in block]), _unit([r.qvec for r in block])
        of: dict[object, list[int]] = {}
        for i, r in enumerate(block if tenant else ()):
            of.setdefault(r.user_id, []).append(i)

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen = _Best(mat, k)
            for pdf in batches:
                for name, rows in pdf.groupby("user_id") if tenant else [(None, pdf)]:
                    q = np.array(of.get(name, []), np.int64) if tenant else np.arange(len(ids))
                    if len(rows) and len(q):
                        seen.see(q, _unit(rows["embedding"].to_numpy()), rows["vec_id"].to_numpy())
            yield from seen.hits(ids)

        some = vectors.filter(F.col("embedding").isNotNull())
        if tenant:
            names = [u for u in of if u is not None]
            some = some.filter(F.col("user_id").isin(names) if len(names) <= FEW_TENANTS else F.col("user_id").isNotNull())
        return some.select("vec_id", "embedding", *own).mapInPandas(best, schema)

    hits = _in_blocks(queries.select("query_id", "qvec", *own), schema, search)
    return top_k(hits, k, "query_id", [F.desc("score"), F.asc("vec_id")])


def top_k(hits: DataFrame, k: int, key: str, order: list[Column]) -> DataFrame:
    """The first k rows of each key; Spark cuts per partition before it shuffles."""
    return hits.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_rank") <= k).drop("_rank")


def _each_word(chunks: DataFrame, text: str) -> DataFrame:
    """chunk_id, user_id, dl, dl_index, term of every word, and one row with an empty term for every chunk."""
    words = chunks.select("chunk_id", "user_id", query_terms(F.col(text)).alias("w"))
    sized = words.select("chunk_id", "user_id", "w", F.size("w").alias("dl"), F.size(F.filter("w", lambda t: F.length(t) > 1)).alias("dl_index"))
    return sized.select("chunk_id", "user_id", "dl", "dl_index", F.explode(F.array_append("w", F.lit(""))).alias("term"))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.repartition("chunk_id").groupBy("chunk_id", "user_id", "dl", "dl_index", "term").agg(F.count(F.lit(1)).alias("tf"))


def postings(chunks: DataFrame, text: str = "content") -> DataFrame:
    """chunk_id, user_id, term, tf, dl (words of the chunk), dl_index (those of two or more characters); a row with an
    empty term for every chunk. Rows lie partitioned by chunk, as scoring wants them."""
    return _counted(_each_word(chunks, text))


def asked_terms(queries: DataFrame) -> DataFrame:
    """query_id[, user_id], need, term, qtf: a query's words; each occurrence is a clause of its own."""
    own = [c for c in ("user_id",) if c in queries.columns]
    words = queries.select("query_id", *own, query_terms(F.col("text")).alias("w")).withColumn("need", least_matches(F.size("w")))
    return words.select("query_id", *own, "need", F.explode("w").alias("term")).groupBy("query_id", *own, "need", "term").agg(F.count(F.lit(1)).alias("qtf"))


def matching_postings(chunks: DataFrame, asked: DataFrame, text: str = "content") -> DataFrame:
    """``postings`` of the asked terms alone: a chunk's words are counted in its row and others go before anything is
    shuffled; the rows with an empty term are not shuffled at all."""
    wanted = asked.select("term").filter("term <> ''").distinct()
    words = chunks.select("chunk_id", "user_id", query_terms(F.col(text)).alias("w")).filter("w is not null")
    sized = words.select("chunk_id", "user_id", F.array_sort("w").alias("w"), F.size("w").alias("dl"), F.size(F.filter("w", lambda t: F.length(t) > 1)).alias("dl_index"))
    marks = sized.select("chunk_id", "user_id", F.lit("").alias("term"), F.lit(1).cast("long").alias("tf"), "dl", "dl_index")
    each = sized.select("chunk_id", "user_id", "dl", "dl_index", F.explode(_runs(F.col("w"))).alias("p")).select("chunk_id", "user_id", "dl", "dl_index", "p.term", "p.tf")
    rows = each.join(wanted, "term", "left_semi").repartition("chunk_id").groupBy("chunk_id", "user_id", "dl", "dl_index", "term").agg(F.sum("tf").alias("tf"))
    return rows.select(*marks.columns).filter("term <> ''").unionByName(marks)


def _runs(words: Column) -> Column:
    """array of struct(term, tf) of sorted words."""
    n = F.size(words)
    first = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(words, i - 1) != F.get(words, i - 2)))
    first = F.when(n > 0, first).otherwise(F.array().cast("array<int>"))
    ends = F.concat(F.slice(first, F.lit(2), F.greatest(n, F.lit(1))), F.array(n + 1))
    return F.zip_with(first, ends, lambda a, b: F.struct(F.get(words, a - 1).alias("term"), (b - a).cast("long").alias("tf")))


def bm25(queries: DataFrame, posting: DataFrame, k: int | None = CANDIDATES, least: float | None = 1.0, tenant: bool = True, digits: int | None = None) -> DataFrame:
    """query_id, chunk_id, score: two BM25 clauses, over the words of two or more characters and over all words.

    Each counts if it matches the least number of the query's words (``least_matches``); a hit needs one of them.
    Statistics are those of the whole index, as one index serves all tenants. The tenant term scores nothing.
    ``digits`` rounds scores before they are ranked. queries(query_id, text[, user_id]).
    """
    asked = asked_terms(queries if tenant else queries.drop("user_id"))
    marks, rows = posting.filter("term = ''"), posting.filter("term <> ''")
    stats = marks.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_all"), F.avg("dl_index").alias("avg_index"))
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    hits = (rows if tenant else rows.drop("user_id")).join(asked.join(df, "term"), ["term", *(["user_id"] if tenant else [])]).join(F.broadcast(stats))
    scored = bm25_sums(hits, least, digits)
    return scored if k is None else top_k(scored, k, "query_id", [F.desc("score"), F.asc("chunk_id")])


def bm25_part(dl: Column, avg: Column) -> Column:
    """What a posting (qtf, tf, df, n_docs) adds to its chunk's score."""
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return F.col("qtf") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * dl / avg))


def bm25_sums(hits: DataFrame, least: float | None = 1.0, digits: int | None = None) -> DataFrame:
    """query_id, chunk_id, score of hits(query_id, chunk_id, need, term, qtf, tf, dl, dl_index, df, n_docs, avg_all, avg_index)."""
    long = F.length("term") > 1
    in_index, in_all = bm25_part(F.col("dl_index"), F.col("avg_index")), bm25_part(F.col("dl"), F.col("avg_all"))
    scored = hits.groupBy("query_id", "chunk_id", "need").agg(
        F.sum(F.when(long, in_index)).alias("s_index"), F.sum(F.when(long, F.col("qtf"))).alias("m_index"), F.sum(in_all).alias("s_all"), F.sum("qtf").alias("m_all"),
    )
    clause = lambda s, m: F.when(F.col(m) >= F.col("need"), F.col(s))
    index, every = clause("s_index", "m_index"), clause("s_all", "m_all")
    scored = scored.filter(index.isNotNull() | every.isNotNull()).select("query_id", "chunk_id", (F.coalesce(index, F.lit(0.0)) + F.coalesce(every, F.lit(0.0))).alias("score"))
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    return scored if least is None else scored.filter(F.col("score") >= least)


def cover_density(at: Column, need: Column) -> Column:
    """Sum over the minimal covers of 0.1 / (1 + positions in the cover that hold no query term).

    ``at`` (ascending structs of pos and name) are the places of query terms in a chunk and which of the query's terms
    each is, from 0; a fold keeps each term's last place: a cover ends where the earliest of these moves on.
    """
    start = F.struct(F.lit(0.0).alias("total"), F.lit(-1).alias("before"), F.lit(0).alias("i"), F.array_repeat(F.lit(-1), need).alias("last"))

    def step(a: Column, x: Column) -> Column:
        moved = F.transform(a["last"], lambda v, j: F.when(j == x["name"], a["i"]).otherwise(v))

        def cover(last: Column) -> Column:
            begin = F.array_min(last)
            new = begin > a["before"]
            gain = 0.1 / (1 + (x["pos"] - F.get(at, begin)["pos"]) - (a["i"] - begin))
            return F.struct((a["total"] + F.when(new, gain).otherwise(0.0)).alias("total"), F.when(new, begin).otherwise(a["before"]).alias("before"), (a["i"] + 1).alias("i"), last.alias("last"))

        return F.transform(F.array(moved), cover)[0]  # the moved places are made once

    return F.aggregate(at, start, step, lambda a: a["total"])


def asked_places(queries: DataFrame, tenant: bool) -> DataFrame:
    """query_id[, user_id], need, name, term: the distinct words of each query, numbered."""
    own = ["user_id"] * tenant
    words = queries.select("query_id", *own, F.array_distinct(query_terms(F.col("text"))).alias("w"))
    return words.select("query_id", *own, F.size("w").alias("need"), F.posexplode("w").alias("name", "term"))


def covered(met: DataFrame, k: int | None, digits: int | None) -> DataFrame:
    """query_id, chunk_id, score of met(query_id, chunk_id, need, name, pos): chunks with all of a query's words."""
    rows = met.groupBy("query_id", "chunk_id", "need").agg(F.countDistinct("name").alias("met"), F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("at"))
    full = rows.filter("met = need").select("query_id", "chunk_id", cover_density(F.col("at"), F.col("need")).alias("score"))
    if digits is not None:
        full = full.withColumn("score", F.round("score", digits))
    return full if k is None else top_k(full, k, "query_id", [F.desc("score"), F.asc("chunk_id")])


def cover_rank(queries: DataFrame, chunks: DataFrame, k: int | None = CANDIDATES, digits: int | None = None, tenant: bool = True) -> DataFrame:
    """Fallback text search: every word of the query must occur in the chunk's index words; rank by cover density.

    Only the places of asked words leave the scan; a chunk's meet in one row. queries(query_id[, user_id], text).
    """
    placed = chunks.select("chunk_id", *["user_id"] * tenant, F.posexplode(index_terms(F.col("content"))).alias("pos", "term"))
    return covered(placed.join(asked_places(queries, tenant), ["term", *["user_id"] * tenant]), k, digits)


def ranked(hits: DataFrame, tie: str = "chunk_id") -> DataFrame:
    """Adds rank0, the place in each query's list from 0."""
    return hits.withColumn("rank0", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(tie))) - 1)


def contributions(vector: DataFrame, text: DataFrame) -> DataFrame:
    """query_id, chunk_id, engine, rank0, norm: each list's places, and scores by its best one.

    A best score of 0 counts as 1, a missing score as 1.
    """
    sides = []
    for engine, hits in (("v", vector), ("t", text)):
        best = F.max("score").over(Window.partitionBy("query_id"))
        norm = F.coalesce(F.col("score"), F.lit(1.0)) / F.when(best.isNull() | (best == 0), 1.0).otherwise(best)
        sides.append(ranked(hits).select("query_id", "chunk_id", F.lit(engine).alias("engine"), "rank0", norm.alias("norm")))
    return sides[0].unionByName(sides[1])


def fused_order() -> list[Column]:
    """Best first; ties in the vector list's order, then in the text list's."""
    return [F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("text_rank"), F.asc("chunk_id")]


def fuse(vector: DataFrame, text: DataFrame, weights: DataFrame | tuple[float, float] = (0.7, 0.3), k: int = RRF_K, keep: int | None = CANDIDATES) -> DataFrame:
    """Weighted reciprocal-rank fusion of two hit lists (query_id, chunk_id, score) into one, best first.

    Each list adds weight * score / best score / (k + rank + 1).
    """
    both = contributions(vector, text)
    if isinstance(weights, tuple):
        both = both.withColumn("w", F.when(F.col("engine") == "v", F.lit(weights[0])).otherwise(F.lit(weights[1])))
    else:
        both = both.join(weights.select("query_id", "vector_weight", "text_weight"), "query_id").withColumn("w", F.when(F.col("engine") == "v", F.col("vector_weight")).otherwise(F.col("text_weight")))
    place = lambda e: F.min(F.when(F.col("engine") == e, F.col("rank0")))
    fused = both.groupBy("query_id", "chunk_id").agg(F.sum(F.col("w") * F.col("norm") / (k + F.col("rank0") + 1)).alias("score"), place("v").alias("vector_rank"), place("t").alias("text_rank"))
    return top_k(fused, keep, "query_id", fused_order()) if keep else fused


def failover_weights(weights: DataFrame, fallback_hits: DataFrame) -> DataFrame:
    """Weights where the fallback engine answered: a query with hits halves its text weight, the vector gets the rest."""
    met = fallback_hits.select("query_id").distinct().withColumn("met", F.lit(True))
    text = F.when(F.col("met"), F.col("text_weight") * 0.5).otherwise(F.col("text_weight"))
    rows = weights.join(met, "query_id", "left").withColumn("text_weight", text)
    return rows.withColumn("vector_weight", F.when(F.col("met"), 1 - F.col("text_weight")).otherwise(F.col("vector_weight"))).drop("met")


def hydrate(hits: DataFrame, chunks: DataFrame, pool: DataFrame) -> DataFrame:
    """Adds document_id, content, page_number and parent_content; hits of missing or foreign chunks are dropped.

    hits(query_id, user_id, chunk_id, score, ...); only the candidates' chunks are joined, content last.
    """
    own = kept(hits.join(chunks.select("chunk_id", "user_id", "document_id", "content_hash", "page_number", "parent_chunk_id"), ["chunk_id", "user_id"]), "found")
    parents = chunks.select(F.col("chunk_id").alias("parent_chunk_id"), "user_id", F.col("content_hash").alias("parent_hash"))
    both = kept(own.join(parents.join(own.select("parent_chunk_id", "user_id").distinct(), ["parent_chunk_id", "user_id"], "left_semi"), ["parent_chunk_id", "user_id"], "left"), "parents")
    # the candidates' texts alone: other texts are not shuffled
    asked = kept(both.select("content_hash").union(both.select("parent_hash")).filter("content_hash is not null").distinct(), "hashes")
    texts = kept(pool.join(asked, "content_hash", "left_semi").select("content_hash", "content"), "texts")
    child = both.join(texts, "content_hash")
    return child.join(texts.select(F.col("content_hash").alias("parent_hash"), F.col("content").alias("parent_content")), "parent_hash", "left").select(*hits.columns, "document_id", "content", "page_number", "parent_content")


def rerank_local(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, keep: int | None = KEPT) -> DataFrame:
    """Scores by cosine with the stored vector; without one the old score stays (rerank_source tells which)."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    both = candidates.join(queries.select("query_id", "qvec"), "query_id").join(vectors.select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left")
    norm = F.sqrt(dot(F.col("qvec"), F.col("qvec"))) * F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    cosine = dot(F.col("qvec"), F.col("embedding")) / norm
    known = F.coalesce(norm > 0, F.lit(False))
    out = both.withColumn("rerank_source", F.when(known, "vector").otherwise("fusion")).withColumn("score", F.when(known, cosine).otherwise(F.col("score"))).drop("qvec", "embedding")
    return out if keep is None else top_k(out, keep, "query_id", [F.desc("score"), F.asc("chunk_id")])


def rerank(candidates: DataFrame, queries: DataFrame, vectors: DataFrame, client: Reranker | None = None, keep: int = KEPT) -> DataFrame:
    """The best ``keep`` candidates by a reranking client, else by ``rerank_local``; a lone candidate keeps its score.

    candidates(query_id, chunk_id, score, content), at most ``CANDIDATES`` a query; queries(query_id, text, qvec).
    """
    counted = candidates.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    lone = counted.filter("_n = 1").drop("_n").withColumn("rerank_source", F.lit("fusion"))
    many = counted.filter("_n > 1").drop("_n")
    if client is None:
        out = rerank_local(many, queries, vectors, None)
    else:
        kind = dict(candidates.dtypes)

        def asked(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("chunk_id")
            got = first_of(lambda: client.rerank(rows["text"].iloc[0], rows["content"].tolist()))
            return pd.DataFrame({"query_id": rows["query_id"], "chunk_id": rows["chunk_id"], "client_score": pd.Series([None] * len(rows) if got is None else [float(x) for x in got], index=rows.index, dtype=float)})

        scores = many.select("query_id", "chunk_id", "content").join(queries.select("query_id", "text"), "query_id").groupBy("query_id").applyInPandas(asked, f"query_id {kind['query_id']}, chunk_id {kind['chunk_id']}, client_score double")
        local = rerank_local(many, queries, vectors, None).join(scores, ["query_id", "chunk_id"])
        known = F.col("client_score").isNotNull() & ~F.isnan("client_score")
        out = local.withColumn("rerank_source", F.when(known, "client").otherwise(F.col("rerank_source"))).withColumn("score", F.when(known, F.col("client_score")).otherwise(F.col("score"))).drop("client_score")
    return top_k(out.unionByName(lone), keep, "query_id", [F.desc("score"), F.asc("chunk_id")])


def single_search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, posting: DataFrame | None = None, k: int = CANDIDATES, text_engine: bool = True, digits: int | None = None) -> DataFrame:
    """Fused hits of each query, all of them; queries(query_id, user_id, text, qvec, vector_weight, text_weight).

    ``posting`` is a stored index (``postings``); without one the asked words' are read from chunks(chunk_id, user_id,
    content). Where the text engine is down (``text_engine`` false), the fallback engine answers, with its own weights.
    """
    v = vector_search(queries, vectors, k, tenant=True).select("query_id", F.col("vec_id").alias("chunk_id"), F.col("score") if digits is None else F.round("score", digits).alias("score"))
    weights = queries.select("query_id", "vector_weight", "text_weight")
    if text_engine:
        t = bm25(queries, matching_postings(chunks, asked_terms(queries)) if posting is None else posting, k, digits=digits)
    else:
        t = cover_rank(queries, chunks, k, digits)
        weights = failover_weights(weights, t)
    return fuse(v, t, weights, keep=None)


def search(queries: DataFrame, chunks: DataFrame, pool: DataFrame, vectors: DataFrame, chain: dict[str, Embedder] | None = None, dim: int = 64, posting: DataFrame | None = None, client: Reranker | None = None, k: int = CANDIDATES, candidates: int = CANDIDATES, keep: int = KEPT, weights: tuple[float, float] | None = None, text_engine: bool = True, digits: int | None = None) -> DataFrame:
    """query_id, user_id, chunk_id, document_id, score, content, page_number, parent_content, rerank_source: the whole path.

    queries(query_id, user_id, text[, history][, qvec][, collection_id]); chunks(chunk_id, user_id, document_id,
    content_hash, page_number, parent_chunk_id, content[, collection_id]). Queries are analysed and decomposed; every
    sub-query is embedded (a given qvec stands for the rewritten query itself) and searched in its tenant, scores of
    sub-queries are summed, hits hydrated, cut to ``candidates`` and reranked. With ``weights`` (vector, text) the
    caller's weights hold and there is neither history nor decomposition. A collection_id narrows the chunks.
    """
    history = F.col("history") if "history" in queries.columns and weights is None else None
    # the analysis is a large expression over few rows: stored, so that later plans do not repeat it and know their size
    a = kept(queries.withColumn("a", Q.analyse(F.col("text"), history)), "analysis")
    subs = F.array(F.col("a.rewritten")) if weights is not None else F.col("a.sub_queries")
    pair = (F.col("a.vector_weight"), F.col("a.text_weight")) if weights is None else tuple(F.lit(float(w)) for w in weights)
    given = ["qvec"] if "qvec" in queries.columns else []
    base = a.select("query_id", "user_id", *given, F.col("a.rewritten").alias("rewritten"), pair[0].alias("vector_weight"), pair[1].alias("text_weight"), F.posexplode(subs).alias("part", "sub"))
    vector = embed(base.select("sub").union(base.select("rewritten")).distinct(), chain or {}, dim, column="sub").select("sub", F.col("embedding").alias("made"))
    base = base.join(vector, "sub", "left")
    own = F.when(F.col("sub") == F.col("rewritten"), F.col("qvec")) if given else F.lit(None).cast("array<float>")
    single = base.select(F.struct("query_id", "part").alias("key"), "user_id", F.col("sub").alias("text"), F.coalesce(own, F.col("made")).alias("qvec"), "vector_weight", "text_weight")
    # one id per sub-query for the engines, which all read these few rows
    single = kept(single.withColumn("query_id", F.concat_ws(":", F.col("key.query_id").cast("string"), F.col("key.part").cast("string"))), "sub-queries")
    fused = single_search(single.drop("key"), chunks.select("chunk_id", "user_id", "content"), vectors, posting, k, text_engine, digits)
    narrow = ["collection_id"] if "collection_id" in queries.columns else []
    names = single.select("query_id", F.col("key.query_id").alias("whole"), "user_id")
    summed = fused.join(names, "query_id").groupBy("whole", "user_id", "chunk_id").agg(F.sum("score").alias("score"), F.min("vector_rank").alias("vector_rank"), F.min("text_rank").alias("text_rank")).withColumnRenamed("whole", "query_id")
    if narrow:
        inside = chunks.select("chunk_id", F.col("collection_id").alias("_c"))
        summed = summed.join(queries.select("query_id", "collection_id"), "query_id").join(inside, "chunk_id").filter(F.col("collection_id").isNull() | (F.col("collection_id") == F.col("_c"))).drop("_c", "collection_id")
    summed = kept(summed, "candidates")  # at most 2 * k for each sub-query: Spark broadcasts them as far as they are small
    best = top_k(hydrate(summed, chunks, pool), candidates, "query_id", fused_order()).drop("vector_rank", "text_rank")
    rewritten = a.select("query_id", *given, F.col("a.rewritten").alias("sub")).join(vector, "sub", "left")
    asked = rewritten.select("query_id", F.col("sub").alias("text"), (F.coalesce(F.col("qvec"), F.col("made")) if given else F.col("made")).alias("qvec"))
    return rerank(best, asked, vectors, client, keep)


def pack_context(results: DataFrame, budget: int = CONTEXT_CHARS) -> DataFrame:
    """query_id, context, n_used: ``[i] text`` blocks, best first, while the texts' summed length stays in the budget."""
    text = F.coalesce(F.nullif("parent_content", F.lit("")), "content")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    rows = results.withColumn("_text", text).withColumn("_i", F.row_number().over(order)).withColumn("_sum", F.sum(F.length("_text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    used = rows.filter(F.col("_sum") <= budget).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("_i", "_text"))).alias("x"))
    return used.select("query_id", F.array_join(F.transform("x", lambda s: F.concat(F.lit("["), s["_i"].cast("string"), F.lit("] "), s["_text"])), "\n\n").alias("context"), F.size("x").alias("n_used"))


def citations(results: DataFrame) -> DataFrame:
    return results.select("query_id", "chunk_id", "score", F.left(F.col("content"), F.lit(200)).alias("snippet"))


def lost_data(queries: DataFrame, results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Queries without results although their tenant has chunks."""
    return queries.join(results.select("query_id").distinct(), "query_id", "left_anti").join(chunks.select("user_id").distinct(), "user_id", "left_semi").select("query_id", "user_id")
