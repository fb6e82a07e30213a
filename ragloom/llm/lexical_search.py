"""Ranked lexical search with variable block-max WAND over a sharded index.

1. Every task cuts its documents into shards of about ``SHARD_BYTES`` of text and writes, for each, its documents'
   lengths and its postings (term, document, occurrences) as a table in the shared folder. Texts are read once and never
   shuffled.
2. With the corpus' numbers of documents and words, each posting's impact (its score for a weight of one) is known. A
   dynamic programme over each posting list chooses the block borders that minimise the bound error, the sum over
   postings of their block's largest impact less their own, plus ``BLOCK_COST`` for each block; no block is longer than
   ``LONGEST`` postings. Blocks and their maxima are written beside the postings: that table is the index.
3. A search goes through the shards. For a query the maxima of the blocks that cover a document, times their terms'
   weights, sum to a bound of its score (a block of far apart documents covers those of its postings, another all between
   its first and last); a document is a pivot only if that bound reaches the least score that the query's best ``k``
   documents have so far. The pivots with the highest bounds are scored first, which raises that score; blocks
   without a pivot are skipped, their postings are not read. The best ``k`` are carried from shard to shard of a task, and
   tasks' lists meet in one last ranking. Nothing but documents that cannot reach the list is left out, so it is exact.

Queries reach the tasks in blocks of at most ``QUERY_TERMS`` terms (a longer query is a block of its own); document
frequencies of a block's terms are summed from the shards. Terms are 64-bit hashes (``words``): those of up to eight bytes
share no hash with others of their length, longer ones only by chance.

Defined cases: null text and null items have no terms; items without terms, or none that occurs, have no rows; repeated
rows are ranked each, repeated items share one id's ranking only if their texts are equal (else each is asked, and the best
``k`` of all are ranked); a null doc_id is the smallest in ties; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, enter, stored
from .sketches import pack, pack_planes, unpack, unpack_planes
from .words import Words, slices, text_bytes

#: Bytes of text in a shard, about.
SHARD_BYTES = 12 << 20
#: Longest block in postings, and what a block costs in units of one posting's bound error (impacts are below 1,000,000).
LONGEST = 64
BLOCK_COST = 500_000
#: Terms of the queries that go to the tasks together.
QUERY_TERMS = 1 << 16
#: Pivots scored in the first round.
FIRST = 32
#: A block over fewer documents than this many for each posting bounds all of them, another only those of its postings.
DENSE = 4
TOP = 10
RAW = "shard long, n_docs long, n_words long, ids binary, lengths binary, terms binary, sizes binary, docs binary, counts binary"
INDEX = RAW + ", n_blocks binary, lens binary, maxima binary"
_NONE = -(2**63)

#: What ends a term: ASCII other than letters and digits.
BREAKS = np.zeros(256, bool)
BREAKS[:128] = True
BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def gather(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first .. first + size - 1 of all these runs."""
    ends = np.cumsum(sizes)
    return np.repeat(first - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


# --- building ---


class _Parts:
    """Documents of a shard that is not full yet."""

    def __init__(self) -> None:
        self.ids, self.lengths, self.keys, self.bytes, self.docs = [], [], [], 0, 0

    def add(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        words = Words(data, offsets, lower=True, breaks=BREAKS)
        self.ids.append(ids)
        self.lengths.append(words.counts)
        self.keys.append((words.hash, np.repeat(np.arange(self.docs, self.docs + len(ids)), words.counts)))
        self.docs += len(ids)
        self.bytes += len(data)

    def row(self, shard: int) -> tuple:
        term, doc = (np.concatenate(x) for x in zip(*self.keys, strict=True))
        lengths = np.concatenate(self.lengths)
        by_length = np.argsort(lengths, kind="stable")  # neighbours have like impacts: blocks bound them closely
        number = np.empty_like(by_length)
        number[by_length] = np.arange(len(by_length))
        order = np.argsort(number[doc], kind="stable")
        term, doc = term[order], number[doc][order]
        order = np.argsort(term, kind="stable")  # documents stay in order within a term
        term, doc = term[order], doc[order]
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])) if len(term) else np.zeros(0, np.int64)
        counts, term, doc = np.diff(new, append=len(term)), term[new], doc[new]
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else new
        u = lambda x: pack_planes(x.astype(np.uint64))
        return shard, int((lengths > 0).sum()), int(lengths.sum()), np.concatenate(self.ids)[by_length].astype("<i8").tobytes(), u(lengths[by_length]), pack(term[first]), u(np.diff(first, append=len(term))), u(doc), u(counts)


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _raw(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    enter()
    shard, parts = TaskContext.get().partitionId() << 32, _Parts()
    for whole in batches:
        for batch in slices(whole, 1):
            ids = batch.column(0).fill_null(_NONE).to_numpy(zero_copy_only=False).astype(np.int64)
            parts.add(ids, *text_bytes(batch.column(1)))
            if parts.bytes >= shard_bytes:
                yield _batch(RAW, [parts.row(shard)])
                shard, parts = shard + 1, _Parts()
    if parts.docs:
        yield _batch(RAW, [parts.row(shard)])


def factors(lengths: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """m of each document: 100 at the average length, 25 at the least."""
    return 25 + np.array([75 * n * n_docs // n_words for n in lengths.tolist()], np.int64)


def impacts(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


def block_borders(impact: np.ndarray, first: np.ndarray, sizes: np.ndarray, longest: int = LONGEST, cost: float = BLOCK_COST) -> tuple[np.ndarray, np.ndarray]:
    """(number of blocks of each list, lengths of all blocks) with the least bound error plus ``cost`` a block.

    For the first i postings of a list the best last block has d of them, d at most ``longest``:
    best(i) = min over d of best(i - d) + d * max(impact[i - d .. i - 1]) + cost. (The postings' own impacts are a
    constant.) Lists of like length go through the programme side by side.
    """
    n_blocks = np.ones(len(sizes), np.int64)
    lens: dict[int, np.ndarray] = {}
    kinds = np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)
    for kind in np.unique(kinds[sizes > 1]).tolist():
        members = np.flatnonzero(kinds == kind)
        step = max(1, (1 << 20) // (1 << kind))
        for at in range(0, len(members), step):
            some = members[at : at + step]
            n, width = sizes[some], int(sizes[some].max())
            reach = min(longest, width)
            a = np.zeros((width, len(some)))
            a[gather(np.zeros(len(some), np.int64), n), np.repeat(np.arange(len(some)), n)] = impact[gather(first[some], n)]
            best, last = np.zeros((width + 1, len(some))), np.zeros((width + 1, len(some)), np.int32)
            top, d = np.zeros((reach, len(some))), np.arange(1.0, reach + 1)[:, None]
            for i in range(1, width + 1):
                r = min(i, reach)
                top[1:r] = top[: r - 1]  # row d - 1: the largest of the last d
                top[0] = 0
                np.maximum(top[:r], a[i - 1], out=top[:r])
                total = top[:r] * d[:r] + best[i - r : i][::-1]
                k = total.argmin(0)
                best[i] = total[k, np.arange(len(some))] + cost
                last[i] = k + 1
            pos, row, out = n.copy(), np.arange(len(some)), []  # walk back from each list's end
            while len(row):
                took = last[pos[row], row]
                out.append((row, took))
                pos[row] -= took
                row = row[pos[row] > 0]
            whose, took = (np.concatenate(x[::-1]) for x in zip(*out, strict=True))
            order = np.argsort(whose, kind="stable")
            n_blocks[some] = count = np.bincount(whose, minlength=len(some))
            for i, part in zip(some.tolist(), np.split(took[order], np.cumsum(count)[:-1]), strict=True):
                lens[i] = part
    out = np.ones(int(n_blocks.sum()), np.int64)
    start = np.cumsum(n_blocks) - n_blocks
    for i, part in lens.items():
        out[start[i] : start[i] + len(part)] = part
    return n_blocks, out


def _blocked(batches: Iterator[pa.RecordBatch], n_docs: int, n_words: int, longest: int, cost: float) -> Iterator[pa.RecordBatch]:
    enter()
    for batch in batches:
        for i in range(batch.num_rows):
            row = tuple(c[i].as_py() for c in batch.columns)
            lengths, sizes, docs, counts = (unpack_planes(row[j]).astype(np.int64) for j in (4, 6, 7, 8))
            impact = impacts(counts, factors(lengths, n_docs, max(1, n_words))[docs])
            first = np.cumsum(sizes) - sizes
            n_blocks, lens = block_borders(impact, first, sizes, longest, cost)
            maxima = np.maximum.reduceat(impact, np.cumsum(lens) - lens) if len(lens) else lens
            u = lambda x: pack_planes(x.astype(np.uint64))
            yield _batch(INDEX, [(*row, u(n_blocks), u(lens), u(maxima))])


class Index:
    """A stored index: the table of shards, and the corpus' numbers of documents with terms and of terms."""

    def __init__(self, table: DataFrame, n_docs: int, n_words: int):
        self.table, self.n_docs, self.n_words = table, n_docs, n_words


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES, longest: int = LONGEST, cost: float = BLOCK_COST) -> Index:
    """The index of docs(doc_id, text), in the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    raw = stored(rows.mapInArrow(lambda it: _raw(it, shard_bytes), RAW), "postings")
    n = raw.agg(F.sum("n_docs").alias("d"), F.sum("n_words").alias("w")).first()
    n_docs, n_words = n.d or 0, n.w or 0
    table = stored(raw.mapInArrow(lambda it: _blocked(it, n_docs, n_words, longest, cost), INDEX), "index")
    discard(raw)
    return Index(table, n_docs, n_words)


# --- searching ---


class Query:
    """One query: its distinct terms' hashes and how often each stands in it."""

    def __init__(self, key: int | None, text: str | None):
        raw = (text or "").encode()
        words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=True, breaks=BREAKS)
        self.key = key
        self.terms, self.times = np.unique(words.hash, return_counts=True)


def _frequencies(batches: Iterator[pa.RecordBatch], asked: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Number in ``asked`` and document frequency of each asked term in the shards of a task."""
    enter()
    df = np.zeros(len(asked), np.int64)
    for batch in batches:
        for terms, sizes in zip(batch.column(0), batch.column(1), strict=True):
            at, found = _find(unpack(terms.as_py()), asked)
            df[found] += unpack_planes(sizes.as_py())[at].astype(np.int64)
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], ["term", "df"])


def _find(table: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted ``table`` of those of ``asked`` that it holds, and which these are."""
    at = np.searchsorted(table, asked)
    found = np.flatnonzero(at < len(table))
    found = found[table[at[found]] == asked[found]]
    return at[found], found


class Shard:
    """A shard's postings and blocks."""

    def __init__(self, row: dict, n_docs: int, n_words: int):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.terms = unpack(row["terms"])
        plain = {n: unpack_planes(row[n]).astype(np.int64) for n in ("lengths", "sizes", "docs", "counts", "n_blocks", "lens", "maxima")}
        self.m = factors(plain["lengths"], n_docs, max(1, n_words))
        self.docs, self.counts, self.lens, self.maxima, self.n_blocks = (plain[n] for n in ("docs", "counts", "lens", "maxima", "n_blocks"))
        self.start = np.cumsum(self.lens) - self.lens
        self.block = np.cumsum(self.n_blocks) - self.n_blocks
        self.read = 0  # postings read by searches

    def search(self, terms: np.ndarray, weight: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(score, document number) of every document that can be among the best ``k`` and scores at least ``least``."""
        place, found = _find(self.terms, terms)
        weight = weight[found]
        none = np.zeros(0, np.int64)
        live = weight > 0
        place, weight = place[live], weight[live]
        if not len(place):
            return none, none
        blocks = gather(self.block[place], self.n_blocks[place])
        each = np.repeat(weight, self.n_blocks[place])
        start, size = self.start[blocks], self.lens[blocks]
        low, high = self.docs[start], self.docs[start + size - 1]
        top = each * self.maxima[blocks]
        dense = high - low < DENSE * size
        step = np.zeros(len(self.ids) + 1, np.int64)
        np.add.at(step, low[dense], top[dense])
        np.subtract.at(step, high[dense] + 1, top[dense])
        bound = np.cumsum(step)[:-1]
        np.add.at(bound, self.docs[gather(start[~dense], size[~dense])], np.repeat(top[~dense], size[~dense]))
        pivots = np.flatnonzero(bound >= max(1, least))
        pivots = pivots[np.argsort(-bound[pivots], kind="stable")]
        scores, done, take, out = np.zeros(len(self.ids), np.int64), 0, FIRST, none
        while done < len(pivots) and bound[pivots[done]] >= max(1, least):
            now = pivots[done : done + take]
            now = now[bound[now] >= max(1, least)]
            marked = np.zeros(len(self.ids) + 1, np.int32)
            marked[now + 1] = 1
            before = np.cumsum(marked)
            hit = before[high + 1] > before[low]
            at = gather(start[hit], size[hit])
            w = np.repeat(each[hit], size[hit])
            self.read += len(at)
            inside = marked[self.docs[at] + 1] > 0
            at, w = at[inside], w[inside]
            np.add.at(scores, self.docs[at], w * impacts(self.counts[at], self.m[self.docs[at]]))
            out = np.concatenate([out, now])
            done, take = done + len(now), len(pivots)
            if len(out) >= k:
                least = max(least, int(np.partition(scores[out], len(out) - k)[len(out) - k]))
        out = out[scores[out] >= max(1, least)]
        return scores[out], out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _searched(batches: Iterator[pa.RecordBatch], queries: list[tuple[int, np.ndarray, np.ndarray]], n_docs: int, n_words: int, k: int) -> Iterator[pa.RecordBatch]:
    enter()
    top = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
    for batch in batches:
        for row in range(batch.num_rows):
            shard = Shard({n: batch.column(n)[row].as_py() for n in batch.schema.names}, n_docs, n_words)
            for q, (_, terms, weight) in enumerate(queries):
                scores, ids = top[q]
                new, docs = shard.search(terms, weight, k, int(scores[-1]) if len(scores) == k else 0)
                if len(new):
                    top[q] = best(np.concatenate([scores, new]), np.concatenate([ids, shard.ids[docs]]), k)
    sizes = [len(s) for s, _ in top]
    keys = np.repeat(np.array([q[0] for q in queries], np.int64), sizes)
    scores, ids = (np.concatenate([t[i] for t in top]) if top else np.zeros(0, np.int64) for i in (0, 1))
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids, mask=ids == _NONE), pa.array(scores)], ["item", "doc_id", "score"])


def _query_blocks(items: DataFrame, most: int) -> Iterator[list[Query]]:
    block, n = [], 0
    for row in items.toLocalIterator():
        query = Query(row[0], row[1])
        if block and n + len(query.terms) > most:
            yield block
            block, n = [], 0
        block.append(query)
        n += len(query.terms)
    if block:
        yield block


def search(index: Index, items: DataFrame, k: int = TOP, query_terms: int = QUERY_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the best ``k`` documents for each of items(item_id, text)."""
    kind = items.schema["item_id"].dataType.simpleString()
    hits = []
    for block in _query_blocks(items.select("item_id", "text").dropDuplicates(), query_terms):
        asked = np.unique(np.concatenate([q.terms for q in block]))
        rows = index.table.select("terms", "sizes").mapInArrow(lambda it, a=asked: _frequencies(it, a), "term long, df long")
        weight = np.zeros(len(asked), np.int64)
        for r in rows.groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():  # at most one row for each term of the block
            weight[r.term] = math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * r.df + 1)))
        ready = [(i, q.terms, q.times * weight[np.searchsorted(asked, q.terms)]) for i, q in enumerate(block)]
        n_docs, n_words = index.n_docs, index.n_words
        found = index.table.mapInArrow(lambda it, r=ready: _searched(it, r, n_docs, n_words, k), "item long, doc_id long, score long")
        names = items.sparkSession.createDataFrame([(i, q.key) for i, q in enumerate(block)], f"item long, item_id {kind}")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        hits.append(found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).join(F.broadcast(names), "item").select("item_id", "doc_id", "score"))
    if not hits:
        return items.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = hits[0]
    for more in hits[1:]:
        out = out.unionByName(more)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
s AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_words FROM t WHERE len(t) > 0),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM t) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT item_id, term, count(*) AS times, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM q JOIN f USING (term), s GROUP BY item_id, term, df, n_docs),
h AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_words))))::BIGINT AS score FROM p JOIN w USING (term), s GROUP BY 1, 2),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM h WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""
