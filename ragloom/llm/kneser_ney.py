"""Quality classifier: interpolated modified Kneser-Ney perplexity against trusted text.

The model is a 4-gram model over 62 classes of UTF-8 bytes, one for each language, trained on every trusted document
(``labels.quality`` = 1). Counting and scoring are sharded joins:

1. Documents go to blocks by doc_id, labels to the same blocks. A block sends, per language and shard, its distinct
   n-grams with their counts in trusted text (0 for those it only needs a score for). Shards are cut by an n-gram's
   two middle symbols, so a shard holds the whole of each context and each lower-order continuation count.
2. Counts are added up level by level, ``GROUP`` lists at a time, so that no task's share grows with the corpus; the
   last level makes continuation counts and counts of counts. A language's discounts (D1, D2, D3+ for each order) and
   its 3-gram table (at most 64**3 cells, whatever the corpus) are made from the shards' sums.
3. For each shard and ``GROUP`` blocks the blocks' n-grams are joined with the counts; each block is answered with log
   probabilities and turns them into per-document perplexity. Texts are shuffled once; both block passes read that
   exchange.

A document is kept if its perplexity lies within its language's quantiles over the trusted documents, widened by
``SLACK`` (so that trusted text itself is hardly cut): junk is less predictable, empty repetition more so. A short
text's perplexity says little, so all are drawn towards their language's middle by ``PRIOR`` bytes.

Defined cases: null or empty text has no perplexity and is rejected; a null language is a language of its own; a
language without trusted text has no perplexity and its non-empty documents are kept; rows with equal doc_id share
labels; a null doc_id has no label; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_blocks, block_count, discard, enter, fresh, stored, to_blocks
from .sketches import pack, pack_planes, table_of, unpack, unpack_planes
from .words import text_bytes

ORDER = 4
SHARDS = 32
#: Lists of n-grams that one task adds up, or blocks that it answers.
GROUP = 64
LOW, HIGH = 0.001, 0.995
#: Widening of the quantiles, as a factor of perplexity.
SLACK = 1.02
#: Bytes at its language's middle perplexity that are added to a text before it is held against the bounds.
PRIOR = 100
_MARKS = "!|*%$&#-'"


def _symbols() -> np.ndarray:
    """A byte's class: 0 is kept for what stands before a text."""
    out = np.full(256, 42, np.int32)
    out[97:123] = np.arange(1, 27)
    out[65:91] = 27
    out[48:58] = 28
    out[32] = 29
    out[:32] = 30
    out[[ord("."), ord(",")]] = [31, 32]
    for i, c in enumerate(_MARKS):
        out[ord(c)] = 33 + i
    out[128:192] = 43 + np.arange(64) % 16
    out[192:224], out[224:240], out[240:] = 59, 60, 61
    return out


_CLASS = _symbols()
COUNTS = "block int, grp int, lang string, shard int, codes binary, counts binary"
SUMS = "grp int, lang string, shard int, codes binary, counts binary"
TABLE = "lang string, shard int, codes binary, counts binary, thirds binary, more binary, ones array<long>"
MODEL = "lang string, shard int, thirds binary, probs binary, discounts array<double>"
ANSWER = "block int, lang string, codes binary, logs binary"


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte's 4-gram code (its class and the three before it in its text), and texts' first positions (n + 1)."""
    pad = ORDER - 1
    sym = np.zeros(len(data) + pad * (len(offsets) - 1) + pad, np.int32)
    shift = np.repeat(np.arange(1, len(offsets)) * pad, np.diff(offsets))
    at = np.arange(len(data)) + shift
    sym[at] = _CLASS[data]
    code = sym[at]
    for back in range(1, ORDER):
        code |= sym[at - back] << (6 * back)
    return code, offsets


def _shard(codes: np.ndarray) -> np.ndarray:
    """By the two middle symbols."""
    return ((((codes >> 6) & 4095) * 2654435761 & 0xFFFFFFFF) >> 20) % SHARDS


def _languages(table: pa.Table) -> list[str]:
    return ["" if x is None else f"={x}" for x in table["lang"].to_pylist()]


def _pieces(docs: pa.Table):
    """The block by language: language, rows, 4-gram codes and offsets; at most about 4 MB of text at a time."""
    langs = np.array(_languages(docs), object)
    text = docs["text"].combine_chunks()
    for lang in sorted(set(langs)):
        rows = np.flatnonzero(langs == lang)
        data, offsets = text_bytes(text.take(pa.array(rows)))
        cuts = np.unique(np.searchsorted(offsets, np.arange(0, len(data) + (4 << 20), 4 << 20)))
        cuts = np.unique(np.concatenate([[0], cuts[cuts < len(rows)], [len(rows)]]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield lang, rows[a:b], *_codes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _count(docs: pa.Table, labels: pa.Table) -> pa.Table:
    enter()
    out: list[tuple] = []
    if docs.num_rows:
        good = set(labels["label_id"].to_pylist())
        trusted = np.array([i in good for i in docs["doc_id"].to_pylist()], bool)
        block, seen, have, mine = docs["block"][0].as_py(), np.zeros(1 << 24, bool), None, []
        for lang, rows, code, offsets in _pieces(docs):
            if lang != have:
                out += _cells(block, have, seen, mine)
                seen[:], have, mine = False, lang, []
            seen[code] = True
            mine.append(np.unique(code[np.repeat(trusted[rows], np.diff(offsets))], return_counts=True))
        out += _cells(block, have, seen, mine)
    return table_of(COUNTS, out)


def _summed(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order and their counts over all lists."""
    codes = np.concatenate([c.astype(np.int64) for c, _ in lists] or [np.zeros(0, np.int64)])
    counts = np.concatenate([n.astype(np.int64) for _, n in lists] or [np.zeros(0, np.int64)])
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def _cells(block: int, lang: str | None, seen: np.ndarray, mine: list[tuple]) -> list[tuple]:
    if lang is None:
        return []
    codes = np.flatnonzero(seen)
    counts = np.zeros(len(codes), np.int64)
    some, n = _summed(mine)
    counts[np.searchsorted(codes, some)] = n
    shard = _shard(codes)
    return [(block, block // GROUP, lang, s, pack(codes[own]), pack_planes(counts[own].astype(np.uint64))) for s in range(SHARDS) if len(own := np.flatnonzero(shard == s))]


def _lists(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Codes and counts of every row, those without a count left out."""
    out = []
    for codes, counts in zip(table["codes"], table["counts"], strict=True):
        n = unpack_planes(counts.as_py())
        some = np.flatnonzero(n)
        out.append((unpack(codes.as_py())[some], n[some]))
    return out


def _add(table: pa.Table) -> pa.Table:
    """One level of sums of one language's shard."""
    codes, counts = _summed(_lists(table))
    return table_of(SUMS, [(table["grp"][0].as_py(), table["lang"][0].as_py(), table["shard"][0].as_py(), pack(codes), pack_planes(counts.astype(np.uint64)))])


def _sum(table: pa.Table) -> pa.Table:
    """One language's shard: trusted counts, continuation counts of 3-grams, and how many 4-grams occur 1-4 times."""
    codes, counts = _summed(_lists(table))
    codes, counts = codes.astype("<i4"), counts.astype("<i8")
    thirds, more = np.unique(codes & ((1 << 18) - 1), return_counts=True)
    ones = [int((counts == k).sum()) for k in range(1, 5)]
    blob = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
    return pa.table({"lang": pa.array([table["lang"][0].as_py()], pa.string()), "shard": pa.array([table["shard"][0].as_py()], pa.int32()), "codes": blob(codes, "<i4"), "counts": blob(counts, "<i8"), "thirds": blob(thirds, "<i4"), "more": blob(more, "<i4"), "ones": pa.array([ones], pa.list_(pa.int64()))})


def discounts(ones) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more, from the numbers of items that occur 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (max(float(x), 0.0) for x in ones)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(x, 0.1), k + 0.9) for k, x in enumerate(d))])


def lower_order(count: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Interpolated probabilities of an order's dense continuation counts [contexts, 64] over those of the order below."""
    d = discounts([(count == k).sum() for k in range(1, 5)])
    cut = d[np.minimum(count, 3)]
    total = count.sum(1, keepdims=True)
    spare = cut.sum(1, keepdims=True)
    return np.where(total > 0, (np.maximum(count - cut, 0) + spare * below) / np.maximum(total, 1), below)


def _model(table: pa.Table) -> pa.Table:
    """A language's 3-gram probabilities and 4-gram discounts, dealt to its shards."""
    third = np.zeros(1 << 18, np.int64)
    for codes, more in zip(table["thirds"], table["more"], strict=True):
        third[np.frombuffer(codes.as_py(), "<i4")] = np.frombuffer(more.as_py(), "<i4")
    c3 = third.reshape(4096, 64)
    c2 = (c3.reshape(64, 64, 64) > 0).sum(0)
    c1 = (c2 > 0).sum(0).reshape(1, 64)
    p1 = lower_order(c1, np.full((1, 64), 1 / 64))
    p2 = lower_order(c2, p1)
    p3 = lower_order(c3, np.tile(p2, (64, 1))).reshape(-1)
    d = discounts(np.sum(table["ones"].to_pylist(), 0)) if third.any() else np.zeros(0)
    every = np.arange(1 << 18)
    shard = _shard((every & ~63))  # symbols x, y of the 3-gram xyz stand where a 4-gram's middle ones do
    rows = sorted(set(table["shard"].to_pylist()))
    mine = [every[shard == s] for s in rows]
    blob = lambda xs: pa.array([x.tobytes() for x in xs], pa.binary())
    return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(rows), pa.string()), "shard": pa.array(rows, pa.int32()), "thirds": blob([m.astype("<i4") for m in mine]), "probs": blob([p3[m].astype("<f8") for m in mine]), "discounts": pa.array([d.tolist()] * len(rows), pa.list_(pa.float64()))})


def _answer(asked: pa.Table, model: pa.Table) -> pa.Table:
    out = []
    if asked.num_rows and model.num_rows and len(d := np.array(model["discounts"][0].as_py())):
        codes, counts = np.frombuffer(model["codes"][0].as_py(), "<i4").astype(np.int64), np.frombuffer(model["counts"][0].as_py(), "<i8")
        p3 = np.zeros(1 << 18)
        p3[np.frombuffer(model["thirds"][0].as_py(), "<i4")] = np.frombuffer(model["probs"][0].as_py(), "<f8")
        cut = d[np.minimum(counts, 3)]
        total, spare = np.bincount(codes >> 6, counts, 1 << 18), np.bincount(codes >> 6, cut, 1 << 18)
        top = np.append(counts - cut, 0.0)
        known = np.append(codes, -1)
        for block, raw in zip(asked["block"].to_pylist(), asked["codes"], strict=True):
            q = unpack(raw.as_py()).astype(np.int64)
            context, low, place = q >> 6, p3[q & ((1 << 18) - 1)], np.searchsorted(codes, q)
            n = total[context]
            own = np.where(known[place] == q, top[place], 0.0)
            p = np.where(n > 0, (own + spare[context] * low) / np.maximum(n, 1), low)
            out.append((block, asked["lang"][0].as_py(), raw.as_py(), np.log(p).astype("<f4").tobytes()))
    return table_of(ANSWER, out)


def _score(docs: pa.Table, labels: pa.Table, answers: pa.Table) -> pa.Table:
    enter()
    perplexity = [None] * docs.num_rows
    good = set(labels["label_id"].to_pylist())
    names = answers["lang"].to_pylist()
    table, have = np.zeros(1 << 24, np.float32), None
    for lang, rows, code, offsets in _pieces(docs) if docs.num_rows else ():
        if lang != have:
            mine = [i for i, x in enumerate(names) if x == lang]
            for i in mine:
                table[unpack(answers["codes"][i].as_py()).astype(np.int64)] = np.frombuffer(answers["logs"][i].as_py(), "<f4")
            have = lang
        if mine:
            total = np.concatenate([[0.0], np.cumsum(table[code], dtype=np.float64)])
            size = np.diff(offsets)
            mean = (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1)
            for i, n, m in zip(rows.tolist(), size.tolist(), mean.tolist(), strict=True):
                perplexity[i] = float(np.exp(-m)) if n else None
    return pa.table({"doc_id": docs["doc_id"], "lang": docs["lang"], "text_key": docs["text_key"], "size": docs["size"], "trusted": pa.array([i in good for i in docs["doc_id"].to_pylist()], pa.bool_()), "perplexity": pa.array(perplexity, pa.float64())})


def _score_pair(docs: pa.Table, other: pa.Table) -> pa.Table:
    """Labels and answers come as one table: a label row has no codes."""
    label = pa.compute.is_null(other["codes"])
    return _score(docs, other.filter(label), other.filter(pa.compute.invert(label)))


def perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, text_key (hash of the text), size (bytes), trusted, perplexity per row; stored in the shared folder."""
    blocks = block_count(docs)
    groups = -(-blocks // GROUP)
    kind = "doc_id long, lang string, text_key long, size long, trusted boolean, perplexity double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text").alias("text_key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    rows = as_blocks(rows, blocks, F.coalesce("doc_id", "text_key"))
    trusted = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("label_id")).distinct()
    trusted = as_blocks(trusted, blocks, F.col("label_id"))
    counted = rows.groupBy("block").cogroup(trusted.groupBy("block")).applyInArrow(_count, COUNTS)
    parts = max(8, min(blocks, 4 * SHARDS * groups))
    keys = ("lang", "shard", "grp")
    counted = counted.repartition(parts, *keys)
    sums, left = counted, groups
    while left > 1:
        sums = sums.groupBy(*keys).applyInArrow(_add, SUMS).withColumn("grp", F.floor(F.col("grp") / GROUP).cast("int"))
        left = -(-left // GROUP)
    table = stored(sums.groupBy("lang", "shard").applyInArrow(_sum, TABLE), "ngram-counts")
    model = table.select("lang", "shard", "thirds", "more", "ones").groupBy("lang").applyInArrow(_model, MODEL)
    joined = table.select("lang", "shard", "codes", "counts").join(model, ["lang", "shard"]).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    answers = counted.select("block", *keys, "codes").groupBy(*keys).cogroup(joined.repartition(parts, *keys).groupBy(*keys)).applyInArrow(_answer, ANSWER)
    other = answers.withColumn("label_id", F.lit(None).cast("long")).unionByName(trusted.select("block", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("binary").alias("logs"), "label_id"))
    out = stored(rows.groupBy("block").cogroup(to_blocks(other, blocks).groupBy("block")).applyInArrow(_score_pair, kind), "perplexity")
    discard(table)
    return out


def classify(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH, slack: float = SLACK) -> DataFrame:
    """Per row: doc_id, lang, text_key, perplexity, drawn (what is held against the bounds), low, high, kept."""
    scored = perplexities(docs, labels)
    trusted = scored.filter("trusted and perplexity is not null")
    middle = trusted.groupBy("lang").agg(F.percentile_approx("perplexity", 0.5, 10_000).alias("middle")).withColumnRenamed("lang", "_lang")
    drawn = scored.join(middle, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    drawn = drawn.withColumn("drawn", F.exp((F.col("size") * F.log("perplexity") + F.lit(PRIOR) * F.log("middle")) / (F.col("size") + F.lit(PRIOR))))
    q = drawn.filter("trusted and drawn is not null").groupBy("lang").agg(F.percentile_approx("drawn", [low, high], 10_000).alias("q"))
    bounds = q.select(F.col("lang").alias("_lang"), (F.col("q")[0] / slack).alias("low"), (F.col("q")[1] * slack).alias("high"))
    joined = drawn.join(bounds, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    inside = F.col("drawn").isNull() | F.col("low").isNull() | F.col("drawn").between(F.col("low"), F.col("high"))
    return joined.select("doc_id", "lang", "text_key", "perplexity", "drawn", "low", "high", ((F.col("size") > 0) & inside).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all columns stay as they were."""
    one, two = fresh("id", docs.columns), fresh("key", docs.columns)
    gone = classify(docs, labels).filter(~F.col("kept")).select(F.col("doc_id").alias(one), F.col("text_key").alias(two)).distinct()
    match = docs["doc_id"].cast("long").eqNullSafe(gone[one]) & (F.xxhash64(docs["text"]) == gone[two])
    return docs.join(gone, match, "left_anti")
