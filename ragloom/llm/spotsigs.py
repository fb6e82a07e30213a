"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

Every occurrence of an anchor (a common word) opens a spot: its signature is the anchor and the next ``CHAIN`` content
words after it. A text's fingerprint is its set of signatures. Where no anchor has come for ``GAP`` words (tables,
lists), every word opens a spot with a chain of one, and a text without any chain has one signature of all its words,
so different texts never share an empty set. Likeness is the Jaccard similarity of the sets; it is first bounded by the set lengths
(|A|/|B| for |A| <= |B|) and pairs whose bound is below the wanted similarity are not compared.

Words are lower-cased (A-Z) runs of ASCII letters, digits and all non-ASCII bytes.

Defined cases: null text is empty; two texts without words are alike (1.0), one without words is unlike any other
(0.0); rows with equal doc_id follow each other in text order; a null doc_id comes first; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_count, enter, stored
from .jaccard_join import _meets, prefix_lists, prefixes, verified
from .words import Words, mix, text_bytes

#: Common words of English, French, German and Spanish.
COMMON = (
    "a an and are as at be by for from has have he her his in is it its not of on or she that the their they this to was were which with you "
    "au aux avec ce dans de des du elle en est et il la le les mais ne nous on ou par pas pour qui que se son sur un une "
    "auch auf aus bei das dem den der des die ein eine er es für im ist mit nicht sich sie sind und von wie zu zum "
    "al como con del el ella en es esta la las lo los más no para pero por que se sin su sus un una y"
).split()
CHAIN = 2
#: Words after an anchor, from which on (or before a text's first anchor) every word opens a spot.
GAP = 8
#: Bits of a signature; the rest of 64 number a batch's rows.
SIGNATURE = 40
_SHIFT = np.uint64(SIGNATURE)
_REST = np.uint64(64 - SIGNATURE)
_LOW = np.uint64((1 << SIGNATURE) - 1)
_BREAKS = np.ones(256, bool)
_BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _hashes(words) -> np.ndarray:
    data, offsets = text_bytes(pa.array(sorted(set(words))))
    return np.sort(Words(data, offsets, lower=True, breaks=_BREAKS).hash)


_ANCHORS = _hashes(COMMON)


def signatures(column) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct signatures as one array of row << SIGNATURE | signature, sorted, and their number per row."""
    data, offsets = text_bytes(column)
    w = Words(data, offsets, lower=True, breaks=_BREAKS)
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), w.counts)
    place = np.minimum(np.searchsorted(_ANCHORS, w.hash), len(_ANCHORS) - 1)
    anchor = _ANCHORS[place] == w.hash
    content = np.flatnonzero(~anchor)
    place = np.arange(len(anchor))
    last = np.maximum.accumulate(np.where(anchor, place, -1)) if len(anchor) else place
    lone = ~anchor & ((last < w.first[:-1][row]) | (place - last > GAP))
    keys = np.concatenate([_chains(w.hash, row, np.flatnonzero(anchor), content, CHAIN), _chains(w.hash, row, np.flatnonzero(lone), content, 1)])
    bare = np.flatnonzero((np.bincount((keys >> _SHIFT).astype(np.int64), minlength=rows) == 0) & (w.counts > 0))
    if len(bare):
        keys = np.concatenate([keys, (bare.astype(np.uint64) << _SHIFT) | (w.whole(bare) >> _REST)])
    keys = np.unique(keys)
    return keys, np.bincount((keys >> _SHIFT).astype(np.int64), minlength=rows)


def _chains(h, row, spots, content, length: int) -> np.ndarray:
    """row << SIGNATURE | signature of each spot whose chain of content words lies in its own row."""
    at = np.searchsorted(content, spots, "right")
    ok = at + length <= len(content)
    spots, at = spots[ok], at[ok]
    if not len(spots):
        return np.zeros(0, np.uint64)
    ok = row[content[at + length - 1]] == row[spots]
    spots, at = spots[ok], at[ok]
    sig = h[spots] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(length):
        sig = mix(sig + h[content[at + k]], length + 8 * k)
    return (row[spots].astype(np.uint64) << _SHIFT) | (sig >> _REST)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float = 0.0) -> np.ndarray:
    """Jaccard similarity row by row; 0 where the set lengths rule out ``least``."""
    na, nb = a[1], b[1]
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    live = small >= least * large
    keep = [x[live[(x >> _SHIFT).astype(np.int64)]] for x in (a[0], b[0])] if least > 0 else [a[0], b[0]]
    both = np.intersect1d(*keep, assume_unique=True)
    met = np.bincount((both >> _SHIFT).astype(np.int64), minlength=len(na))
    return np.where(large == 0, 1.0, met / np.maximum(1, na + nb - met))


def fingerprints(keys: np.ndarray, counts: np.ndarray) -> list[str]:
    """The sets as text: base64 of the sorted little-endian signatures, five bytes each."""
    width = SIGNATURE // 8
    raw, at, out = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), 0, []
    for n in counts.tolist():
        out.append(base64.b64encode(raw[at : at + width * n]).decode())
        at += width * n
    return out


def _rows(keys, counts, take) -> tuple[np.ndarray, np.ndarray]:
    """Sets of rows ``take``, renumbered."""
    first = np.concatenate([[0], np.cumsum(counts)])
    n = counts[take]
    spread = np.repeat(first[take] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return (np.repeat(np.arange(len(take), dtype=np.uint64), n) << _SHIFT) | (keys[spread] & _LOW), n


def _neighbours(table: pa.Table) -> pa.Table:
    """One block: its documents in order, the last of them followed by the block's guest."""
    enter()
    texts = table["text"].to_pylist()
    ids, guest = table["doc_id"].to_pylist(), table["guest"].to_pylist()
    order = sorted(range(len(texts)), key=lambda i: (guest[i], ids[i] is not None, ids[i] or 0, texts[i]))
    n = len(texts) - sum(guest)
    order = order[: n + 1]
    texts = [texts[i] for i in order]
    follow = np.minimum(np.arange(n) + 1, len(texts) - 1)
    edited = []
    for i in range(n):
        t, k = texts[i], len(texts[i]) // 4
        edited.append(t[: len(t) - k] + texts[follow[i]][:k])
    own, new = signatures(pa.array(texts, pa.large_string())), signatures(pa.array(edited, pa.large_string()))
    mine = _rows(*own, np.arange(n))
    return pa.table({
        "doc_id": pa.array([ids[i] for i in order[:n]], table["doc_id"].type),
        "n_chars": pa.array([len(t) for t in texts[:n]], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        "fingerprint": pa.array(fingerprints(*mine), pa.string()),
        "edited_fingerprint": pa.array(fingerprints(*new), pa.string()),
        "near_edited": pa.array(likeness(mine, new), pa.float64()),
        "near_next": pa.array(likeness(mine, _rows(*own, follow)), pa.float64()),
    })


def neighbour_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and likeness to the edited text and the next document.

    Documents go to range blocks of doc_id; each block also receives the first document of the block after it, so the
    order is global though no task holds more than a block. Only the blocks' first ids (one number each) reach the driver.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = block_count(docs)
    cuts = sorted(set(docs.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", [i / blocks for i in range(1, blocks)], 0.25 / blocks))) if blocks > 1 else []
    cuts = cuts or [0.0]
    split = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_x", outputCol="_b", handleInvalid="keep")
    bucket = lambda df: split.transform(df.withColumn("_x", F.coalesce(F.col("doc_id").cast("double"), F.lit(float(-(2**63)))))).withColumn("block", F.col("_b").cast("int")).drop("_x", "_b")
    ids = bucket(docs.select(F.col("doc_id").cast("long").alias("doc_id")))
    null_first = F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("first")
    firsts = sorted(ids.groupBy("block").agg(null_first).collect())
    spark = docs.sparkSession
    before = [(b, firsts[i - 1].block, f) for i, (b, f) in enumerate(firsts)]
    guests = F.broadcast(spark.createDataFrame(before, "gb int, home int, first long"))
    marked = bucket(rows)
    again = marked.join(guests, (F.coalesce("doc_id", F.lit(-(2**63))) == F.col("first")) & (F.col("block") == F.col("gb"))).select("doc_id", "text", F.col("home").alias("block"), F.lit(True).alias("guest"))
    both = marked.select("doc_id", "text", "block", F.lit(False).alias("guest")).unionByName(again)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return both.repartition(blocks, "block").groupBy("block").applyInArrow(_neighbours, schema)


def signature_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n and tokens (sorted signatures as longs)."""

    def read(batches):
        for batch in batches:
            keys, counts = signatures(batch.column(1))
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array((keys & _LOW).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), tokens], ["doc_id", "n", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, "doc_id long, n long, tokens array<long>")


def memberships(docs: DataFrame) -> DataFrame:
    """doc_id, class_id for every row: the representative (smallest doc_id) of its signature set, to go with ``near_duplicates``.

    Rows with equal sets, texts without words among them, are one class. A null doc_id is kept; a class of such rows alone
    has a null class_id.
    """
    sets = stored(signature_sets(docs), "signature-members")
    classes = sets.groupBy("tokens").agg(F.min("doc_id").alias("class_id"))
    return sets.join(classes, "tokens").select("doc_id", "class_id")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """u, v: pairs of representatives (smallest doc_id of each distinct set) whose sets reach the similarity, once each.

    Sets are partitioned by length so that two similar ones fall into the same or adjacent partitions; each set's rarest
    signatures (its prefix) are posted to its own partition and looked up in it and the one above.
    """
    sets = signature_sets(docs).filter("n > 0 and doc_id is not null")
    classes = stored(sets.groupBy("tokens").agg(F.min("doc_id").alias("cid"), F.first("n").alias("n")), "signature-classes")
    sides = stored(classes.join(prefix_lists(classes, percent, 1).drop("n"), "cid"), "signature-sides")
    part = F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("int")
    posted = prefixes(sides, percent).withColumn("part", part)
    low = posted.select("token", "part", *(F.col(c).alias(f"a_{c}") for c in ("cid", "n", "pos")))
    high = posted.select("token", F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"), F.col("part").alias("own"), *(F.col(c).alias(f"b_{c}") for c in ("cid", "n", "pos")))
    once = F.when(F.col("own") == F.col("part"), F.col("a_cid") < F.col("b_cid")).otherwise(F.lit(True))
    met = low.join(high, ["token", "part"]).filter(once & _meets("a_", "b_", percent))
    pairs = met.select(F.least("a_cid", "b_cid").alias("u"), F.greatest("a_cid", "b_cid").alias("v")).distinct()
    return verified(pairs, sides, percent)
