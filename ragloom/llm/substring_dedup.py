"""Substring deduplication: repeated windows of words, found behind a count-min prefilter.

1. Each block of documents sketches the windows that start in it; the partition sketches are merged range by range, and
   every block learns which of its cells may be repeated (``sketches``).
2. Only windows whose estimate is two or more are grouped exactly, by 96 bits of two independent hashes: a block sends
   each distinct one with the smallest doc_id it has there. Groups of blocks are joined first, then groups of groups;
   what comes back is one bit for each window sent: whether a document with a smaller id has it elsewhere.
3. A block marks every word covered by a window that starts in a document with a smaller doc_id and writes the rest.

Texts are shuffled to their blocks once; the three steps read that same exchange. Hot windows travel once per block,
not once per document. Nothing is broadcast or collected; rows of every exchange grow with the input.

Defined cases: null text and texts of fewer words than a window keep all words; repeated rows (same doc_id) do not
remove each other; a null doc_id counts as smaller than every other; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_blocks, block_count, enter, input_bytes, to_blocks
from .sketches import GROUP, LISTS, RANGE_BITS, Repeated, flags, level_parts, merged, pack, pack_planes, partition_sketch, range_cuts, table_of, unpack, unpack_planes, width_bits
from .words import Words, text_bytes

WINDOW = 13
SENT = "range long, grp int, member int, h1 binary, h2 binary, least binary"
TOLD = "range long, grp int, member int, n int, bits binary"
_NONE = -(2**63)


def _block(table: pa.Table) -> tuple[Words, np.ndarray]:
    enter()
    data, offsets = text_bytes(table["text"])
    ids = table["doc_id"].combine_chunks().fill_null(_NONE).to_numpy(zero_copy_only=False).astype(np.int64)
    return Words(data, offsets), ids


def _sketch(table: pa.Table, window: int, bits: int, group: int) -> pa.Table:
    words, _ = _block(table)
    return partition_sketch(table["block"][0].as_py(), words.windows(window)[0], bits, group)


def _runs(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the windows by h1, then h2, and where in it each distinct one begins."""
    order = np.argsort(h1)
    a, b = h1[order], h2[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():  # different windows that share their first hash
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return order, np.flatnonzero(np.concatenate([[True], ~same])) if len(h1) else np.zeros(0, np.int64)


class _Candidates:
    """A block's windows that may be repeated: their starts, documents' ids and, for each distinct one, hashes and least id."""

    def __init__(self, docs: pa.Table, found: pa.Table, window: int, bits: int):
        self.words, ids = _block(docs)
        h1, at = self.words.windows(window)
        keep = np.flatnonzero(Repeated(found, bits)(h1)) if found.num_rows else np.zeros(0, np.int64)
        h1, at = h1[keep], at[keep]
        h2 = (self.words.windows(window, 1)[0][keep] >> np.uint64(32)) if len(keep) else h1
        order, first = _runs(h1, h2)
        self.at, self.own = at[order], ids[np.searchsorted(self.words.first, at[order], "right") - 1]
        self.run = np.repeat(np.arange(len(first)), np.diff(first, append=len(order)))
        self.h1, self.h2 = h1[order][first], h2[order][first]
        self.least = np.minimum.reduceat(self.own, first) if len(first) else np.zeros(0, np.int64)
        self.cuts = range_cuts(self.h1, 64, RANGE_BITS)


def _blobs(h1, h2, least, low: int) -> tuple[bytes, bytes, bytes]:
    """Hashes less ``low``, and ids with the sign in their lowest bit."""
    return pack(h1 - np.uint64(low)), h2.astype("<u4").tobytes(), pack_planes(((least << 1) ^ (least >> 63)).view(np.uint64))


def _ids(raw: bytes) -> np.ndarray:
    x = unpack_planes(raw)
    return ((x >> np.uint64(1)) ^ (np.uint64(0) - (x & np.uint64(1)))).view(np.int64)


def _cut(member: int, prefix: int, width: int, group: int, h1: np.ndarray, h2: np.ndarray, least: np.ndarray) -> list[tuple]:
    """Rows of windows whose h1 has ``width`` bits, dealt to the ranges below ``prefix``."""
    cuts, out = range_cuts(h1, width, RANGE_BITS), []
    for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a < b:
            out.append(((prefix << RANGE_BITS) + r, member // group, member, *_blobs(h1[a:b], h2[a:b], least[a:b], r << (width - RANGE_BITS))))
    return out


def _send(docs: pa.Table, found: pa.Table, window: int, bits: int, group: int) -> pa.Table:
    if not docs.num_rows:
        return table_of(SENT, [])
    c = _Candidates(docs, found, window, bits)
    return table_of(SENT, _cut(docs["block"][0].as_py(), 0, 64, group, c.h1, c.h2, c.least))


class _Joined:
    """Windows of several lists: for each element its list and distinct window, for each of these hashes and least id."""

    def __init__(self, table: pa.Table):
        self.rows = [table[n].to_pylist() for n in ("range", "grp", "member")]
        parts = [unpack(x.as_py()) for x in table["h1"]]
        self.sizes = [len(x) for x in parts]
        h1 = np.concatenate(parts)
        h2 = np.frombuffer(b"".join(x.as_py() for x in table["h2"]), "<u4").astype(np.uint64)
        self.own = np.concatenate([_ids(x.as_py()) for x in table["least"]])
        order, first = _runs(h1, h2)
        self.run = np.empty(len(order), np.int64)
        self.run[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(order)))
        self.h1, self.h2 = h1[order][first], h2[order][first]
        self.least = np.minimum.reduceat(self.own[order], first)


    def tell(self, tell: np.ndarray) -> pa.Table:
        """For each member one bit per window sent."""
        out, at = [], 0
        for r, g, m, n in zip(*self.rows, self.sizes, strict=True):
            out.append((r, g, m, n, np.packbits(tell[at : at + n]).tobytes()))
            at += n
        return table_of(TOLD, out)


def _top(table: pa.Table) -> pa.Table:
    """Does another member have the window with a smaller doc_id?"""
    j = _Joined(table)
    return j.tell(j.least[j.run] < j.own)


def _up(table: pa.Table, width: int, group: int) -> pa.Table:
    j = _Joined(table)
    return table_of(SENT, _cut(j.rows[1][0], j.rows[0][0], width, group, j.h1, j.h2, j.least))


def _down(sent: pa.Table, told: pa.Table) -> pa.Table:
    """The same for a group's members, where ``told`` says it of the group among other groups, range by finer range."""
    if not sent.num_rows:
        return table_of(TOLD, [])
    j = _Joined(sent)
    parts = sorted(zip(told["sub"].to_pylist(), told["n"].to_pylist(), (x.as_py() for x in told["bits"]), strict=True))
    elsewhere = np.concatenate([flags(raw, n) for _, n, raw in parts])
    return j.tell(elsewhere[j.run] | (j.least[j.run] < j.own))


def smaller_elsewhere(sent: DataFrame, members: int, blocks: int, group: int, level: int = 0) -> DataFrame:
    """``TOLD`` of what each member sent: does any other member have the window with a smaller doc_id?"""
    parts, groups = level_parts(blocks, group, level), -(-members // group)
    sent = sent.repartition(parts, "range", "grp")
    if groups == 1:
        return sent.groupBy("range", "grp").applyInArrow(_top, TOLD)
    width = 64 - RANGE_BITS * (level + 1)
    told = smaller_elsewhere(sent.groupBy("range", "grp").applyInArrow(lambda t: _up(t, width, group), SENT), groups, blocks, group, level + 1)
    told = told.select(F.shiftright("range", RANGE_BITS).alias("range"), F.col("member").alias("grp"), F.col("range").alias("sub"), "n", "bits").repartition(parts, "range", "grp")
    return sent.groupBy("range", "grp").cogroup(told.groupBy("range", "grp")).applyInArrow(_down, TOLD)


def _strip(docs: pa.Table, other: pa.Table, window: int, bits: int, texts: bool) -> pa.Table:
    """``other`` holds the block's repeated cells and, as rows without cells, the bits for the windows it sent."""
    told = pc.is_null(other["cells"])
    c = _Candidates(docs, other.filter(pc.invert(told)), window, bits)
    elsewhere = np.zeros(len(c.h1), bool)
    other = other.filter(told)
    for r, raw in zip(other["range"].to_pylist(), other["bits"], strict=True):
        a, b = c.cuts[r], c.cuts[r + 1]
        elsewhere[a:b] = flags(raw.as_py(), b - a)
    marked = elsewhere[c.run] | (c.least[c.run] < c.own)
    words = c.words
    cover = np.zeros(len(words.start) + 1, np.int32)
    cover[c.at[marked]] += 1  # a window start stands once among the candidates
    cover[c.at[marked] + window] -= 1
    gone = np.cumsum(cover)[:-1] > 0
    total = np.concatenate([[0], np.cumsum(gone)])
    removed = total[words.first[1:]] - total[words.first[:-1]]
    data, offsets = text_bytes(docs["text"])
    raw, kept = data.tobytes(), []
    for i, n in enumerate(removed.tolist()):
        parts = raw[offsets[i] : offsets[i + 1]].split()
        kept.append(b" ".join(compress(parts, (~gone[words.first[i] : words.first[i + 1]]).tolist()) if n else parts))
    out = {"doc_id": docs["doc_id"], "n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
    if texts:
        out["kept_text"] = pa.array([x.decode() for x in kept], pa.string())
    return pa.table(out)


def substring_dedup(docs: DataFrame, window: int = WINDOW, texts: bool = False, blocks: int | None = None, group: int = GROUP) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, kept_text."""
    blocks, bits = blocks or block_count(docs), width_bits(input_bytes(docs))
    rows = as_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), blocks, F.xxhash64("doc_id", F.length("text")))
    sketch = rows.groupBy("block").applyInArrow(lambda t: _sketch(t, window, bits, group), LISTS)
    found = to_blocks(merged(sketch, blocks, bits, group), blocks)
    sent = rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(lambda a, b: _send(a, b, window, bits, group), SENT)
    told = to_blocks(smaller_elsewhere(sent, blocks, blocks, group).select("range", F.col("member").alias("block"), "bits"), blocks)
    nothing = F.lit(None).cast("binary")
    other = found.withColumn("bits", nothing).unionByName(told.withColumn("cells", nothing))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    return rows.groupBy("block").cogroup(other.groupBy("block")).applyInArrow(lambda a, b: _strip(a, b, window, bits, texts), schema)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM w WHERE len(w) >= 13),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM g),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM k) WHERE least < doc_id),
x AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS j FROM f),
v AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM w),
r AS (SELECT v.doc_id, count(x.j) AS n_removed, string_agg(v.word, ' ' ORDER BY v.j) FILTER (x.j IS NULL) AS kept FROM v LEFT JOIN x ON x.doc_id = v.doc_id AND x.j = v.j GROUP BY 1)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(r.n_removed, 0) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256 FROM w LEFT JOIN r USING (doc_id)
"""
