"""Counts of hashed keys summed over blocks of documents, range by range and level by level, and told back to the blocks.

Every block sends its distinct keys as sorted, delta-coded lists, cut at the borders of ``RANGES`` equal ranges of the
key. A group of at most ``GROUP`` blocks merges its lists of one range; if there are more groups, the merged list is cut
into ``RANGES`` finer ranges and goes to a group of groups, and so on until one group is left for each range. Its sums go
back the same way. A level's rows are ``RANGES`` for each member, so rows of every exchange grow with the input (by the
geometric series over levels), and a task never holds more than ``GROUP`` lists, each about a 128th of a block's.

Keys are uniform 64-bit hashes, so a hot item is one entry of one list, whatever its count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sketches import flags, pack, pack_planes, range_cuts, table_of, unpack, unpack_planes

BITS = 7
RANGES = 1 << BITS
GROUP = 128
SENT = "range long, grp long, member long, keys binary, counts binary"
#: Of a member's list: which keys sum to ``least`` or more; of these the sums, and which this member is the first to hold.
TOLD = "range long, grp long, member long, n int, often binary, sums binary, own binary"


def exchanged_rows(members: int, group: int = GROUP) -> int:
    """The most rows that all levels' exchanges up can have; as many come back."""
    ranges, rows = RANGES, RANGES * members
    while members > group:
        members, ranges = -(-members // group), ranges * RANGES
        rows += ranges * members
    return rows


def sent_rows(member: int, keys: np.ndarray, counts: np.ndarray, group: int = GROUP) -> pa.Table:
    """A block's lists; ``keys`` sorted."""
    return table_of(SENT, _cut(member, 0, 64, keys, counts, group))


def _cut(member: int, prefix: int, width: int, keys: np.ndarray, counts: np.ndarray, group: int) -> list[tuple]:
    """Rows of ``keys`` of ``width`` bits, dealt to the ranges below ``prefix``."""
    cuts, out = range_cuts(keys, width, BITS), []
    for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a < b:
            out.append(((prefix << BITS) + r, member // group, member, pack(keys[a:b] - np.uint64(r << (width - BITS))), pack_planes(counts[a:b].astype(np.uint64))))
    return out


class _Merged:
    """Lists of several members merged: distinct ``keys`` with their ``sums``; of every entry its distinct key and whether its member is the first there."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("member")
        self.rows = [table[n].to_pylist() for n in ("range", "grp", "member")]
        lists = [unpack(x.as_py()) for x in table["keys"]]
        self.sizes = [len(x) for x in lists]
        keys = np.concatenate(lists)
        counts = np.concatenate([unpack_planes(x.as_py()) for x in table["counts"]]).astype(np.int64)
        order = np.argsort(keys, kind="stable")  # merges the sorted lists; a key's first member comes first
        merged = keys[order]
        first = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        self.keys, self.sums = merged[first], np.add.reduceat(counts[order], first)
        self.run, self.first = np.empty(len(order), np.int64), np.zeros(len(order), bool)
        self.run[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(order)))
        self.first[order[first]] = True

    def tell(self, often: np.ndarray, sums: np.ndarray, own: np.ndarray) -> pa.Table:
        """What each member is told, from what holds of the distinct keys."""
        out, at = [], 0
        for r, g, m, n in zip(*self.rows, self.sizes, strict=True):
            run, first = self.run[at : at + n], self.first[at : at + n]
            hit = often[run]
            out.append((r, g, m, n, np.packbits(hit).tobytes(), pack_planes(sums[run[hit]].astype(np.uint64)), np.packbits(own[run[hit]] & first[hit]).tobytes()))
            at += n
        return table_of(TOLD, out)


def _top(table: pa.Table, least: int) -> pa.Table:
    m = _Merged(table)
    return m.tell(m.sums >= least, m.sums, np.ones(len(m.keys), bool))


def _up(table: pa.Table, width: int, group: int) -> pa.Table:
    m = _Merged(table)
    return table_of(SENT, _cut(m.rows[1][0], m.rows[0][0], width, m.keys, m.sums, group))


def read_told(table: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(range, often, sums, own) of each row in order of ranges; sums are 0 and own is false where a key isn't often."""
    out = []
    for row in table.sort_by("range").to_pylist():
        often = flags(row["often"], row["n"])
        sums, own = np.zeros(len(often), np.int64), np.zeros(len(often), bool)
        sums[often] = unpack_planes(row["sums"]).astype(np.int64)
        own[often] = flags(row["own"], int(often.sum()))
        out.append((row["range"], often, sums, own))
    return out


def _down(sent: pa.Table, told: pa.Table) -> pa.Table:
    if not sent.num_rows:
        return table_of(TOLD, [])
    m = _Merged(sent)
    _, often, sums, own = zip(*read_told(told.drop_columns("range").rename_columns({"sub": "range"})), strict=True)
    return m.tell(np.concatenate(often), np.concatenate(sums), np.concatenate(own))


def summed(sent: DataFrame, members: int, least: int, group: int = GROUP, level: int = 0) -> DataFrame:
    """What each member is told (``TOLD``) of the keys it sent (``SENT``); members are numbered from 0."""
    groups = -(-members // group)
    parts = max(8, -(-min(members, group) * groups // 4))
    sent = sent.repartition(parts, "range", "grp")
    if groups == 1:
        return sent.groupBy("range", "grp").applyInArrow(lambda t: _top(t, least), TOLD)
    width = 64 - BITS * (level + 1)
    joined = sent.groupBy("range", "grp").applyInArrow(lambda t: _up(t, width, group), SENT)
    told = summed(joined, groups, least, group, level + 1)
    told = told.select(F.shiftright("range", BITS).alias("range"), F.col("member").alias("grp"), F.col("range").alias("sub"), "n", "often", "sums", "own")
    told = told.repartition(parts, "range", "grp")
    return sent.groupBy("range", "grp").cogroup(told.groupBy("range", "grp")).applyInArrow(_down, TOLD)
