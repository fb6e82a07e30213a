"""Sharded count-min sketches over blocks of documents.

A full-width sketch per task would grow with the corpus, so every block sends, for each sketch row, only the cells it
touched, as delta-coded sorted lists cut at the borders of ``1 << RANGE_BITS`` ranges. A group of at most ``GROUP`` blocks
merges its lists of one range (a count stops at two). If there are more groups, the merged list is cut into finer
ranges and goes to a group of groups, and so on until one group is left for each range; which cells count two or more
goes back the same way, to each member those of its own cells. A level's rows are as many for each member, so rows of
all exchanges grow with the input, not with its square.

Counts are never too small, so no repeated item is missed; a cell shared by two different items only makes a candidate
too many. Width grows with the input; no task holds more than ``GROUP`` lists, nothing is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix

ROWS = 2
RANGE_BITS = 6
GROUP = 128
LISTS = "range long, grp int, member int, cells binary, twice binary"
FOUND = "range long, grp int, member int, cells binary"


def table_of(schema: str, rows: list[tuple]) -> pa.Table:
    """Rows as an Arrow table of a schema of ints, longs and binaries."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.table({name: pa.array(col, kinds[kind]) for (name, kind), col in zip(fields, cols, strict=True)})


def width_bits(input_bytes: int) -> int:
    """log2 of the cells in a row: about eight for each word of text (compressed input holds a word in about 4 bytes)."""
    return max(27, (max(1, input_bytes) * 2 - 1).bit_length())


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (h if not row else mix(h, 100 + row)) >> np.uint64(64 - bits)


def pack(numbers: np.ndarray) -> bytes:
    """Sorted unsigned numbers: delta-coded, byte planes apart, compressed."""
    return pack_planes(np.diff(numbers.astype(np.uint64, copy=False), prepend=np.uint64(0)))


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack_planes(raw), dtype=np.uint64)


def pack_planes(numbers: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers, as many low byte planes as the largest needs."""
    n = len(numbers)
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8) if n else 1
    planes = np.ascontiguousarray(numbers.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T)
    return n.to_bytes(4, "little") + bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_planes(raw: bytes) -> np.ndarray:
    n, width = int.from_bytes(raw[:4], "little"), raw[4]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[5:], max_output_size=max(1, width * n)), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8")


def flags(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def range_cuts(sorted_numbers: np.ndarray, bits: int, parts_bits: int) -> list[int]:
    """Where each of ``1 << parts_bits`` equal ranges of ``bits``-bit numbers begins, and the end."""
    borders = np.arange(1 << parts_bits, dtype=np.uint64) << np.uint64(bits - parts_bits)
    return [*np.searchsorted(sorted_numbers, borders).tolist(), len(sorted_numbers)]


def level_parts(blocks: int, group: int = GROUP, level: int = 0) -> int:
    """Partitions of a level: no more than it has groups, nor than there are blocks."""
    groups = blocks
    for _ in range(level + 1):
        groups = -(-groups // group)
    return max(8, min(blocks, (ROWS << RANGE_BITS * (level + 1)) * groups))


def exchanged_rows(blocks: int, group: int = GROUP, rows: int = ROWS) -> int:
    """The most rows that all levels' exchanges up can have; as many come back."""
    members, ranges, total = blocks, rows << RANGE_BITS, 0
    while True:
        total += members * ranges
        if members <= group:
            return total
        members, ranges = -(-members // group), ranges << RANGE_BITS


def _unique(c: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of ``c`` once each, in order, and which of them stand twice or are among ``twice``."""
    c = np.sort(c)
    new = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
    c, again = c[new], np.diff(new, append=len(c)) > 1
    again[np.searchsorted(c, twice)] = True
    return c, again


def _cut(member: int, prefix: int, width: int, group: int, c: np.ndarray, twice: np.ndarray) -> list[tuple]:
    """Rows of cells of ``width`` bits, dealt to the ranges below ``prefix``."""
    cuts, out = range_cuts(c, width, RANGE_BITS), []
    for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a < b:
            out.append(((prefix << RANGE_BITS) + r, member // group, member, pack(c[a:b] - np.uint64(r << (width - RANGE_BITS))), np.packbits(twice[a:b]).tobytes()))
    return out


def partition_sketch(block: int, h: np.ndarray, bits: int, group: int = GROUP) -> pa.Table:
    """A block's lists; an item that stands in ``h`` twice counts as repeated."""
    none = np.zeros(0, np.uint64)
    return table_of(LISTS, [x for row in range(ROWS) for x in _cut(block, row, bits, group, *_unique(cells(h, row, bits), none))])


class _Lists:
    """Lists of several members, and their cells merged."""

    def __init__(self, table: pa.Table):
        self.rows = [table[n].to_pylist() for n in ("range", "grp", "member")]
        self.lists = [unpack(x.as_py()) for x in table["cells"]]
        again = [c[flags(x.as_py(), len(c))] for c, x in zip(self.lists, table["twice"], strict=True)]
        self.cells, self.twice = _unique(np.concatenate(self.lists), np.concatenate(again))

    def tell(self, known: np.ndarray) -> pa.Table:
        """Each member's own cells among the sorted ``known`` ones."""
        out = []
        for r, g, m, c in zip(*self.rows, self.lists, strict=True):
            at = np.searchsorted(known, c)
            hit = at < len(known)
            hit[hit] = known[at[hit]] == c[hit]
            if hit.any():
                out.append((r, g, m, pack(c[hit])))
        return table_of(FOUND, out)


def _top(table: pa.Table) -> pa.Table:
    m = _Lists(table)
    return m.tell(m.cells[m.twice])


def _up(table: pa.Table, width: int, group: int) -> pa.Table:
    m = _Lists(table)
    return table_of(LISTS, _cut(m.rows[1][0], m.rows[0][0], width, group, m.cells, m.twice))


def _down(sent: pa.Table, found: pa.Table, width: int) -> pa.Table:
    """A group's members are told what the group was, range by finer range."""
    if not sent.num_rows or not found.num_rows:
        return table_of(FOUND, [])
    mask = (1 << RANGE_BITS) - 1
    parts = sorted(zip(found["sub"].to_pylist(), (x.as_py() for x in found["cells"]), strict=True))
    return _Lists(sent).tell(np.concatenate([unpack(raw) + np.uint64((s & mask) << (width - RANGE_BITS)) for s, raw in parts]))


def merged(lists: DataFrame, blocks: int, bits: int, group: int = GROUP) -> DataFrame:
    """range, block and the block's cells whose merged count is two or more."""
    return _merged(lists, blocks, blocks, bits, group, 0).select("range", F.col("member").alias("block"), "cells")


def _merged(lists: DataFrame, members: int, blocks: int, bits: int, group: int, level: int) -> DataFrame:
    parts, groups = level_parts(blocks, group, level), -(-members // group)
    lists = lists.repartition(parts, "range", "grp")
    if groups == 1:
        return lists.groupBy("range", "grp").applyInArrow(_top, FOUND)
    width = bits - RANGE_BITS * (level + 1)
    found = _merged(lists.groupBy("range", "grp").applyInArrow(lambda t: _up(t, width, group), LISTS), groups, blocks, bits, group, level + 1)
    found = found.select(F.shiftright("range", RANGE_BITS).alias("range"), F.col("member").alias("grp"), F.col("range").alias("sub"), "cells").repartition(parts, "range", "grp")
    return lists.groupBy("range", "grp").cogroup(found.groupBy("range", "grp")).applyInArrow(lambda a, b: _down(a, b, width), FOUND)


#: Bits of the table a block looks its own cells up in; a clash only makes a candidate too many.
_LOOK_BITS = 23


class Repeated:
    """Which of a block's items may be repeated."""

    def __init__(self, table: pa.Table, bits: int):
        self.bits, self.seen = bits, np.zeros((ROWS, 1 << _LOOK_BITS), bool)
        for r, raw in zip(table["range"].to_pylist(), table["cells"], strict=True):
            row, low = r >> RANGE_BITS, (r & ((1 << RANGE_BITS) - 1)) << (bits - RANGE_BITS)
            c = unpack(raw.as_py()) + np.uint64(low)
            self.seen[row, (c & np.uint64((1 << _LOOK_BITS) - 1)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        low = np.uint64((1 << _LOOK_BITS) - 1)
        hit = self.seen[0][(cells(h, 0, self.bits) & low).astype(np.int64)]
        for row in range(1, ROWS):
            some = np.flatnonzero(hit)
            hit[some] = self.seen[row][(cells(h[some], row, self.bits) & low).astype(np.int64)]
        return hit
