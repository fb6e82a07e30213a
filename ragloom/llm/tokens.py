"""Token ids of whole texts by a public tokenizer file, whole Arrow batches at a time.

The tokenizer drops white space and never joins across it, so a text's ids are the ids of its white-space separated
chunks in order. Chunks of printable ASCII and Latin-1 letters are cut into pieces by the rule of the file's own
pattern, with NumPy over the bytes, and a piece that the worker has not met is handed to the library's model; every
other chunk goes whole through the library's full encoder. Ids of pieces met before are found by two independent
64-bit hashes in a bounded table; when it is full, pieces not met again since they came are dropped.
"""

from __future__ import annotations

import sys
from array import array
from functools import cache

import numpy as np

from .common import enter, keeps
from .words import _SEEDS, SPACES, _hashed, _spans

#: log2 of the table's slots; it is full at two thirds.
SLOTS = 20
#: Bytes of text that one pass takes, and more only for one long document.
SLICE = 2 << 20
_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_ONE, _TWO = b"stmd", (b"re", b"ve", b"ll")


def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(256, _ODD, np.uint8)
    kind[33:127] = _SIGN
    kind[48:58] = _DIGIT
    kind[65:91] = kind[97:123] = _LETTER
    kind[SPACES] = _SPACE
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return kind, low


_KIND, _LOW = _classes()


def packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _byte_level() -> dict[int, str]:
    """The usual printable stand-ins of byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all pieces, which of them are whole chunks for the full encoder, and the lower-cased bytes.

    A piece is a run of letters, one digit, a run of signs, or an apostrophe with one of the usual contractions.
    """
    n = len(data)
    kind, low = _KIND[data], _LOW[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if n else np.zeros(0, np.int64)
    if len(lead):  # Latin-1 letters, two bytes each
        second = data[lead + 1]
        letter = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
        lead, second = lead[letter], second[letter]
        kind[lead] = kind[lead + 1] = _LETTER
        upper = lead[second <= 0x9E] + 1
        low[upper] += 0x20
    chunk, stop = _spans(data, offsets, SPACES)
    odd = np.flatnonzero(kind == _ODD)
    marks = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|"))) if n else odd
    whole = np.unique(np.searchsorted(chunk, np.concatenate([odd, marks]), "right") - 1)
    opens = np.empty(n, bool)
    if n:
        opens[0], opens[1:] = True, (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        opens &= kind != _SPACE
    opens[chunk] = True
    near = np.concatenate([low, np.zeros(3, np.uint8)])
    quote = np.flatnonzero((data == 0x27) & opens)
    if len(quote):
        end = stop[np.searchsorted(chunk, quote, "right") - 1]
        one = np.isin(near[quote + 1], np.frombuffer(_ONE, np.uint8)) & (quote + 1 < end)
        two = np.zeros(len(quote), bool)
        for a, b in _TWO:
            two |= (near[quote + 1] == a) & (near[quote + 2] == b) & (quote + 2 < end)
        for which, size in ((one, 2), (two & ~one, 3)):
            at, rest = quote[which], end[which]
            opens[at + 1] = False
            more = at[at + size < rest] + size
            opens[more] |= kind[more] == _LETTER
    if len(whole):
        inside = np.zeros(n + 1, np.int32)
        inside[chunk[whole]] += 1
        inside[stop[whole]] -= 1
        opens &= np.cumsum(inside)[:-1] == 0
        opens[chunk[whole]] = True
    start = np.flatnonzero(opens)
    own = np.searchsorted(chunk, start, "right") - 1
    end = np.minimum(np.append(start[1:], n), stop[own]) if len(start) else start
    full = np.zeros(len(chunk), bool)
    full[whole] = True
    return start, end, full[own], low


class Table:
    """Ids by two hashes of a piece: open addressing over NumPy arrays."""

    def __init__(self, slots: int = SLOTS):
        self.slots = slots
        self.clear()

    def clear(self, least: int = 0) -> None:
        """An empty table; a larger one if one slice of text brings over half its slots."""
        n = 1 << max(self.slots, (2 * least).bit_length())
        self.mask = np.uint64(n - 1)
        self.one, self.two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.first, self.size, self.met = np.full(n, -1, np.int64), np.zeros(n, np.int32), np.zeros(n, bool)
        self.count, self.used, self.ids = 0, 0, np.zeros(1 << 16, np.uint32)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Slots of the pieces, -1 for those not met."""
        out, slot = np.full(len(one), -1, np.int64), (one & self.mask).astype(np.int64)
        live = np.arange(len(one))
        while len(live):
            at = slot[live]
            there = self.first[at] >= 0
            hit = there & (self.one[at] == one[live]) & (self.two[at] == two[live])
            out[live[hit]] = at[hit]
            live = live[there & ~hit]
            slot[live] = (slot[live] + 1) & int(self.mask)
        return out

    def add(self, one: np.ndarray, two: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        """New pieces, each once; ``first`` and ``size`` are places in ``ids``."""
        slot, live = (one & self.mask).astype(np.int64), np.arange(len(one))
        while len(live):
            free = live[self.first[slot[live]] < 0]
            _, which = np.unique(slot[free], return_index=True)
            put = free[which]
            at = slot[put]
            self.one[at], self.two[at], self.first[at], self.size[at], self.met[at] = one[put], two[put], first[put], size[put], False
            left = np.ones(len(one), bool)
            left[put] = False
            live = live[left[live]]
            slot[live] = np.where(self.first[slot[live]] >= 0, (slot[live] + 1) & int(self.mask), slot[live])
        self.count += len(one)

    def crowded(self, more: int) -> bool:
        return self.count + more > 2 * (int(self.mask) + 1) // 3

    def make_room(self, need: int) -> None:
        """Drops pieces not met again, all if need be: then there is room for ``need`` pieces, among which may be dropped ones."""
        keep = np.flatnonzero(self.met & (self.first >= 0))
        if len(keep) + need > (int(self.mask) + 1) // 2:
            keep = keep[:0]
        old, size = (self.one[keep], self.two[keep]), self.size[keep].astype(np.int64)
        flat = self.ids[np.repeat(self.first[keep] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        self.clear(need)
        self._store(*old, flat, size)

    def learn(self, one: np.ndarray, two: np.ndarray, found: list[bytes]) -> None:
        """Keeps these pieces' ids (little-endian unsigned 32-bit), for which there is room."""
        size = np.array([len(x) // 4 for x in found], np.int64)
        self._store(one, two, np.frombuffer(b"".join(found), "<u4"), size)

    def _store(self, one: np.ndarray, two: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.add(one, two, self.used + np.cumsum(size) - size, size)
        self.used += len(flat)


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.model, self.byte, self.table = self.full.model, _byte_level(), Table()

    def _piece(self, raw: bytes) -> bytes:
        mapped = raw.decode() if raw.isascii() else "".join(map(self.byte.__getitem__, raw))
        return packed([t.id for t in self.model.tokenize(mapped)])

    def _chunk(self, raw: bytes) -> bytes:
        return packed(self.full.encode(raw.decode(), add_special_tokens=False).ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and where each text's begin (n + 1)."""
        parts, counts, i = [], [np.zeros(1, np.int64)], 0
        while i < len(offsets) - 1:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
            flat, first = self._slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            parts.append(flat)
            counts.append(np.diff(first))
            i = j
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.cumsum(np.concatenate(counts))

    @staticmethod
    def _missing(one: np.ndarray, two: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces that are not in the table, and one place of each."""
        missing = np.flatnonzero(slot < 0)
        key, new = np.unique(one[missing], return_index=True)
        new = missing[new]
        again = missing[two[missing] != two[new[np.searchsorted(key, one[missing])]]]
        if len(again):  # first hashes that two pieces share
            new = missing[np.unique(np.stack([one[missing], two[missing]], 1), axis=0, return_index=True)[1]]
        return missing, new

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end, full, low = pieces(data, offsets)
        one, two = (_hashed(low, start, end, seed) for seed in _SEEDS)
        odd = np.flatnonzero(full)
        if len(odd):  # these count as they are written, and apart from pieces
            one[odd], two[odd] = (~_hashed(data, start[odd], end[odd], seed) for seed in _SEEDS)
        slot = self.table.find(one, two)
        missing, new = self._missing(one, two, slot)
        if self.table.crowded(len(new)):  # what is dropped may be of this slice, so that it is looked for again
            self.table.make_room(len(new) + len(np.unique(slot[slot >= 0])))
            slot = self.table.find(one, two)
            missing, new = self._missing(one, two, slot)
        if len(new):
            found = []
            for p in new.tolist():
                found.append(self._chunk(data[start[p] : end[p]].tobytes()) if full[p] else self._piece(low[start[p] : end[p]].tobytes()))
            self.table.learn(one[new], two[new], found)
            slot[missing] = self.table.find(one[missing], two[missing])
        self.table.met[slot] = True
        if len(missing):
            self.table.met[slot[missing]] = False
        size = self.table.size[slot].astype(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.table.ids[np.repeat(self.table.first[slot] - (ends - size), size) + np.arange(total)]
        before = np.concatenate([[0], ends])
        return flat, before[np.searchsorted(start, offsets)]

    def ids(self, raw: bytes) -> bytes:
        """The ids of a whole UTF-8 text, little-endian unsigned 32-bit."""
        return self.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].astype("<u4").tobytes()

    def clear(self) -> None:
        self.table.clear()


@cache
def _loaded(name: str) -> Encoder:
    import public_tokenizers

    return Encoder(public_tokenizers.path(name) if "/" not in name else name)


def encoder(name: str) -> Encoder:
    """This worker's encoder; its table lasts until another operator begins here."""
    enter("tokens")
    found = _loaded(name)
    keeps("tokens", found.clear)
    return found
