"""Word and window hashes of whole Arrow batches, computed with NumPy over the UTF-8 bytes.

Words are maximal runs of bytes other than space and 0x09-0x0D. A word's hash takes its bytes eight at a time: the
state, which begins with the length, is xored with them and put through a bijective mixer. Words of up to eight bytes
and equal length thus never share a hash, longer ones only by chance; words over ``LONGEST`` bytes take BLAKE2b. A
second hash from another seed is independent of the first. A window's hash joins its words' hashes two by two through
the same mixer. No Python object is made per word (but for those over ``LONGEST``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes, and words, that one pass takes at a time.
CHUNK = 1 << 20
SLICE = 1 << 18
LONGEST = 512
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ONE, _LAST = np.uint64(1), np.uint64(63)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % 2**64)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash for a followed by b."""
    x = a * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x += b
    return mix(x)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and n + 1 offsets into them; a null counts as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.string())
    if arr.null_count:
        arr = arr.fill_null("")
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(arr.buffers()[1], kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if arr.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of a batch: byte spans ``start``/``end``, 64-bit ``hash``, and each document's first word ``first`` (n + 1)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, breaks: np.ndarray = SPACES):
        self.start, self.end = _spans(data, offsets, breaks)
        self.first = np.searchsorted(self.start, offsets)
        self._data = _LOWER[data] if lower else data
        self._hashes: dict[int, np.ndarray] = {}

    def hashes(self, which: int = 0) -> np.ndarray:
        """One of two independent hashes of every word."""
        if which not in self._hashes:
            self._hashes[which] = _hashed(self._data, self.start, self.end, _SEEDS[which])
        return self._hashes[which]

    @property
    def hash(self) -> np.ndarray:
        return self.hashes(0)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each window start, and these starts; none cross documents."""
        words = len(self.start)
        n = words - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        inside = np.ones(n, bool)
        for back in range(1, k):  # a window may not start in the last k - 1 words of a document
            at = self.first[1:] - back
            inside[at[(at >= self.first[:-1]) & (at < n)]] = False
        level, size, out, covered = self.hashes(which), 1, None, 0
        while True:  # level: of size words; out: of the last `covered` words of a window
            if k & size:
                m = words - size - covered + 1
                out = level if out is None else pair(level[:m], out[size : size + m])
                covered += size
            if 2 * size > k:
                break
            m = words - 2 * size + 1
            level, size = pair(level[:m], level[size : size + m]), 2 * size
        return out[inside], np.flatnonzero(inside)

    def whole(self, docs: np.ndarray, which: int = 0) -> np.ndarray:
        """One hash for each of these documents' whole word sequence, unlike any window's hash of the same words."""
        a, n = self.first[docs], self.first[docs + 1] - self.first[docs]
        ends = np.cumsum(n)
        place = np.arange(int(n.sum())) - np.repeat(ends - n, n)
        terms = mix(self.hashes(which)[np.repeat(a, n) + place] ^ mix(place.astype(np.uint64), 5))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
        return mix((total[ends] - total[ends - n]) ^ mix(n.astype(np.uint64), 9), 11)


def _spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; a document's end also ends a word."""
    starts, ends, held = [], [], False
    for at in range(0, len(data), CHUNK):
        to = min(at + CHUNK, len(data))
        word = ~breaks[data[at:to]]
        before = np.empty_like(word)
        before[0], before[1:] = held, word[:-1]
        held = bool(word[-1])
        cut = np.zeros(len(word), bool)
        cut[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at] = True
        starts.append(np.flatnonzero(word & (~before | cut)) + at)
        ends.append(np.flatnonzero(before & (~word | cut)) + at)
    if held:
        ends.append(np.array([len(data)]))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(starts), join(ends)


def _hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.uint64) -> np.ndarray:
    padded = np.zeros((len(data) + 23) // 8 * 8, np.uint8)
    padded[: len(data)] = data
    words = padded.view("<u8")

    def lane(at: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """The next eight bytes from ``at``, of which only ``rest`` count."""
        k, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        out = words[k] >> shift
        out |= (words[k + 1] << _ONE) << (_LAST - shift)
        out &= _MASKS[np.minimum(rest, 8)]
        return out

    out = np.empty(len(start), np.uint64)
    for lo in range(0, len(start), SLICE):
        at = start[lo : lo + SLICE]
        size = end[lo : lo + SLICE] - at
        h = mix(mix(size.astype(np.uint64) ^ seed) ^ lane(at, size))
        done, live = 8, np.flatnonzero((size > 8) & (size <= LONGEST))
        while len(live):
            h[live] = mix(h[live] ^ lane(at[live] + done, size[live] - done))
            done += 8
            live = live[size[live] > done]
        for i in np.flatnonzero(size > LONGEST).tolist():
            raw = data[at[i] : at[i] + size[i]].tobytes()
            h[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, key=seed.tobytes()).digest(), "little")
        out[lo : lo + SLICE] = h
    return out


def slices(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold at most ``limit`` bytes together; a longer text is a run of its own."""
    ends = text_bytes(batch.column(column))[1][1:]
    at, before = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at, before = to, int(ends[to - 1])


def repeats(doc: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal items (document and both hashes) are neighbours, and which of them equal the one before."""
    order = np.argsort(h1 ^ mix(doc.astype(np.uint64), 3), kind="stable")
    same = lambda x: x[order][1:] == x[order][:-1]
    again = same(h1 ^ mix(doc.astype(np.uint64), 3))
    if (again & ~(same(doc) & same(h1) & same(h2))).any():  # different items that share a key
        order = np.lexsort((h2, h1, doc))
    again = same(doc) & same(h1) & same(h2)
    return order, np.concatenate([[False], again]) if len(order) else np.zeros(0, bool)
