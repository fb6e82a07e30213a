"""Token-id shard files compressed by Re-Pair grammars, with random access.

Documents are range-partitioned and sorted by doc_id; each task cuts its run into shards of about ``SHARD_TOKENS``
ids. In a shard, frequent adjacent id pairs are replaced by new nonterminals, round after round, until no pair occurs
``FREQUENT`` times. A round replaces many pairs at once: taken in order of frequency, a pair joins the round only if no
symbol would be a left part of one pair and a right part of another, so occurrences cannot overlap and the result
equals replacing them one after the other. A pair that was not frequent cannot become so, therefore a round only looks
at the places whose pair was frequent before and at those beside a replacement. Pairs never cross a document's end.

A shard file holds the rules, every rule's expansion length (for random access), the compressed sequence and an index
of the documents: their ids, which of these are null, and numbers of ids. Shards are kept as binary cells of a table, one per row, so any store
that Spark can write will do.

Defined cases: null text is empty (its end id alone remains); an empty table gives an empty result; rows with equal
doc_id keep all, in text order; a null doc_id sorts first; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import block_count, stored
from .tokens import encoder
from .words import text_bytes

TOKENIZER = "word_bpe_49k.json"
END = 1
SHARD_TOKENS = 1 << 20
#: Occurrences from which a rule is worth its entry.
FREQUENT = 12
MAGIC = b"RPG3"
#: Magic, vocabulary, rules, symbols, documents, bytes of a symbol, ids.
HEAD = struct.Struct("<4sIIIIIQ")
#: Stands for a null doc_id in a file's index; a bit for each document tells it from the number.
NONE = -(2**63)
_BITS = 21


def _alternate(active: np.ndarray, follow: np.ndarray, same: np.ndarray) -> np.ndarray:
    """In a run of one symbol, every other pair."""
    apart = np.ones(len(active), bool)
    at = np.flatnonzero(same)
    if len(at):
        joined = np.zeros(len(at), bool)
        joined[1:] = (at[1:] == at[:-1] + 1) & (follow[at[:-1]] == active[at[1:]])
        begin = np.flatnonzero(~joined)
        place = np.arange(len(at)) - np.repeat(begin, np.diff(begin, append=len(at)))
        apart[at] = place % 2 == 0
    return apart


def compress(ids: np.ndarray, end: int, vocabulary: int, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The sequence with frequent pairs replaced until none is left, and the rules: rule r expands symbol vocabulary + r to its pair."""
    n = len(ids)
    sym = np.append(ids.astype(np.uint32), np.uint32(end))  # what follows the last symbol is an end
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    dead = np.zeros(n + 1, bool)
    rules: list[np.ndarray] = []
    base, active = vocabulary, np.arange(n, dtype=np.int32)
    while len(active):
        follow = after[active]
        left, right = sym[active], sym[follow]
        live = (left != end) & (right != end)
        active, follow, left, right = active[live], follow[live], left[live], right[live]
        wide = base >= 65536
        kind, shift = (np.uint64, 32) if wide else (np.uint32, 16)  # symbols below 65536 leave a pair in 32 bits
        odd, down, low = kind(0x9E3779B97F4A7C15 if wide else 0x9E3779B1), kind((64 if wide else 32) - _BITS), kind((1 << shift) - 1)
        code = (left.astype(kind, copy=False) << kind(shift)) | right
        spot = (code * odd) >> down
        apart = _alternate(active, follow, left == right)
        common = np.bincount(spot[apart], minlength=1 << _BITS)[spot] >= frequent
        active, follow, code, spot, apart = (x[common] for x in (active, follow, code, spot, apart))
        some = np.sort(code[apart])
        new = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1], [True]])) if len(some) else np.zeros(1, np.int64)
        counts, pairs = np.diff(new), some[new[:-1]]
        keep = counts >= frequent
        pairs = pairs[keep][np.argsort(-counts[keep], kind="stable")]
        room = len(pairs) if wide else 65536 - base
        lefts, rights, chosen = set(), set(), []
        for pair, a, b in zip(pairs.tolist(), (pairs >> kind(shift)).tolist(), (pairs & low).tolist(), strict=True):
            if a in rights or b in lefts:
                continue
            if len(chosen) >= room:
                break
            lefts.add(a)
            rights.add(b)
            chosen.append(pair)
        if not chosen:
            break
        picked = np.array(chosen, kind)
        at = (picked * odd) >> down
        _, first = np.unique(at, return_index=True)  # two pairs that share a slot: the more frequent one, the other in the next round
        first.sort()
        picked, at = picked[first], at[first]
        slot = np.zeros(1 << _BITS, np.uint16 if len(at) < 65535 else np.uint32)
        slot[at] = np.arange(1, len(at) + 1)
        mine = slot[spot]
        where = np.flatnonzero((mine > 0) & apart)
        which = mine[where].astype(np.int64) - 1
        fits = picked[which] == code[where]
        where, which = where[fits], which[fits]
        place, gone = active[where], follow[where]
        sym[place] = (base + which).astype(np.uint32)
        dead[gone] = True
        beyond = after[gone]
        after[place] = beyond
        before[beyond] = place
        beside = before[place]
        moved = np.concatenate([active, beside[beside >= 0]])
        if len(moved) > n >> 4:
            marked = np.zeros(n + 1, bool)
            marked[moved] = True
            active = np.flatnonzero(marked & ~dead).astype(np.int32)
        else:
            active = np.unique(moved)
            active = active[~dead[active]]
        rules.append(np.stack([picked >> kind(shift), picked & low], 1).astype(np.uint32))
        base += len(picked)
    return sym[:n][~dead[:n]], np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def write_shard(doc_ids: list, ids: list[bytes], end: int, vocabulary: int) -> bytes:
    """A shard file of these documents; ``ids`` holds each one's ids, closed by ``end``."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    seq, rules = compress(flat, end, vocabulary)
    sizes = [1] * vocabulary
    for a, b in rules.tolist():
        sizes.append(sizes[a] + sizes[b])
    width = 2 if not len(seq) or int(seq.max()) < 65536 else 4
    head = HEAD.pack(MAGIC, vocabulary, len(rules), len(seq), len(doc_ids), width, len(flat))
    nulls = np.packbits(np.array([d is None for d in doc_ids], bool)).tobytes()
    index = np.array([NONE if d is None else d for d in doc_ids], "<i8").tobytes() + nulls + np.array([len(x) // 4 for x in ids], "<u4").tobytes()
    return b"".join([head, index, rules.astype("<u4").tobytes(), np.array(sizes[vocabulary:], "<u4").tobytes(), seq.astype(f"<u{width}").tobytes()])


class Shard:
    """A shard file's parts; ``ids`` decodes any range of its ids without decoding the rest."""

    def __init__(self, raw: bytes):
        magic, self.vocabulary, n_rules, n_seq, n_docs, width, self.n_ids = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a shard file")
        at = HEAD.size

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids = part("<i8", n_docs)
        self.nulls = np.unpackbits(part("u1", -(-n_docs // 8)), count=n_docs).astype(bool)
        self.counts = part("<u4", n_docs)
        self.rules, self.sizes = part("<u4", 2 * n_rules).reshape(-1, 2), part("<u4", n_rules)
        self.seq = part(f"<u{width}", n_seq)
        self._starts: np.ndarray | None = None

    def all(self) -> np.ndarray:
        """Every id of the shard."""
        made: list[bytes] = []
        one = lambda s: made[s - self.vocabulary] if s >= self.vocabulary else s.to_bytes(4, "little")
        for a, b in self.rules.tolist():
            made.append(one(a) + one(b))
        table = np.concatenate([np.arange(self.vocabulary, dtype="<u4"), np.frombuffer(b"".join(made), "<u4")])
        size = np.concatenate([np.ones(self.vocabulary, np.int64), self.sizes.astype(np.int64)])
        first = np.concatenate([np.arange(self.vocabulary), self.vocabulary + np.cumsum(self.sizes, dtype=np.int64) - self.sizes])
        n = size[self.seq]
        ends = np.cumsum(n)
        return table[np.repeat(first[self.seq] - (ends - n), n) + np.arange(int(n.sum()))]

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids start .. start + n - 1 of the shard."""
        if self._starts is None:
            sizes = np.concatenate([np.ones(self.vocabulary, np.int64), self.sizes.astype(np.int64)])
            self._starts = np.concatenate([[0], np.cumsum(sizes[self.seq])])
        a = int(np.searchsorted(self._starts, start, "right")) - 1
        b = int(np.searchsorted(self._starts, start + n, "left"))
        skip = start - int(self._starts[a])
        out: list[int] = []
        stack = self.seq[a:b][::-1].tolist()
        while stack and len(out) < skip + n:
            s = stack.pop()
            if s < self.vocabulary:
                out.append(s)
            else:
                left, right = self.rules[s - self.vocabulary].tolist()
                stack += [right, left]
        return np.array(out[skip : skip + n], np.uint32)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, by random access."""
        return self.ids(int(self.counts[:i].sum()), int(self.counts[i]))


def _shards(batches: Iterator[pa.RecordBatch], tokenizer: str, end: int) -> Iterator[pa.RecordBatch]:
    enc, tail = encoder(tokenizer), np.array([end], "<u4").tobytes()
    vocabulary = enc.full.get_vocab_size()
    part = TaskContext.get().partitionId()
    number, docs, parts, size = 0, [], [], 0

    def cut() -> pa.RecordBatch:
        nonlocal number, docs, parts, size
        raw = write_shard(docs, parts, end, vocabulary)
        out = pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([raw], pa.binary())], ["part", "number", "file"])
        number, docs, parts, size = number + 1, [], [], 0
        return out

    for batch in batches:
        flat, first = enc.encode(*text_bytes(batch.column(1)))
        flat = flat.astype("<u4", copy=False)
        for i, doc in enumerate(batch.column(0).to_pylist()):
            ids = flat[first[i] : first[i + 1]].tobytes() + tail
            docs.append(doc)
            parts.append(ids)
            size += len(ids)
            if size >= 4 * SHARD_TOKENS:
                yield cut()
    if docs:
        yield cut()


def encode_shards(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """The shard table, written to the shared folder: part and number (their order is doc_id order) and file."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = rows.repartitionByRange(block_count(docs, 8 << 20), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return stored(ranged.mapInArrow(lambda it: _shards(it, tokenizer, end), "part long, number long, file binary"), "shards")


def file_ids(raw: bytes) -> int:
    """The number of ids that a file's head tells."""
    return HEAD.unpack_from(raw)[-1]


def shard_sizes(shards: DataFrame) -> DataFrame:
    """part, number and n_ids of each file, from its head."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [file_ids(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["part", "number", "n_ids"])

    return shards.select("part", "number", F.substring("file", 1, HEAD.size).alias("file")).mapInArrow(read, "part long, number long, n_ids long")


def shard_starts(sizes: DataFrame) -> DataFrame:
    """part, number, first: ids in all earlier shards. Sums meet per part; only part totals are in one window."""
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inner = Window.partitionBy("part").orderBy("number")
    own = sizes.select("part", "number", (F.sum("n_ids").over(inner) - F.col("n_ids")).alias("own"))
    return own.join(before, "part").select("part", "number", (F.col("own") + F.col("before")).alias("first"))


def decode_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(batch.column(2)[row].as_py())
                ids, counts = shard.all().tobytes(), shard.counts.astype(np.int64)
                ends, n = np.cumsum(counts), len(counts)
                crcs = [zlib.crc32(ids[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                same = lambda x: pa.array([x] * n, pa.int64())  # noqa: B023, E731
                docs = pa.array(shard.doc_ids.astype(np.int64), pa.int64(), mask=shard.nulls)
                yield pa.RecordBatch.from_arrays([same(batch.column(0)[row].as_py()), same(batch.column(1)[row].as_py()), docs, pa.array(ends - counts), pa.array(counts), pa.array(crcs, pa.int64())], ["part", "number", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "number", "file").mapInArrow(read, "part long, number long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(shard_starts(shard_sizes(shards)), ["part", "number"]).select("doc_id", (F.col("at") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def compression(shards: DataFrame) -> DataFrame:
    """n_ids, file_bytes and ratio (of four bytes an id) over all shards."""
    sizes = shard_sizes(shards).agg(F.sum("n_ids").alias("n_ids"))
    return shards.agg(F.sum(F.length("file")).alias("file_bytes")).join(sizes).select("n_ids", "file_bytes", (F.col("n_ids") * 4 / F.col("file_bytes")).alias("ratio"))
