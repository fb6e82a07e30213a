"""Vector bin packing of tokenised examples into fixed-length training sequences.

Each sequence has three limits at once: tokens, segments and loss-bearing tokens. Sequences are filled one at a time
by the dot-product heuristic: of the examples that fit, the one whose demand vector has the largest weighted dot
product with what is left in the sequence goes in next. Examples of equal demand are one kind, and only kinds are
compared; of a kind with several examples half of those that fit go in at once. When none fits whole, one is cut to
fill the gap; so is one that bears nothing but loss, when the best that fits bears none and the sequence has less than
the pool's share of loss, lest the pool run out of what bears none. An example longer than a sequence is first cut into pieces of its prompt and pieces of its rest in such
lengths that one of each fill a sequence, so that its prompt doesn't end before its rest does.

An example's first tokens are its prompt and bear no loss: a column says how many, else ``PROMPT`` of its tokens.

Packing runs inside each input partition over pools of about ``POOL`` tokens, with no shuffle; leftovers move on to
the next pool, and so does what would go into a sequence that a limit keeps from being full, until ``HELD`` tokens wait.
Only then, and at a task's end, tokens of such a sequence are dealt to sequences whose lengths are powers of two, which
need no padding. Sequence ids are the partition number and a count, so a task that runs again gives the same ids.

Defined cases: null text is empty (its end id alone remains); an empty table gives an empty result; repeated rows are
separate examples; a null doc_id is passed through; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder
from .words import text_bytes

TOKENIZER = "word_bpe_49k.json"
LENGTH = 4096
SEGMENTS = 2048
#: Most loss-bearing tokens of a sequence, and the share of an example that is its prompt.
LOSS = 3328
PROMPT = 0.25
POOL = 1 << 19
HELD = 4 * POOL
END = 2


def pieces(tokens: int, prompt: int, length: int, loss: int) -> list[tuple[int, int]]:
    """(start, size) of the pieces that an example is cut into beforehand."""
    if tokens <= length:
        return [(0, tokens)]
    prompt = min(max(0, prompt), tokens)
    rest = max(1, min(loss, round(length * (tokens - prompt) / tokens)))
    cut = lambda a, b, size: [(x, min(size, b - x)) for x in range(a, b, size)]
    return cut(0, prompt, max(1, length - rest)) + cut(prompt, tokens, rest)


class Packer:
    """Open examples by kind and the sequences made of them. An example is (key, tokens, prompt): prompt tokens bear no loss."""

    def __init__(self, length: int = LENGTH, segments: int = SEGMENTS, loss: int | None = None, held: int = HELD):
        self.held = held
        self.length, self.segments, self.loss = length, segments, loss or length
        self.caps = np.array([length, segments, self.loss], float)
        self.kinds: dict[tuple[int, int], list[tuple]] = {}  # (tokens, loss tokens): (key, start, prompt) of each
        self.tokens = 0
        self.done: list[list[tuple]] = []  # sequences of (key, start, length)

    def add(self, key, tokens: int, prompt: int = 0) -> None:
        self.tokens += tokens
        for start, size in pieces(tokens, prompt, self.length, self.loss):
            self._keep(key, start, size, prompt)

    def _keep(self, key, start: int, size: int, prompt: int) -> tuple[int, int]:
        kind = (size, size - min(size, max(0, prompt - start)))
        self.kinds.setdefault(kind, []).append((key, start, prompt))
        return kind

    def open(self) -> set:
        return {x[0] for kind, some in self.kinds.items() if kind[0] for x in some}

    def pack(self, last: bool) -> None:
        """Makes sequences; without ``last``, stops when what is left can't fill one."""
        self.kinds = {k: v for k, v in self.kinds.items() if v and k[0]}
        self._names = list(self.kinds)
        shape = np.array(self._names, np.int64).reshape(-1, 2)
        count = np.array([len(v) for v in self.kinds.values()], np.int64)
        demand = np.array([self.tokens, count.sum(), (shape[:, 1] * count).sum()], float) / self.caps
        self._weight = demand / max(demand.sum(), 1e-9) / self.caps**2
        room = len(shape) + 64
        self._left, self._loss, self._count = (np.zeros(room, np.int64) for _ in range(3))
        self._left[: len(shape)], self._loss[: len(shape)], self._count[: len(shape)] = shape[:, 0], shape[:, 1], count
        self._place = {k: i for i, k in enumerate(self._names)}
        while self.tokens >= self.length or (last and self.tokens):
            placed = self._sequence()
            bins = [x[:3] for x in placed]
            size = sum(x[2] for x in bins)
            if size < self.length and not last and self.tokens < self.held:
                for key, start, n, prompt in placed:
                    self._keep(key, start, n, prompt)
                break
            self.tokens -= size
            self.done += [bins] if size == self.length else self._powers(bins)

    def _sequence(self) -> list[tuple]:
        bins: list[tuple] = []
        tokens, segments, loss = self.length, self.segments, self.loss
        due = self.loss - min(self.loss, -(-self.length * int((self._loss * self._count).sum()) // max(1, int((self._left * self._count).sum()))))
        while tokens and segments:
            n = len(self._names)
            left, bear, count = self._left[:n], self._loss[:n], self._count[:n]
            score = (self._weight[0] * tokens) * left + (self._weight[2] * loss) * bear
            score[(count == 0) | (left > tokens) | (bear > loss)] = -1.0
            k = int(np.argmax(score)) if n else 0
            part = np.where((count > 0) & (bear == left), np.minimum(np.minimum(left, tokens), loss - due), 0) if n and score[k] >= 0 and not bear[k] and loss > due else None
            if n and score[k] >= 0 and (part is None or not part.any()):
                size, own = int(left[k]), int(bear[k])
                many = min(int(count[k]), tokens // size, segments, loss // own if own else segments)
                for _ in range(max(1, many // 2)):
                    key, start, prompt = self._take(k)
                    bins.append((key, start, size, prompt))
                    tokens, segments, loss = tokens - size, segments - 1, loss - own
                continue
            if part is None:
                part = np.where(count > 0, np.minimum(np.minimum(left, tokens), left - bear + loss), 0)
            k = int(np.argmax(part)) if n else 0
            if not n or not part[k]:
                break
            size, whole = int(part[k]), int(left[k])
            key, start, prompt = self._take(k)
            bins.append((key, start, size, prompt))
            tokens, segments, loss = tokens - size, segments - 1, loss - (size - min(size, max(0, prompt - start)))
            if whole > size:
                self._put(self._keep(key, start + size, whole - size, prompt))
        return bins

    def _take(self, k: int) -> tuple:
        self._count[k] -= 1
        return self.kinds[self._names[k]].pop()

    def _put(self, kind: tuple[int, int]) -> None:
        k = self._place.get(kind)
        if k is None:
            k = self._place[kind] = len(self._names)
            self._names.append(kind)
            if k == len(self._left):
                self._left, self._loss, self._count = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self._left, self._loss, self._count))
            self._left[k], self._loss[k] = kind
        self._count[k] += 1

    @staticmethod
    def _powers(bins: list[tuple]) -> list[list[tuple]]:
        out, rest, total = [], list(reversed(bins)), sum(x[2] for x in bins)
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            out.append([])
            while room:
                key, start, length = rest.pop()
                take = min(room, length)
                out[-1].append((key, start, take))
                if take < length:
                    rest.append((key, start + take, length - take))
                room -= take
        return out


def _packed(batches: Iterator[pa.RecordBatch], tokenizer: str, end: int, length: int, segments: int, loss: int | None, share: float, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    enc, tail = encoder(tokenizer), np.array([end], "<u4").tobytes()
    packer, held = Packer(length, segments, loss), {}
    context = TaskContext.get()
    sequence = (context.partitionId() if context else 0) << 36
    serial = 0
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]

    def flush(last: bool) -> pa.RecordBatch | None:
        nonlocal sequence
        packer.pack(last)
        rows: list[tuple] = []
        for bins in packer.done:
            at = 0
            for key, start, size in bins:
                doc, ids, prompt = held[key]
                rows.append((doc, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), len(ids) // 4, sequence, at, max(0, start + size - max(start, prompt))))
                at += size
            sequence += 1
        packer.done = []
        still = packer.open()
        for key in [k for k in held if k not in still]:
            del held[key]
        if rows:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

    for batch in batches:
        flat, first = enc.encode(*text_bytes(batch.column(1)))
        flat = flat.astype("<u4", copy=False)
        prompts = batch.column(2).to_pylist()
        for i, doc in enumerate(batch.column(0).to_pylist()):
            ids = flat[first[i] : first[i + 1]].tobytes() + tail
            size = len(ids) // 4
            prompt = math.ceil(share * size) if prompts[i] is None else min(size, max(0, prompts[i]))
            held[serial] = (doc, ids, prompt)
            packer.add(serial, size, prompt)
            serial += 1
            if packer.tokens >= POOL and (out := flush(False)):
                yield out
    if out := flush(True):
        yield out


def pack_sequences(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, length: int = LENGTH, segments: int = SEGMENTS, loss: int | None = LOSS, prompt: str | None = None, share: float = PROMPT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    ``prompt`` names a column with each example's number of leading tokens that bear no loss; without one, or where it
    is null, these are ``share`` of its tokens, rounded up.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)
    source = docs.select("doc_id", "text", (F.col(prompt) if prompt else F.lit(None)).cast("long").alias("prompt"))
    schema = f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
    return source.mapInArrow(lambda it: _packed(it, tokenizer, end, length, segments, loss, share, arrow), schema)
