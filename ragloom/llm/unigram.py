"""SentencePiece-style unigram encoding and decoding: Viterbi over a double-array trie of pieces with log scores.

Pieces come from a public model file; where its scores are merge ranks rather than log probabilities, they are turned
into them by rank (Zipf-Mandelbrot). White space is written as a marker, one is put before the text, characters that no
piece covers become byte pieces, and decoding reverses all of it. No piece has a marker after another character, so the
best path of a text is that of its marker-led chunks in turn: each distinct chunk is solved once per worker, many
chunks side by side, one trie step for all of them at a time.

Defined cases: null text is empty and has no tokens; an empty table gives an empty result; repeated rows give repeated
rows; a null doc_id is passed through; a literal marker character decodes to a space, as in the original library;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import enter, keeps
from .words import text_bytes

MODEL = "piece_bpe_32k.model"
MARK = "▁".encode()
UNKNOWN = 0
#: A character without a piece costs this much more than the least likely piece.
PENALTY = 10.0
#: Cached chunks a worker keeps; beyond it the cache starts anew.
CACHED = 600_000
#: Chunks longer than this many bytes are solved one by one.
LONG = 48
_CHUNKS = re.compile(rb" +[^ ]*").findall


class DoubleArray:
    """A trie over bytes: the child of state s by byte c is base[s] + c, if check of that is s; value is -1 or an id."""

    def __init__(self, entries: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ids = [-1]
        for key in sorted(entries):
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ids.append(-1)
                node = children[node][c]
            ids[node] = entries[key]
        size = 2 * len(children) + 4096
        base, check, value, used = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32), np.zeros(size, bool)
        used[0] = True
        place, free, queue, since = {0: 0}, 256, [0], [1] * 257  # since: where a node of as many children last found room
        for node in queue:
            if not children[node]:
                continue
            codes = sorted(children[node])
            while used[free]:
                free += 1
            many = len(codes)
            b = max(1, free - codes[0], since[many] if many > 1 else 1)
            while True:
                if b + 4096 + 256 >= size:
                    grown = [np.concatenate([x, np.full(size, f, x.dtype)]) for x, f in ((base, 0), (check, -1), (value, -1), (used, False))]
                    base, check, value, used = grown
                    size *= 2
                span = 64 if many < 2 else 4096
                clash = used[b + codes[0] : b + codes[0] + span].copy()
                for c in codes[1:]:
                    clash |= used[b + c : b + c + span]
                k = int(np.argmin(clash))
                b += k if not clash[k] else span
                if not clash[k]:
                    break
            base[place[node]], since[many] = b, b
            for c in codes:
                child = children[node][c]
                place[child] = b + c
                used[b + c] = True
                check[b + c] = place[node]
                value[b + c] = ids[child]
                queue.append(child)
        self.base, self.check, self.value = base, check, value


def _mb_length() -> np.ndarray:
    """Bytes of the character that a byte leads; 0 for continuation bytes."""
    out = np.ones(256, np.int64)
    out[128:192] = 0
    out[192:224], out[224:240], out[240:] = 2, 3, 4
    return out


_MB = _mb_length()


class Unigram(dict):
    """Pieces with log scores. As a dict it maps chunks (a space for the marker) to ids, little-endian unsigned 32-bit."""

    def __init__(self, pieces: list[bytes], scores: np.ndarray, byte_ids: dict[int, int]):
        self.scores = np.asarray(scores, np.float32)
        normal = {p.replace(MARK, b" "): i for i, p in enumerate(pieces) if i not in byte_ids and p}
        if any(b" " in p.lstrip(b" ") for p in normal):
            raise ValueError("a piece has a marker after another character")
        self.trie = DoubleArray(normal)
        self.unknown = np.float32(min(self.scores[i] for i in normal.values()) - PENALTY)
        self.byte = np.zeros(256, np.int32)
        for i, b in byte_ids.items():
            self.byte[b] = i
        self.is_byte = np.zeros(len(pieces), bool)
        self.is_byte[list(byte_ids)] = True
        self.raw = [bytes([byte_ids[i]]) if i in byte_ids else p.replace(MARK, b" ") for i, p in enumerate(pieces)]

    def chunks(self, text: bytes) -> list[bytes]:
        if not text:
            return []
        text = text.replace(MARK, b" ") if MARK in text else text
        if b"  " in text or text[:1] == b" " or text[-1:] == b" ":
            return _CHUNKS(b" " + text)
        return [b" " + x for x in text.split(b" ")]

    def learn(self, chunks: set[bytes]) -> None:
        """Solves the chunks that are not cached."""
        new = [c for c in chunks if c not in self]
        if len(self) + len(new) > CACHED:
            self.clear()
            new = list(chunks)
        by: dict[int, list[bytes]] = {}
        for c in new:
            by.setdefault(len(c), []).append(c)
        for n, group in by.items():
            if n > LONG:
                for c in group:
                    self[c] = self.solve(np.frombuffer(c, np.uint8)[None])[0]
            else:
                for at in range(0, len(group), 8192):
                    part = group[at : at + 8192]
                    self.update(zip(part, self.solve(np.frombuffer(b"".join(part), np.uint8).reshape(-1, n)), strict=True))

    def solve(self, text: np.ndarray) -> list[bytes]:
        """Best paths of equally long chunks, one a row."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        rows, n = text.shape
        text = text.astype(np.int64)
        best = np.full((rows, n + 1), -np.inf, np.float32)
        best[:, 0] = 0
        came, by = np.full((rows, n + 1), -1, np.int32), np.zeros((rows, n + 1), np.int32)
        lead = _MB[text]
        for i in range(n):
            live = np.flatnonzero(lead[:, i])
            if not len(live):
                continue
            own, size = live, np.minimum(lead[live, i], n - i)
            here = best[own, i]
            single = np.zeros(len(own), bool)
            state, k = np.zeros(len(own), np.int64), np.arange(len(own))
            for j in range(i, n):
                step = base[state] + text[own[k], j]
                ok = check[step] == state
                k, state = k[ok], step[ok].astype(np.int64)
                if not len(k):
                    break
                ids = value[state]
                hit = np.flatnonzero(ids >= 0)
                if len(hit):
                    r, kk, got = own[k[hit]], k[hit], ids[hit]
                    score = here[kk] + self.scores[got]
                    better = score > best[r, j + 1]
                    r, got = r[better], got[better]
                    best[r, j + 1], came[r, j + 1], by[r, j + 1] = score[better], i, got
                    single[kk] |= size[kk] == j + 1 - i
            lone = np.flatnonzero(~single)
            if len(lone):
                r, to = own[lone], i + size[lone]
                score = here[lone] + self.unknown
                better = score > best[r, to]
                r, to = r[better], to[better]
                best[r, to], came[r, to], by[r, to] = score[better], i, -1
        out = np.full((rows, n), -1, np.int32)
        at, live = np.full(rows, n), np.arange(rows)
        while len(live):
            start, got = came[live, at[live]], by[live, at[live]]
            known = got >= 0
            out[live[known], start[known]] = got[known]
            for r, s in zip(live[~known].tolist(), start[~known].tolist(), strict=True):
                out[r, s : at[r]] = self.byte[text[r, s : at[r]]]
            at[live] = start
            live = live[start > 0]
        keep = out >= 0
        flat, ends = out[keep].astype("<u4").tobytes(), np.cumsum(keep.sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode(self, text: bytes) -> bytes:
        chunks = self.chunks(text)
        self.learn(set(chunks))
        return b"".join(map(self.__getitem__, chunks))

    def decode(self, ids: bytes) -> bytes:
        """The text of these ids, without the marker put before it."""
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))[1:]


@cache
def load_pieces(model: str = MODEL, scored: bool = False) -> Unigram:
    """The file's pieces; ``scored``: its scores are log probabilities already."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=public_tokenizers.path(model) if "/" not in model else model)
    n = m.get_piece_size()
    skip = {i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_unused(i)}
    byte_ids = {i: int(m.id_to_piece(i)[3:5], 16) for i in range(n) if m.is_byte(i)}
    pieces = [b"" if i in skip else m.id_to_piece(i).encode() for i in range(n)]
    first = len(skip | byte_ids.keys())
    scores = [m.get_score(i) for i in range(n)] if scored else rank_scores(n, first)
    return Unigram(pieces, np.array(scores, np.float32), byte_ids)


def rank_scores(n: int, first: int) -> np.ndarray:
    """Zipf-Mandelbrot log probabilities by rank for ids from ``first`` on."""
    weight = 1 / (np.arange(n - first) + 2.7)
    return np.concatenate([np.zeros(first), np.log(weight / weight.sum())]).astype(np.float32)


def _encoded(batches: Iterator[pa.RecordBatch], model: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    enter("unigram")
    unigram = load_pieces(model)
    keeps("unigram", unigram.clear)
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        raw = data.tobytes()
        for lo in range(0, batch.num_rows, 512):
            hi = min(batch.num_rows, lo + 512)
            texts = [raw[offsets[i] : offsets[i + 1]] for i in range(lo, hi)]
            parts = [unigram.chunks(t) for t in texts]
            unigram.learn(set().union(*parts))
            found = [b"".join(map(unigram.__getitem__, p)) for p in parts]
            back = [unigram.decode(x) for x in found]
            ids = [np.frombuffer(x, "<u4") for x in found]
            cols = [
                batch.column(0).slice(lo, hi - lo),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([int(unigram.is_byte[x].sum()) for x in ids], pa.int64()),
                pa.array([float(unigram.scores[x].sum(dtype=np.float64)) for x in ids], pa.float64()),
                pa.array([zlib.crc32(x) for x in found], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                pa.array([x == t for x, t in zip(back, texts, strict=True)], pa.bool_()),
            ]
            names = ["doc_id", "n_tokens", "n_bytes", "log_score", "ids_crc32", "decoded_sha256", "round_trip"]
            if with_ids:
                cols.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)


def encode_documents(docs: DataFrame, model: str = MODEL, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, n_bytes (byte pieces), log_score, ids_crc32, decoded_sha256, round_trip (and ids)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, n_bytes long, log_score double, ids_crc32 long, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(lambda it: _encoded(it, model, with_ids), schema)
