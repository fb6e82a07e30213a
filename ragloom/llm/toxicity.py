"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Two words are compared by the gap-weighted subsequence kernel: every choice of three characters, in order and within
``SPAN`` places, counts with ``DECAY`` to the power of the places it covers; the kernel is normalised. Inserted or
dropped characters leave most such triples in place. Landmark words are chosen by pivoted Cholesky; a linear SVM
(squared hinge) is fitted on the Nystroem features of words taken from labelled documents: words far more frequent in
toxic documents against words of clean ones. The kernel runs on single words, not on sentences or phrases. Since the kernel has explicit features, the fitted machine
folds into one weight per triple, which scores any word exactly as the landmarks would. A document's score is a
logistic function of its best words' margins, fitted on the training documents.

The machine is fitted in one task from at most ``TRAIN`` toxic and ``TRAIN`` clean labelled documents (all there are
below that), chosen by hash of doc_id among rows that the caller allows. The words that it is fitted on are bounded, too, by documented
parameters (``SUPPORT`` to ``HARD``); they come from that sample alone. Scoring reads whole texts of all documents in
one pass without a shuffle; each distinct word is scored once per worker. Words end at Unicode white space; one of more
than ``WHOLE`` bytes is scored in overlapping pieces, of which the best counts, so no byte of a text is left out.

Defined cases: null or empty text has the score of a text without words; without both kinds of labels every score is
0; repeated rows give repeated rows; a null doc_id is never learnt from and is not held out; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import enter, keeps
from .words import text_bytes

TRAIN = 3000
LANDMARKS = 224
#: A word is taken for an insult if at least so many toxic documents hold it (by their number), if it has so many letters,
#: and if its share of toxic documents is so many times its share of clean ones, chance allowed for.
SUPPORT, SUPPORT_SHARE, LETTERS, ODDS = 3, 400, 3, 5
#: Words that the machine is fitted on, at most: insults; the commonest clean words; other clean words, by hash; and in a
#: second fit the clean words that look most like insults.
INSULTS, COMMON, OTHERS, HARD = 3000, 1500, 8000, 3000
#: Words that landmarks are chosen from, at most: insults and common clean words.
PIVOT_INSULTS, PIVOT_COMMON = 1200, 400
#: Ridge of the word machine.
RIDGE = 0.02
DECAY = 0.6
SPAN = 5
CACHED = 1_000_000
BITS = 6
#: A longer word (bytes) is cut into pieces of PIECE bytes that begin every STEP bytes.
WHOLE, PIECE, STEP = 64, 24, 12
_EDGE = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_DROP = bytes(c for c in range(128) if not chr(c).isalpha())
#: White space outside what bytes.split() knows: 0x1C to 0x1F and, in UTF-8, U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000.
_WIDE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_SPACED = re.compile(rb"(?:(?<=\s)|\A)(?:[^\s]\s){3,}[^\s](?=\s|\Z)")


def _alphabet() -> np.ndarray:
    """Byte classes: 0 outside, 1 word start, 63 word end, 2-27 letters, the rest shared by digits, signs and UTF-8 bytes."""
    out = 28 + np.arange(256) % 35
    out[97:123] = np.arange(2, 28)
    out[65:91] = np.arange(2, 28)
    return out.astype(np.int64)


_ALPHABET = _alphabet()
_SHAPES = [(a, b) for a in range(1, SPAN - 1) for b in range(a + 1, SPAN)]


def pieces(word: bytes) -> list[bytes]:
    """The word, or overlapping pieces of a long one; any run of PIECE - STEP bytes lies whole in one of them."""
    if len(word) <= WHOLE:
        return [word]
    return [word[i : i + PIECE] for i in range(0, len(word) - PIECE + STEP, STEP)]


def forms(word: bytes) -> list[bytes]:
    """A word without signs at its edges and, if signs or digits are left inside, without these; long ones in pieces."""
    bare = word.strip(_EDGE)
    letters = bare.translate(None, _DROP)
    return pieces(bare) if letters == bare else pieces(bare) + pieces(letters)


def triples(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kernel features of words: word number, triple code and weight (unit length per word), sorted by both."""
    size = np.array([len(w) + 2 for w in words], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    sym = np.zeros(first[-1] + SPAN, np.int64)
    flat = np.frombuffer(b"".join(b"\0" + w + b"\0" for w in words), np.uint8)
    sym[: first[-1]] = _ALPHABET[flat]
    sym[first[:-1]], sym[first[1:] - 1] = 1, 63
    own = np.repeat(np.arange(len(words)), size)
    left = np.repeat(first[1:], size) - np.arange(first[-1])
    keys, weights = [], []
    for a, b in _SHAPES:
        at = np.flatnonzero(left > b)
        keys.append((own[at] << 18) | (sym[at] << 12) | (sym[at + a] << 6) | sym[at + b])
        weights.append(np.full(len(at), DECAY ** (b + 1)))
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], np.concatenate(weights)[order]
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    weight = np.add.reduceat(weight, start)
    key = key[start]
    word = key >> 18
    norm = np.sqrt(np.bincount(word, weight**2, len(words)))
    return word, key & ((1 << 18) - 1), weight / norm[word]


class Machine:
    """A weight per triple, a bias for words, and the document-level logistic weights."""

    def __init__(self, weights: np.ndarray, bias: float, top: np.ndarray | None):
        self.weights, self.bias, self.top, self.known = weights, bias, top, {}

    def margins(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        word, code, weight = triples(words)
        return np.bincount(word, weight * self.weights[code], len(words)) + self.bias

    def learn(self, words: set[bytes]) -> None:
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > CACHED:
            known.clear()
            new = list(words)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            shapes = [forms(w) for w in part]
            flat = [f for fs in shapes for f in fs]
            margin = np.concatenate([self.margins(flat[i : i + 20_000]) for i in range(0, len(flat), 20_000)])
            first = np.concatenate([[0], np.cumsum([len(fs) for fs in shapes])])
            known.update(zip(part, np.maximum.reduceat(margin, first[:-1]).tolist(), strict=True))

    def features(self, bags: list[set[bytes]]) -> np.ndarray:
        """Per document: best and second margin, number of positive words, number of words (damped)."""
        self.learn(set().union(*bags) if bags else set())
        out = np.zeros((len(bags), 5))
        for i, bag in enumerate(bags):
            got = sorted(map(self.known.__getitem__, bag))
            best = got[-1] if got else -2.0
            second = got[-2] if len(got) > 1 else -2.0
            out[i] = (max(best, -2.0), max(second, -2.0), np.log1p(len(got) - bisect_right(got, 0.0)), np.log1p(len(got)), 1.0)
        return out

    def scores(self, bags: list[set[bytes]]) -> np.ndarray:
        if self.top is None:
            return np.zeros(len(bags))
        return 1 / (1 + np.exp(-np.clip(self.features(bags) @ self.top, -30, 30)))


def bag(text: bytes) -> set[bytes]:
    """A text's distinct lower-cased words; letters set apart by spaces also as one word."""
    low = _WIDE.sub(b" ", text.lower())
    words = set(low.split())
    if any(len(w) == 1 for w in words):
        words.update(re.sub(rb"\s", b"", m) for m in _SPACED.findall(low))
    return words


def _newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, hinge: bool, rounds: int = 30) -> np.ndarray:
    """Weights of a linear machine on squared hinge (labels -1, 1) or logistic loss (labels 0, 1)."""
    w = np.zeros(x.shape[1])
    eye = ridge * np.eye(x.shape[1])
    for _ in range(rounds):
        f = x @ w
        if hinge:
            gap = 1 - y * f
            live = gap > 0
            grad = -(x[live].T @ (weight[live] * y[live] * gap[live])) + ridge * w
            hess = x[live].T @ (x[live] * weight[live, None]) + eye
        else:
            p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
            grad = x.T @ (weight * (p - y)) + ridge * w
            hess = x.T @ (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]) + eye
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _fit_words(bags: list[set[bytes]], toxic: np.ndarray, landmarks: int = LANDMARKS) -> Machine:
    """The word machine of labelled documents."""
    n_bad, n_good = int(toxic.sum()), int((~toxic).sum())
    none = Machine(np.zeros(1 << 18), 0.0, None)
    if not n_bad or not n_good:
        return none
    bad, good = Counter(), Counter()
    for b, t in zip(bags, toxic.tolist(), strict=True):
        (bad if t else good).update({f for w in b for f in forms(w) if f})
    least = SUPPORT if n_bad < 100 else max(SUPPORT + 1, n_bad // SUPPORT_SHARE)
    low = lambda n: n - 1.5 * n**0.5  # noqa: E731  what chance leaves of a count
    odds = {w: (low(n) / n_bad) / ((good[w] + 1.5 * good[w] ** 0.5 + 0.5) / (n_good + 1)) for w, n in bad.items() if n >= least and len(w) >= LETTERS}
    pos = sorted((w for w, r in odds.items() if r >= ODDS), key=lambda w: (-bad[w], w))[:INSULTS]
    if not pos:
        return none
    chosen = set(pos)
    often = [w for w, _ in good.most_common(COMMON) if w not in chosen]
    rest = sorted((w for w in good if w not in chosen), key=zlib.crc32)[:OTHERS]
    neg = list(dict.fromkeys(often + rest))
    words = pos + neg
    pivots = pos[: landmarks // 4]
    pivots += [w for w in choose_landmarks(pos[:PIVOT_INSULTS] + often[:PIVOT_COMMON], landmarks) if w not in set(pivots)][: landmarks - len(pivots)]
    lw, lc, lv = triples(pivots)
    used, place = np.unique(lc, return_inverse=True)
    dense = np.zeros((len(used) + 1, len(pivots)))
    dense[place, lw] = lv
    where = np.full(1 << 18, len(used))
    where[used] = np.arange(len(used))

    dense = dense.astype(np.float32)

    def kernel(some: list[bytes]) -> np.ndarray:
        out = np.zeros((len(some), len(pivots)), np.float32)
        for at in range(0, len(some), 500):
            w, c, v = triples(some[at : at + 500])
            if len(w):
                start = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                out[at + w[start]] = np.add.reduceat(dense[where[c]] * v[:, None].astype(np.float32), start)
        return out

    values, vectors = np.linalg.eigh(kernel(pivots).astype(float))
    live = values > 1e-6 * values.max()
    root = vectors[:, live] / np.sqrt(values[live])
    for turn in range(2):
        y = np.array([1.0] * len(pos) + [-1.0] * (len(words) - len(pos)))
        weight = np.array([float(bad[w]) for w in pos] + [min(good[w], 60) + 2.0 for w in words[len(pos) :]])
        for side, share in ((y > 0, 0.35), (y < 0, 0.65)):
            weight[side] *= share * len(words) / weight[side].sum()
        x = np.hstack([kernel(words) @ root, np.ones((len(words), 1))])
        w = _newton(x, y, weight, RIDGE, True)
        alpha = root @ w[:-1]
        fold = np.zeros(1 << 18)
        fold[used] = dense[:-1] @ alpha
        machine = Machine(fold, float(w[-1]), None)
        if not turn:  # once more, with the clean words that look most like insults
            other = [f for f in good if f not in chosen]
            margin = machine.margins(other)
            hard = [other[i] for i in np.argsort(-margin)[:HARD]]
            words = pos + list(dict.fromkeys(neg + hard))
    return machine


def _unlike(bags: list[set[bytes]]) -> list[int]:
    """Documents of which no earlier one is a near copy: at most two of their eight minimal word hashes agree."""
    seen: list[dict[int, int]] = [{} for _ in range(8)]
    keep, codes = [], {w: zlib.crc32(w) for b in bags for w in b}
    odd = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393, 2869860233, 3624381081, 1013904223], np.uint64)
    for i, b in enumerate(bags):
        own = np.array([codes[w] for w in b] or [0], np.uint64)
        least = ((own[:, None] * odd) & np.uint64(0xFFFFFFFF)).min(0).tolist()
        met = Counter(seen[k][m] for k, m in enumerate(least) if m in seen[k])
        if not met or met.most_common(1)[0][1] <= 2:
            keep.append(i)
            for k, m in enumerate(least):
                seen[k].setdefault(m, i)
    return keep


def fit(bags: list[set[bytes]], toxic: np.ndarray, landmarks: int = LANDMARKS) -> Machine:
    """The machine of labelled documents: near copies count once, document weights are fitted on words' out-of-fold margins."""
    keep = _unlike(bags)
    bags, toxic = [bags[i] for i in keep], toxic[keep]
    x, done = np.zeros((len(bags), 5)), np.zeros(len(bags), bool)
    order = np.argsort(toxic, kind="stable")
    fold = np.empty(len(bags), np.int64)
    fold[order] = np.arange(len(bags)) % 2
    for side in (0, 1):
        own, other = np.flatnonzero(fold == side), np.flatnonzero(fold != side)
        half = _fit_words([bags[i] for i in other], toxic[other], landmarks // 2)
        if len(own) and half.weights.any():
            x[own], done[own] = half.features([bags[i] for i in own]), True
    machine = _fit_words(bags, toxic, landmarks)
    if not machine.weights.any():
        return machine
    if not (done & toxic).any() or not (done & ~toxic).any():
        x, done = machine.features(bags), np.ones(len(bags), bool)
    y = toxic[done].astype(float)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    machine.top = _newton(x[done], y, weight, 0.05 * len(y) ** 0.5, False)
    machine.known = {}
    return machine


def choose_landmarks(words: list[bytes], n: int) -> list[bytes]:
    """Pivoted Cholesky: each landmark is the word worst explained by those before it."""
    word, code, value = triples(words)
    used, place = np.unique(code, return_inverse=True)
    x = np.zeros((len(words), len(used)), np.float32)
    x[word, place] = value
    left = (x * x).sum(1)
    rows, out = [], []
    for _ in range(min(n, len(words))):
        i = int(np.argmax(left))
        if left[i] < 1e-4:
            break
        row = x @ x[i]
        for r in rows:
            row -= r * r[i]
        row /= np.sqrt(left[i])
        rows.append(row)
        left = np.maximum(left - row * row, 0)
        left[i] = 0
        out.append(words[i])
    return out


def train(docs: DataFrame, labels: DataFrame, allowed, size: int = TRAIN) -> Machine:
    """Fits the machine on at most ``size`` toxic and ``size`` clean rows of ``labels`` for which ``allowed`` holds."""
    pool = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & allowed).select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    some = [pool.filter(F.col("toxic") == t).orderBy(F.xxhash64("label_id"), "label_id").limit(size) for t in (0, 1)]
    chosen = F.broadcast(some[0].unionByName(some[1]))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            raw = data.tobytes()
            packed = [b"\0".join(sorted(bag(raw[offsets[i] : offsets[i + 1]]))) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column(1)], ["words", "toxic"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The only task that holds the sample; copies of a document count once."""
        found = {(w, t) for batch in batches for w, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)}
        one: dict[bytes, bytes] = {}
        order = sorted(found, key=lambda x: (x[1], x[0]))
        bags = [{one.setdefault(x, x) for x in w.split(b"\0")} if w else set() for w, _ in order]
        m = fit(bags, np.array([t == 1 for _, t in order], bool))
        top = None if m.top is None else m.top.tolist()
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.bias]), pa.array([top], pa.list_(pa.float64()))], ["weights", "bias", "top"])

    rows = docs.join(chosen, docs["doc_id"] == chosen["label_id"]).select("text", "toxic").mapInArrow(words, "words binary, toxic int")
    got = rows.repartition(1).mapInArrow(fitted, "weights binary, bias double, top array<double>").first()
    if got is None:
        return Machine(np.zeros(1 << 18), 0.0, None)
    return Machine(np.frombuffer(got.weights, float), got.bias, None if got.top is None else np.array(got.top))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score, one row per document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((machine.weights, machine.bias, machine.top))  # 2 MB, whatever the data

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _worker_machine(shared)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            raw = data.tobytes()
            for lo in range(0, batch.num_rows, 512):
                hi = min(batch.num_rows, lo + 512)
                got = own.scores([bag(raw[offsets[i] : offsets[i + 1]]) for i in range(lo, hi)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(got)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(read, f"doc_id {kind}, score double")


_machines: dict = {}


def _worker_machine(shared) -> Machine:
    """One machine per worker and broadcast, so that its cache of words lives on between tasks."""
    enter("toxicity")
    keeps("toxicity", _machines.clear)
    weights, bias, top = shared.value
    mark = (bias, None if top is None else top.tobytes(), float(weights.sum()))
    if _machines.get("mark") != mark:
        _machines.clear()
        _machines.update(mark=mark, machine=Machine(weights, bias, top))
    return _machines["machine"]


def held_out(doc_id):
    """Rows that labels are never learnt from: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    machine = train(docs, labels, ~held_out(F.col("doc_id")))
    return score(docs, machine).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
