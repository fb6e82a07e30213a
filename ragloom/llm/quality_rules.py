"""Quality rules with compression bands: zstandard ratios of whole documents and of fixed chunks, beside counting rules.

A text's ratio is its compressed size over its size in UTF-8 bytes. What repeats itself compresses too well, noise hardly
at all, and short texts less than long ones of the same kind; so the limits depend on the length (``BANDS``: ordinary
prose and code lie well inside). The whole document must lie in its band, and of its bytes no more than ``SHARE`` per
cent may lie in fixed chunks of ``CHUNK`` bytes outside theirs: a page of noise or repetition inside a long document
shows in chunks when it doesn't in the whole. A document that fails a counting rule goes whatever its ratios are.

One pass without a shuffle: a document is judged by itself alone, so nothing is fitted, counted across documents or kept.

Defined cases: null and empty texts have no words and fail the counting rules, their ratio is null; texts under 128 bytes
have no band; repeated rows and null doc_ids are judged each by its own text; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import enter
from .words import Words, repeats, slices, text_bytes

#: From how many bytes on a band holds, and the ratios between which a text passes.
BANDS = ((0, 0.0, 99.0), (128, 0.35, 1.15), (256, 0.33, 0.95), (512, 0.32, 0.85), (1024, 0.30, 0.76), (2048, 0.28, 0.70), (4096, 0.26, 0.66), (8192, 0.25, 0.63), (16384, 0.24, 0.62), (65536, 0.22, 0.60))
CHUNK = 4096
#: Per cent of a document's bytes that may lie in chunks outside their bands.
SHARE = 25
LEVEL = 3
WINDOW = 8
LEAST_WORDS = 20
#: Per cent of a document's words that may lie in repeated windows.
MOST_REPEATED = 30
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"

_NEWLINE, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
_NEWLINE[10] = True
_SYMBOL[list(b"#*$%&|<>")] = True
_FROM, _LOW, _HIGH = (np.array(x) for x in zip(*BANDS, strict=True))


def in_band(size: int | np.ndarray, ratio: float | np.ndarray) -> np.ndarray:
    at = np.searchsorted(_FROM, size, "right") - 1
    return (ratio >= _LOW[at]) & (ratio <= _HIGH[at])


def ratios(raw: bytes, chunk: int = CHUNK, level: int = LEVEL) -> tuple[float, np.ndarray, np.ndarray]:
    """The whole text's ratio, and sizes and ratios of its chunks; the last chunk may be shorter."""
    packer = zstandard.ZstdCompressor(level=level)
    whole = len(packer.compress(raw)) / len(raw)
    parts = [raw[i : i + chunk] for i in range(0, len(raw), chunk)]
    sizes = np.array([len(x) for x in parts])
    each = np.array([whole]) if len(parts) == 1 else np.array([len(packer.compress(x)) for x in parts]) / sizes
    return whole, sizes, each


def _per_document(marks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``marks`` between the borders ``first``."""
    total = np.concatenate([[0], np.cumsum(marks)])
    return total[first[1:]] - total[first[:-1]]


def base_counts(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    words, lines = Words(data, offsets), Words(data, offsets, breaks=_NEWLINE)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = _per_document(points[words.end] - points[words.start], words.first)
    symbols = _per_document(_SYMBOL[data], offsets)

    doc = np.repeat(np.arange(len(offsets) - 1), lines.counts)
    worded = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    order, again = repeats(doc[worded], lines.hashes(0)[worded], lines.hashes(1)[worded])
    dup = np.bincount(doc[worded][order][again], minlength=len(offsets) - 1)

    h1, at = words.windows(window)
    order, again = repeats(np.searchsorted(words.first, at, "right") - 1, h1, words.windows(window, 1)[0])
    twice = at[order[again | np.append(again[1:], False)]]
    cover = np.zeros(len(words.start) + 1, np.int32)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    return words.counts, chars, symbols, dup, _per_document(np.cumsum(cover)[:-1] > 0, words.first)


def _judged(batches: Iterator[pa.RecordBatch], chunk: int, share: int) -> Iterator[pa.RecordBatch]:
    enter()
    for whole in batches:
        for batch in slices(whole, 1):
            data, offsets = text_bytes(batch.column(1))
            words, chars, symbols, dup, repeated = base_counts(data, offsets)
            failed = (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * words)
            n = batch.num_rows
            ratio, n_chunks, n_bad = np.full(n, np.nan), np.zeros(n, np.int64), np.zeros(n, np.int64)
            passed = np.zeros(n, bool)
            for i in np.flatnonzero(np.diff(offsets)).tolist():
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                ratio[i], sizes, each = ratios(raw, chunk)
                bad = ~in_band(sizes, each)
                n_chunks[i], n_bad[i] = len(sizes), bad.sum()
                passed[i] = in_band(len(raw), ratio[i]) and 100 * int(sizes[bad].sum()) <= share * len(raw)
            long = lambda x: pa.array(x, pa.int64())
            columns = [batch.column(0), *map(long, (words, chars, symbols, dup, repeated)), pa.array(failed), pa.array(passed & ~failed), pa.array(ratio, mask=np.isnan(ratio)), long(n_chunks), long(n_bad)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))])


def quality_rules(docs: DataFrame, chunk: int = CHUNK, share: int = SHARE) -> DataFrame:
    """Per document: doc_id, the counts, base_failed, kept, ratio, n_chunks, n_bad_chunks."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda it: _judged(it, chunk, share), f"doc_id {kind}, {SCHEMA}")
