"""Secret scan with multipart credential linking.

Base kinds are matched by pattern: ``assign`` (a secret-like name with a value), ``access`` (key identifiers) and
``hex`` (long digests). Weak parts alone mean nothing: a name-like identifier, a mixed-character token, a URL. They
are linked by an interval join inside their scopes: each weak token's scope is the interval ``reach`` code points to
either side, cut at blank lines, and it is reported (``weak_secret``) only if an identifier (``access`` or
``weak_id``) overlaps it; that identifier (if weak) and the endpoints in the scope are reported with it.

A batch is scanned as one byte buffer: literal searches and a strided test for hex runs choose the documents that
need their patterns run, so text without any candidate costs a few linear passes. Documents are never split or cut.

Defined cases: null text is empty and has no spans; an empty table gives an empty result; repeated rows give repeated
rows; a null doc_id is passed through; other columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import enter
from .words import text_bytes

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "weak_id", "weak_secret", "endpoint")
SPAN = "array<struct<kind:string,start:long,end:long>>"
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
WEAK_ID = re.compile(rb"""(?<![A-Za-z0-9])(?:client|account|access|user|tenant|key)[_-]?(?:id|name)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.I)
WEAK_ID_NAMES = tuple(a + b + c for a in (b"client", b"account", b"access", b"user", b"tenant", b"key") for b in (b"", b"_", b"-") for c in (b"id", b"name"))
WEAK_SECRET = re.compile(rb"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(rb"""(?<![A-Za-z0-9+.-])[0-9+.-]*([A-Za-z][A-Za-z0-9+.-]+://[^\x00-\x20"'<>]+)""")
#: Code points to either side of a weak token in which its complement must lie.
REACH = 300
_HEXES = np.zeros(256, bool)
_HEXES[list(b"0123456789abcdef")] = True


def _finds(low: bytes, needles) -> list[int]:
    at = []
    for needle in needles:
        i = low.find(needle)
        while i >= 0:
            at.append(i)
            i = low.find(needle, i + len(needle))
    return at


def _mixed(token: bytes) -> bool:
    """Three of lower case, upper case, digits and signs, and no character too common."""
    kinds = (re.search(rb"[a-z]", token), re.search(rb"[A-Z]", token), re.search(rb"[0-9]", token), re.search(rb"[+/_=-]", token))
    return sum(k is not None for k in kinds) >= 3 and max(token.count(c) for c in set(token)) * 4 <= len(token)


def _scope(leads: np.ndarray | None, s: int, e: int, reach: int) -> tuple[int, int]:
    """Byte offsets ``reach`` code points before s and after e; ``leads`` are the code points' first bytes, None if all are ASCII."""
    if leads is None:
        return s - reach, e + reach
    a, b = np.searchsorted(leads, (s, e))
    return int(leads[max(a - reach, 0)]), int(leads[b + reach]) if b + reach < len(leads) else int(leads[-1]) + 4


def _overlapping(spans: list, at: list[int], to: list[int], lo: int, hi: int) -> list:
    """Spans that share a byte with lo to hi; ``at`` are their starts in order, ``to`` the greatest end up to each."""
    return [x for x in spans[bisect_right(to, lo) : bisect_left(at, hi)] if x[1] > lo]


def _linked(raw: bytes, base: list[tuple[int, int, int]], reach: int) -> list[tuple[int, int, int]]:
    """Interval join of weak tokens' scopes with identifiers and endpoints."""
    ids = [(s, e, None) for k, s, e in base if k == 1] + [(m.start(), m.end(), (3, m.start(), m.end())) for m in WEAK_ID.finditer(raw)]
    if not ids:
        return []
    ids.sort(key=lambda x: x[:2])
    ends = [m.span(1) for m in ENDPOINT.finditer(raw)]
    id_at, end_at = [x[0] for x in ids], [x[0] for x in ends]
    id_to, end_to = (list(accumulate((x[1] for x in xs), max)) for xs in (ids, ends))
    leads = None if raw.isascii() else np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    taken = sorted([(s, e) for _, s, e in base] + [(s, e) for s, e, _ in ids] + ends)
    taken_at, taken_to = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    gaps = [m.start() for m in re.finditer(rb"\n[\x20\t\r]*\n", raw)]
    out: set[tuple[int, int, int]] = set()
    for m in WEAK_SECRET.finditer(raw):
        s, e = m.span()
        before = bisect_left(taken_at, e)
        if before and taken_to[before - 1] > s or not _mixed(m[0]):
            continue
        g = bisect_right(gaps, s)
        lo, hi = _scope(leads, s, e, reach)
        lo = max(lo, gaps[g - 1] if g else 0)
        hi = min(hi, gaps[g] if g < len(gaps) else len(raw))
        near = _overlapping(ids, id_at, id_to, lo, hi)
        if near:
            out.add((4, s, e))
            out.update(x[2] for x in near if x[2])
            out.update((5, *x) for x in _overlapping(ends, end_at, end_to, lo, hi))
    return sorted(out)


def scan_text(raw: bytes, reach: int = REACH) -> list[tuple[str, int, int]]:
    """All spans of one UTF-8 text, in order of start, then kind as in KINDS."""
    found = [(0, m.start(), m.end()) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 6]
    found += [(1, m.start(), m.end()) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    found += [(2, m.start(), m.end()) for m in HEX.finditer(raw) if m.end() - m.start() >= 24]
    found += _linked(raw, found, reach)
    found.sort(key=lambda x: (x[1], x[0], x[2]))
    if not raw.isascii():
        lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        points = np.concatenate([[0], np.cumsum(lead)])
        found = [(k, int(points[s]), int(points[e])) for k, s, e in found]
    return [(KINDS[k], s, e) for k, s, e in found]


def candidates(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents of a batch that may hold any span (no other can)."""
    raw = data.tobytes()
    low = raw.lower()
    at = _finds(low, (*NAMES, *WEAK_ID_NAMES)) + _finds(raw, (b"AKIA",))
    hexes = _HEXES[data]
    step = hexes[::12]
    k = np.flatnonzero(step[:-1] & step[1:])
    k = k[hexes[k * 12 + 6] & hexes[k * 12 + 3] & hexes[k * 12 + 9]]
    places = np.concatenate([np.array(at, np.int64), k * 12])
    return np.unique(np.searchsorted(offsets, places, "right") - 1)


def _scan(batches: Iterator[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    enter()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        spans: list = [[]] * batch.num_rows
        for i in candidates(data, offsets):
            spans[i] = [dict(zip(("kind", "start", "end"), x, strict=True)) for x in scan_text(data[offsets[i] : offsets[i + 1]].tobytes(), reach)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id and its spans (kind, start, end), one row per document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda it: _scan(it, reach), f"doc_id {kind}, spans {SPAN}")


def secret_report(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Counts and digests of find_secrets."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return find_secrets(docs, reach).select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redacted(raw: bytes, reach: int = REACH) -> bytes:
    """The text with every span replaced by a mark of its kind; overlapping spans become one mark."""
    text, out, at = raw.decode(), [], 0
    for kind, s, e in scan_text(raw, reach):
        if kind == "endpoint":
            continue
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return ("".join(out) + text[at:]).encode()


def redact_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``docs`` with secrets masked in ``text`` (and ``n_chars``, where it is a column, recounted)."""
    names = docs.columns
    k = names.index("text")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter()
        for batch in batches:
            data, offsets = text_bytes(batch.column(k))
            hit = candidates(data, offsets)
            if len(hit):
                texts = batch.column(k).to_pylist()
                for i in hit:
                    if texts[i] is not None:
                        texts[i] = redacted(texts[i].encode(), reach).decode()
                batch = batch.set_column(k, names[k], pa.array(texts, batch.schema.field(k).type))
            yield batch

    out = docs.mapInArrow(mask, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*names) if "n_chars" in names else out
