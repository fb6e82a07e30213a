"""The counting rules against plain Python and the bands on texts of known kind, on hard small tables."""

from __future__ import annotations

import base64
import random
import re

import pytest
import zstandard

from ragloom.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, ratio string, kept boolean, n_words int"


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    where: dict[tuple, list[int]] = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + j for at in where.values() if len(at) > 1 for i in at for j in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), failed


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefghijéß中", k=rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    passage = prose(9)
    rows = [(1, None), (2, ""), (3, " \n\t \n"), (4, "one"), (5, "a\na\n a\na \n\n\nb\x0cb\nb\x0cb"), (6, "#*$%&|<> " * 30), (7, "same " * 100), (7, prose(30)), (None, prose(25)), (8, prose(30)), (8, None)]
    rows += [(20 + i, "\n".join(f"{prose(rng.randint(1, 30))}\n{passage}" for _ in range(rng.randint(1, 6)))) for i in range(25)]
    rows += [(60, prose(40_000)), (61, "x" * 300_000), (62, " ".join(["word"] * 60_000)), (63, prose(19)), (64, prose(20))]
    return rows


def test_counts(spark, texts):
    got = Q.quality_rules(spark.createDataFrame([(i, t, "en", "r", True, 1) for i, t in texts], SCHEMA)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted((tuple(r[:7]) for r in got), key=key) == sorted(((i, *plain(t)) for i, t in texts), key=key)
    assert not any(r.kept for r in got if r.base_failed)
    assert sum(r.n_repeat_words > 0 for r in got) > 10


def test_bands(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    noise = lambda n: " ".join(base64.b64encode(rng.randbytes(9)).decode() for _ in range(n))
    # single words that come back, no window of eight twice: only compression sees it
    dull = " ".join(rng.choice(("yes", "no", "maybe", "never")) + "abcdefghijklmnopqrstuvwxyz" * 8 for _ in range(60))
    rows = [(1, prose(25)), (2, prose(300)), (3, prose(30_000)), (4, noise(2000)), (5, dull), (6, prose(3000) + " " + noise(100)), (7, prose(3000) + " " + noise(1500))]
    got = {r.doc_id: r for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if r.kept} == {1, 2, 3, 6}
    raw = rows[6][1].encode()
    assert got[7].ratio == len(zstandard.ZstdCompressor(level=3).compress(raw)) / len(raw)
    assert got[7].n_chunks == -(-len(raw) // 4096) and got[7].n_bad_chunks >= 4
    low, high = Q.BANDS[6][1:]
    assert low < got[7].ratio < high  # the chunks alone reject it


def test_empty(spark):
    assert Q.quality_rules(spark.createDataFrame([], "doc_id long, text string")).collect() == []
