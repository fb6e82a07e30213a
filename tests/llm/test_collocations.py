"""Phrases against plain counting, in one shard and in many with several levels of merging."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from ragloom.llm import collocations as C
from ragloom.llm import merge_tree as M

SCHEMA = "doc_id long, text string, lang string, block int, member long, key long, `rank` int, phrase string"


def plain(docs, least=10, top=2000, share=50):
    n, f = Counter(), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(words)
            f.update((lang, words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    gone = {(lang, part) for (lang, g), t in f.items() if len(g) == 3 and t >= least for part in (g[:2], g[1:]) if 100 * t >= share * f[lang, part]}
    out = []
    for (lang, g), a in f.items():
        if len(g) > 1 and a >= least and (lang, g) not in gone:
            cuts = [(1_000_000 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            out.append((lang, -score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    done = []
    for lang in {x[0] for x in out}:
        for rank, (_, s, a, phrase, l, r) in enumerate(sorted(x for x in out if x[0] == lang)[:top], 1):
            done.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -s))
    return sorted(done)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(12)
    vocab = ["".join(rng.choices("abcdefghiéß中", k=rng.randint(1, 9))) for _ in range(120)] + ["longword" * 90]
    weights = [1 / (i + 1) for i in range(len(vocab))]

    def prose(n):
        return "".join(w + rng.choice((" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\x0b", " New York City ")) for w in rng.choices(vocab, weights, k=n))

    out = [(1, None, "en"), (2, "", "en"), (3, " \t\n.,", None), (4, "One two three", None), (5, "a b", "")]
    out += [(10 + i, prose(rng.randint(1, 120)), rng.choice(("en", "en", "de", None, "und"))) for i in range(200)]
    out += [(300 + i, "Exact same text, again and again; word for word", "fr") for i in range(30)]
    out += [(500, "the same " * 8000 + " ".join(f"the same w{i}" for i in range(3000)), "en"), (500, prose(50), "de"), (None, prose(50), "en"), (None, prose(50), "en")]
    return out


@pytest.mark.parametrize(("blocks", "group"), [(None, 128), (18, 4)])
def test_collocations(spark, docs, blocks, group):
    frame = spark.createDataFrame([(i, t, lang, 1, 2, 3, 4, "p") for i, t, lang in docs], SCHEMA)
    got = sorted(tuple(r) for r in C.collocations(frame, blocks=blocks, group=group).collect())
    want = plain(docs)
    assert got == want
    assert {x[0] for x in want} == {"en", "de", "und", "fr"} and len(want) > 80


def test_top_and_least(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert sorted(tuple(r) for r in C.collocations(frame, least=3, top=7, share=90).collect()) == plain(docs, 3, 7, 90)


def test_large_counts(spark):
    """Products past 64 bits."""
    a, left, right = 4_000_000_007, 4_000_000_009, 5_000_000_029
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(C.exact_score("a", "l", "r")).first()[0]
    assert got == 1_000_000 * a * a // (left * right)


def test_empty(spark):
    assert C.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
    assert C.collocations(spark.createDataFrame([(1, None, None), (2, "a b", "en")], "doc_id long, text string, lang string")).collect() == []


def test_rows_of_all_levels():
    """Rows of the exchanges grow with the blocks, up to blocks of 100 TB and more."""
    for blocks in (8, 122, 128, 129, 5_000, 300_000, 25_000_000, 10**9):
        assert M.exchanged_rows(blocks) <= 2 * M.RANGES * blocks * 5
    assert M.exchanged_rows(25_000_000) < 5 * M.RANGES * 25_000_000
