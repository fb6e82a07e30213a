"""Block-max search against plain scoring of every document; block borders against all ways to cut."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ragloom.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, shard int, terms string, score long, rank int, item_id int"


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_words = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        hits = []
        for doc, bag in bags:
            m, score = 25 + (75 * bag.total() * n_docs) // max(1, n_words), 0
            for t in terms(text):
                if t in bag:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                hits.append((-score, doc if doc is not None else -math.inf))
        out += [(item, rank, None if doc == -math.inf else doc, -score) for rank, (score, doc) in enumerate(sorted(hits)[:k], 1)]
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefghijklé中9", k=rng.randint(1, 6))) for _ in range(500)] + ["extraordinarily" * 40]
    prose = lambda n: " ".join(rng.choices(vocab, [1 / (i + 1) for i in range(len(vocab))], k=n))
    docs = [(1, None), (2, ""), (3, " .,;\n"), (4, "The-quick_brown fox's THE"), (None, prose(30)), (5, prose(60)), (5, prose(60)), (6, prose(30_000)), (7, "same text here"), (7, "same text here")]
    docs += [(10 + i, prose(rng.randint(1, 200))) for i in range(300)] + [(400 + i, "Same text here, many times over") for i in range(40)]
    items = [(0, prose(12)), (1, prose(200)), (2, None), (3, ""), (4, "notthere"), (5, "same TEXT the the the"), (6, vocab[0]), (7, vocab[500]), (7, vocab[500]), (8, docs[30][1]), (9, "é 中 9"), (None, prose(5))]
    return docs, items


@pytest.mark.parametrize(("shard_bytes", "query_terms"), [(1 << 20, 1 << 16), (3000, 20)])
def test_search(spark, tables, shard_bytes, query_terms):
    docs, items = tables
    frame = spark.createDataFrame([(i, t, "en", 1, "t", 2, 3, 4) for i, t in docs], SCHEMA).repartition(3)
    index = L.build_index(frame, shard_bytes)
    got = [tuple(r) for r in L.search(index, spark.createDataFrame(items, "item_id long, text string"), query_terms=query_terms).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = plain(docs, list(dict.fromkeys(items)))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert len(want) > 60


def test_empty(spark, tables):
    none, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(tables[1], "item_id long, text string")
    assert L.search(L.build_index(none), items).collect() == []
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert L.search(L.build_index(some), items.limit(0)).collect() == []
    assert L.search(L.build_index(spark.createDataFrame([(1, None)], "doc_id long, text string")), items).collect() == []


def test_borders():
    """The dynamic programme against every way to cut a list."""
    rng = np.random.default_rng(2)
    for longest in (3, 64):
        sizes = np.array([1, 2, 3, 7, 10, 10, 9, 1, 5])
        impact = rng.integers(1, 1_000_000, sizes.sum())
        first, cost = np.cumsum(sizes) - sizes, 400_000
        n_blocks, lens = L.block_borders(impact, first, sizes, longest, cost)
        at = 0
        for i, n in enumerate(sizes.tolist()):
            own = impact[first[i] : first[i] + n]
            error = lambda cut: sum(int(own[a:b].max()) * (b - a) + cost for a, b in itertools.pairwise(cut)) - int(own.sum())  # noqa: B023, E731
            cuts = [(0, *c, n) for k in range(n) for c in itertools.combinations(range(1, n), k)]
            least = min(error(c) for c in cuts if all(b - a <= longest for a, b in itertools.pairwise(c)))
            mine = np.concatenate([[0], np.cumsum(lens[at : at + n_blocks[i]])]).tolist()
            assert mine[-1] == n and error(mine) == least and np.diff(mine).max() <= longest
            at += n_blocks[i]


def test_blocks_are_skipped():
    """A list head that one document tops leaves most blocks of a long common list unread."""
    from ragloom.llm.words import text_bytes
    import pyarrow as pa

    rng = random.Random(1)
    texts = [" ".join(["common"] + [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(5, 400))]) for _ in range(3000)] + ["rare common"] * 12
    parts = L._Parts()
    parts.add(np.arange(len(texts)), *text_bytes(pa.array(texts)))
    raw = pa.RecordBatch.from_arrays([pa.array([x]) for x in parts.row(0)], [x.split()[0] for x in L.RAW.split(", ")])
    built = next(L._blocked(iter([raw]), len(texts), raw.column(2)[0].as_py(), L.LONGEST, L.BLOCK_COST))
    shard = L.Shard({n: built.column(n)[0].as_py() for n in built.schema.names}, len(texts), raw.column(2)[0].as_py())
    query = L.Query(1, "rare common")
    scores, docs = shard.search(query.terms, np.array([5000, 100])[np.argsort([L.Query(0, t).terms[0] for t in ("rare", "common")])], 10, 0)
    assert len(docs) == 12 and set(shard.ids[docs]) == set(range(3000, 3012))
    assert shard.read < 200
