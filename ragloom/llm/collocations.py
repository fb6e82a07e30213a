"""Phrase collocation mining with depth-limited count tries.

1. Each block of documents (a shard) counts its words, pairs and triples of words that follow each other inside a piece in
   a trie of depth three: a node knows its count, its parent (the phrase without its last word) and its suffix link (the
   phrase without its first word). Languages are separate subtrees: a word's symbol is a hash of word and language.
2. A node's key is a 64-bit hash of its path. Shards serialise their nodes sorted by key; lists are merged k ways, range by
   range of the key's prefix, level by level (``merge_tree``), and every shard is told the whole corpus' count of each of
   its nodes that stands ``least`` times or more. Ranges are over hashes of whole paths because a plain prefix of words may
   be hot: a common word's subtree grows with the corpus, a range doesn't.
3. The first shard that holds a frequent phrase reports it. All its parts occur in the same shard at least as often, so the
   counts of its left parts come from walking the trie up, those of its right parts from following suffix links. Triples
   also report the pairs inside them that they make redundant.
4. Scores are whole numbers, reckoned in decimals; each language's best ``top`` are ranked by salt first, then together.

Texts are shuffled to their blocks once; the two steps that need them read that exchange. Nothing is collected.

Defined cases: null and empty texts have no words; a null language is ``und``; repeated rows count each; ties in score and
count go by phrase; an empty table, or one without a frequent phrase, gives an empty result; other columns are ignored.
Different paths share a key only by chance: about n*n/2**65 pairs among n distinct phrases, which matters only if one of
them is frequent.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_blocks, block_count, enter, stored, to_blocks
from .merge_tree import BITS, GROUP, SENT, read_told, sent_rows, summed
from .sketches import range_cuts
from .words import Words, mix, pair, text_bytes

LEAST = 10
TOP = 2000
#: Parts into which a language's phrases fall for the first ranking.
SALTS = 64
#: kind 0: key of a pair that a triple makes redundant; 1: a shard's words of a language (in a); 2 and 3: phrases.
FOUND = "kind int, lang string, key long, phrase string, a long, l1 long, r1 long, l2 long, r2 long"

_PUNCT, BREAKS = np.zeros(256, bool), np.zeros(256, bool)
_PUNCT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BREAKS[:] = _PUNCT
BREAKS[[0x20, 0x09]] = True


class Trie:
    """The count trie of a shard; nodes of each depth are numbered in order of (parent, last word)."""

    def __init__(self, table: pa.Table):
        enter()
        data, offsets = text_bytes(table["text"])
        self.words = Words(data, offsets, lower=True, breaks=BREAKS)
        langs = table["lang"].combine_chunks().fill_null("und").dictionary_encode()
        langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
        self.langs = langs.dictionary.to_pylist()
        salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in self.langs] or [0], np.uint64)
        of_doc = langs.indices.to_numpy(zero_copy_only=False)
        self.lang = np.repeat(of_doc, self.words.counts)
        symbols = mix(self.words.hash ^ salt[self.lang])
        pieces = np.concatenate([[0], np.cumsum(_PUNCT[data])])[self.words.start] + np.repeat(np.arange(len(of_doc)) << 32, self.words.counts)
        next_ = pieces[1:] == pieces[:-1]  # the word after goes on with the piece

        self.symbols, self.at, ids, self.n1 = np.unique(symbols, return_index=True, return_inverse=True, return_counts=True)
        v = max(1, len(self.symbols))
        two = np.flatnonzero(next_)
        nodes, node_of, self.n2 = np.unique(ids[two] * v + ids[two + 1], return_inverse=True, return_counts=True)
        self.parent2, self.last2 = nodes // v, nodes % v  # the last word's node is also the suffix link
        place = np.full(len(ids), -1)
        place[two] = node_of
        three = two[:-1][two[1:] == two[:-1] + 1] if len(two) else two
        nodes, where, self.n3 = np.unique(place[three] * v + ids[three + 2], return_index=True, return_counts=True)
        self.parent3, self.last3 = nodes // v, nodes % v
        self.suffix3 = place[three[where] + 1]
        key2 = pair(self.symbols[self.parent2], self.symbols[self.last2])
        self.keys = [self.symbols, key2, pair(key2[self.parent3], self.symbols[self.last3])]

    def sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All nodes' keys in order, their counts, and the order."""
        keys = np.concatenate(self.keys)
        order = np.argsort(keys, kind="stable")
        return keys[order], np.concatenate([self.n1, self.n2, self.n3])[order], order

    def word(self, i: int) -> str:
        at = self.at[i]
        return self.words._data[self.words.start[at] : self.words.end[at]].tobytes().decode()


def _send(table: pa.Table, group: int) -> pa.Table:
    keys, counts, _ = Trie(table).sorted()
    return sent_rows(table["block"][0].as_py(), keys, counts, group)


def _report(docs: pa.Table, told: pa.Table, share: int) -> pa.Table:
    if not docs.num_rows:
        return _found([])
    trie = Trie(docs)
    keys, _, order = trie.sorted()
    cuts = range_cuts(keys, 64, BITS)
    count, own = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    for r, _, sums, first in read_told(told):
        count[order[cuts[r] : cuts[r + 1]]] = sums
        own[order[cuts[r] : cuts[r + 1]]] = first
    sizes = np.cumsum([len(k) for k in trie.keys])[:2]
    (f1, f2, f3), (_, own2, own3) = np.split(count, sizes), np.split(own, sizes)

    out = []
    pairs, triples = np.flatnonzero(own2), np.flatnonzero(own3)
    first, middle = trie.parent2[trie.parent3[triples]], trie.last2[trie.parent3[triples]]
    needed = np.unique(np.concatenate([trie.parent2[pairs], trie.last2[pairs], first, middle, trie.last3[triples]]))
    word = {i: trie.word(i) for i in needed.tolist()}
    name = lambda i: trie.langs[trie.lang[trie.at[i]]]
    none = [None] * len(pairs)
    say = lambda *x: [word[i] for i in x]
    long = lambda x: x.view(np.int64).tolist()
    a, b = trie.parent2[pairs], trie.last2[pairs]
    out += zip([2] * len(pairs), map(name, a), long(trie.keys[1][pairs]), (" ".join(say(*x)) for x in zip(a.tolist(), b.tolist(), strict=True)), f2[pairs].tolist(), f1[a].tolist(), f1[b].tolist(), none, none, strict=True)
    left, right, c = trie.parent3[triples], trie.suffix3[triples], trie.last3[triples]
    texts = (" ".join(say(*x)) for x in zip(first.tolist(), middle.tolist(), c.tolist(), strict=True))
    out += zip([3] * len(triples), map(name, first), long(trie.keys[2][triples]), texts, f3[triples].tolist(), f1[first].tolist(), f2[right].tolist(), f2[left].tolist(), f1[c].tolist(), strict=True)
    for part in (left, right):
        covered = part[100 * f3[triples] >= share * f2[part]]
        out += [(0, None, k, None, None, None, None, None, None) for k in np.unique(trie.keys[1][covered]).view(np.int64).tolist()]
    total = np.bincount(trie.lang, minlength=len(trie.langs))
    out += [(1, x, None, None, n, None, None, None, None) for x, n in zip(trie.langs, total.tolist(), strict=True)]
    return _found(out)


def _found(rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    fields = [x.split() for x in FOUND.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.table({name: pa.array(col, kinds[kind]) for (name, kind), col in zip(fields, cols, strict=True)})


def phrases(docs: DataFrame, least: int = LEAST, share: int = 50, blocks: int | None = None, group: int = GROUP) -> DataFrame:
    """``FOUND`` of docs(doc_id, lang, text), stored in the shared folder: every phrase of two or three words that stands
    ``least`` times, once, with the counts of its left and right parts for each cut."""
    blocks = blocks or block_count(docs)
    some = docs.filter(F.length("text") > 0).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    rows = as_blocks(some, blocks, F.xxhash64("doc_id", F.length("text"), F.left("text", F.lit(64))))
    told = summed(rows.groupBy("block").applyInArrow(lambda t: _send(t, group), SENT), blocks, least, group)
    told = to_blocks(told.withColumn("block", F.col("member").cast("int")), blocks)
    return stored(rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda a, b: _report(a, b, share), FOUND), "phrases")


def exact_score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) of columns of whole numbers, in decimals of 38 digits."""
    wide = lambda c: f"cast({c} as decimal(20, 0))"
    return F.expr(f"(1000000 * {wide(a)} * {wide(a)}) div ({wide(left)} * {wide(right)})")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = 50, blocks: int | None = None, group: int = GROUP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases that no longer one makes redundant."""
    found = phrases(docs, least, share, blocks, group)
    totals = found.filter("kind = 1").groupBy("lang").agg(F.sum("a").alias("n"))
    live = found.filter("kind >= 2").join(found.filter("kind = 0").select("key"), "key", "left_anti")
    cut = live.withColumn("s1", exact_score("a", "l1", "r1")).withColumn("s2", exact_score("a", "l2", "r2")).withColumn("second", F.coalesce(F.col("s2") < F.col("s1"), F.lit(False)))
    choice = lambda x: F.when(F.col("second"), F.col(f"{x}2")).otherwise(F.col(f"{x}1")).cast("long")
    rows = cut.select("lang", "phrase", "a", choice("l").alias("l"), choice("r").alias("r"), choice("s").alias("score"), F.pmod("key", F.lit(SALTS)).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    some = rows.withColumn("rank", place("lang", "salt")).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", place("lang")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = rf"""
WITH p AS (SELECT doc_id, lang, unnest(p) AS piece, unnest(range(len(p))) AS i FROM (SELECT doc_id, coalesce(lang, 'und') AS lang,
           regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\x0A-\x0D]') AS p FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g FROM w, (SELECT unnest([1, 2, 3])::BIGINT AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, g, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
e AS MATERIALIZED (SELECT lang, g, f AS a, j, g[1:j] AS lg, g[j + 1:] AS rg FROM f, (SELECT unnest([1, 2])::BIGINT AS j) WHERE k >= 2 AND f >= 10 AND j < k),
c AS (SELECT e.lang, e.g, e.a, e.j, l.f AS l, r.f AS r, (1000000 * e.a * e.a) // (l.f * r.f) AS score
      FROM e JOIN f l ON l.lang = e.lang AND l.g = e.lg JOIN f r ON r.lang = e.lang AND r.g = e.rg),
t AS (SELECT lang, f, unnest([g[1:2], g[2:3]]) AS g FROM f WHERE k = 3 AND f >= 10),
d AS (SELECT DISTINCT t.lang, t.g FROM t JOIN f b ON b.lang = t.lang AND b.g = t.g WHERE 100 * t.f >= 50 * b.f),
m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
s AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM m ANTI JOIN d USING (lang, g)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""
