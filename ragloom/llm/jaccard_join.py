"""Exact n-gram Jaccard join with adaptive multi-match prefixes, down to connected components.

1. A sharded count-min sketch of the shingles (``sketches``) tells, per document, how many of its shingles may occur
   in another document. A partner at Jaccard >= T shares at least ceil(T * n) of a document's n shingles, so a document
   with fewer possible repeats has no partner; the others are kept with all their shingles, one row for each distinct
   set (its class), whatever the number of copies.
2. Among these, shingles are ordered by document frequency. With t = ceil(T * n), two linked sets share at least k
   shingles among their first n - t + k ones. Each document picks its own k: it lengthens its prefix while the
   estimated candidates (the sum of the prefix's frequencies, divided by k) get cheap enough to pay for it. A pair is a
   candidate if it shares one shingle of the prefixes for k = 1, and must share min(k_a, k_b) shingles of the prefixes
   for that k, both cut to the overlap that its two sizes need, before it is verified.
3. Groups of near copies are first linked by stars: each prefix shingle pairs its documents with one pivot, a document
   in which it stands earliest (one with few rare shingles, thus near the middle of its group). Pairs must pass the
   same tests; verified links join components. Then every pair of documents that share prefix shingles and lie in
   different components so far goes through these tests. A pair inside one component adds nothing to reachability, so
   no link between different texts is lost and no group is expanded into all its pairs.

Defined cases: null or blank text has no shingles and its own component; repeated rows share a component; a null
doc_id gives a null component unless the text has copies with ids; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_blocks, block_count, discard, enter, fresh, input_bytes, release, stored, to_blocks
from .components import components
from .sketches import GROUP, LISTS, Repeated, merged, partition_sketch, width_bits
from .words import Words, text_bytes

WORDS = 5
#: Similarity threshold in hundredths.
PERCENT = 80
#: Longest multi-match level, and the cost of verifying a pair in units of reading one posting.
LEVELS = 4
VERIFY = 30
STARS = 3
#: 64-bit words of a set's parity bitmap.
BITMAP = 32


def _occurrences(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Every shingle's hash and document row, in document order."""
    enter()
    data, offsets = text_bytes(table["text"])
    words = Words(data, offsets, lower=True)
    h, at = words.windows(k)
    doc = np.searchsorted(words.first, at, "right") - 1
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        h, doc = np.concatenate([h, words.whole(short)]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    return h, doc


def _shingles(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their document rows, in document order."""
    h, doc = _occurrences(table, k)
    key = h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    a, b, key = h[order], doc[order], key[order]
    again = key[1:] == key[:-1]
    if (again & (b[1:] != b[:-1])).any():  # different pairs with one key
        order = np.lexsort((doc, h))
        a, b = h[order], doc[order]
        again = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    keep = np.ones(len(h), bool)
    keep[order[1:][again]] = False
    return h[keep], doc[keep]


def _sets(docs: pa.Table, found: pa.Table, k: int, width: int, percent: int) -> pa.Table:
    if not docs.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "class": pa.array([], pa.binary()), "tokens": pa.array([], pa.list_(pa.int64())), "bits": pa.array([], pa.list_(pa.int64()))})
    h, doc = _shingles(docs, k)
    rows = docs.num_rows
    n = np.bincount(doc, minlength=rows)
    hits = np.bincount(doc[Repeated(found, width)(h)], minlength=rows) if found.num_rows else np.zeros(rows, np.int64)
    keep = (100 * hits >= percent * n) & (n > 0)
    first = np.concatenate([[0], np.cumsum(n)])
    names, tokens, bits = [None] * rows, [None] * rows, [None] * rows
    for i in np.flatnonzero(keep).tolist():
        own = np.sort(h[first[i] : first[i + 1]])
        names[i] = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
        tokens[i] = own.view(np.int64)
        parity = np.bincount((own >> np.uint64(20)).astype(np.int64) % (64 * BITMAP), minlength=64 * BITMAP) & 1
        bits[i] = np.packbits(parity.astype(np.uint8)).view(np.int64)
    return pa.table({"doc_id": docs["doc_id"], "n": pa.array(n, pa.int64()), "class": pa.array(names, pa.binary()), "tokens": pa.array(tokens, pa.list_(pa.int64())), "bits": pa.array(bits, pa.list_(pa.int64()))})


def shingle_sets(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, blocks: int | None = None, group: int = GROUP) -> DataFrame:
    """doc_id, n and, for documents that may have a partner, class, tokens and bits (a parity bitmap); stored in the shared folder."""
    blocks, bits = blocks or block_count(docs), width_bits(input_bytes(docs))
    rows = as_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), blocks, F.xxhash64("doc_id", F.length("text")))
    sketch = rows.groupBy("block").applyInArrow(lambda t: partition_sketch(t["block"][0].as_py(), _occurrences(t, k)[0], bits, group), LISTS)
    found = to_blocks(merged(sketch, blocks, bits, group), blocks)
    sets = rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(lambda a, b: _sets(a, b, k, bits, percent), "doc_id long, n long, class binary, tokens array<long>, bits array<long>")
    return stored(sets, "sets")


def prefix_lists(classes: DataFrame, percent: int = PERCENT, levels: int = LEVELS) -> DataFrame:
    """cid, n, k (the document's own), alone (its shingles that no other has) and prefix: what follows these, for that k.

    Shingles are ordered by document frequency; sets without a shared shingle are left out.
    """
    each = classes.select("cid", "n", F.explode("tokens").alias("token"))
    shared = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    lists = each.join(shared, "token").groupBy("cid").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("list"))
    need = F.expr(f"({percent} * n + 99) div 100")
    base = lists.select("cid", "n", "list", need.alias("t"), (F.col("n") - F.size("list")).cast("int").alias("alone"))
    # the k-prefix has n - t + k shingles, of which the first `alone` ones occur nowhere else
    size = lambda k: F.greatest(F.lit(0), F.col("n") - F.col("t") + k - F.col("alone")).cast("int")
    posts = lambda k: F.expr(f"aggregate(slice(list, 1, cast(greatest(0, n - t + {k} - alone) as int)), 0D, (a, x) -> a + x.df - 1)")
    cost: Column = F.array_min(F.array(*(F.struct((posts(k) * (1 + VERIFY / k)).alias("cost"), F.lit(k).alias("k")) for k in range(1, levels + 1))))["k"]
    chosen = base.withColumn("k", F.least(cost, F.greatest(F.col("t"), F.lit(1))).cast("int"))
    return chosen.select("cid", "n", "k", "alone", F.transform(F.slice("list", F.lit(1), size(F.col("k"))), lambda x: x["token"]).alias("prefix"))


def prefixes(lists: DataFrame, percent: int = PERCENT, *more: str) -> DataFrame:
    """token, cid, n, pos (the token's place in the set's order, from 1) of the prefixes for k = 1."""
    size = F.greatest(F.lit(0), F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1 - F.col("alone")).cast("int")
    return lists.select("cid", "n", "alone", *more, F.posexplode(F.slice("prefix", F.lit(1), size)).alias("i", "token")).select("token", "cid", "n", (F.col("alone") + F.col("i") + 1).alias("pos"), *more)


def _need(n: Column, m: Column, percent: int) -> Column:
    """The least overlap of linked sets of these sizes."""
    return F.floor((percent * (n + m) + 99 + percent) / (100 + percent))


def _meets(a: str, b: str, percent: int) -> Column:
    """Sizes that allow the threshold, and a token that lies in both sets' prefixes for the overlap these two sizes need."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    need = _need(n, m, percent)
    return (n * 100 >= m * percent) & (m * 100 >= n * percent) & (F.col(f"{a}pos") <= n - need + 1) & (F.col(f"{b}pos") <= m - need + 1)


def _near_bits(a: str, b: str, percent: int) -> Column:
    """The symmetric difference is at least the number of bits in which the parity bitmaps differ."""
    differ = sum((F.bit_count(F.col(f"{a}bits")[i].bitwiseXOR(F.col(f"{b}bits")[i])) for i in range(BITMAP)), F.lit(0))
    total = F.col(f"{a}n") + F.col(f"{b}n")
    return differ <= total - 2 * _need(F.col(f"{a}n"), F.col(f"{b}n"), percent)


def _multi_match(a: str, b: str, percent: int) -> Column:
    """The prefixes for the smaller of both sets' k share that many tokens."""
    n, m, k = F.col(f"{a}n"), F.col(f"{b}n"), F.least(f"{a}k", f"{b}k")
    need = _need(n, m, percent)
    cut = lambda s, size: F.slice(F.col(f"{s}prefix"), F.lit(1), F.greatest(F.lit(0), size - need + k - F.col(f"{s}alone")).cast("int"))
    return F.size(F.array_intersect(cut(a, n), cut(b, m))) >= k


def verified(pairs: DataFrame, sides: DataFrame, percent: int = PERCENT) -> DataFrame:
    """u, v of the pairs that share enough prefix tokens and whose sets reach the threshold, in whole numbers."""
    side = lambda c: sides.select(*(F.col(x).alias(c if x == "cid" else f"{c}_{x}") for x in sides.columns))
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    if "u_bits" in both.columns:
        both = both.filter(_near_bits("u_", "v_", percent))
    met = F.size(F.array_intersect("u_tokens", "v_tokens"))
    return both.filter(_multi_match("u_", "v_", percent)).filter((100 + percent) * met >= percent * (F.col("u_n") + F.col("v_n"))).select("u", "v")


def class_links(classes: DataFrame, percent: int = PERCENT, levels: int = LEVELS, stars: int = STARS) -> DataFrame | None:
    """cid, root of the classes that have links; None if no class can have one."""
    lists = prefix_lists(classes, percent, levels)
    sides = stored(classes.join(lists.drop("n"), "cid"), "sides")
    release(sides.sparkSession)
    roots = None
    for turn in range(stars + 1):
        own = sides.select("cid", "n", "alone", "prefix", *(["bits"] if turn == stars else []))
        own = own.withColumn("root", F.col("cid")) if roots is None else own.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        rows = prefixes(own, percent, "root", *(["bits"] if turn == stars else []))
        named = lambda df, side, *more: df.select("token", *(F.col(c).alias(f"{side}{c}") for c in ("cid", "n", "pos", "root", *more)))
        groups = rows.groupBy("token").agg(F.min(F.struct("pos", F.xxhash64("cid", F.lit(turn)).alias("o"), "cid", "n", "root")).alias("p"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
        if turn < stars:
            pivots = named(groups.select("token", "p.*"), "b_")
            met = named(rows, "a_").join(pivots, "token").filter((F.col("a_root") != F.col("b_root")) & _meets("a_", "b_", percent))
            pairs = met.select(F.least("a_cid", "b_cid").alias("u"), F.greatest("a_cid", "b_cid").alias("v")).distinct()
        else:
            live = rows.join(groups.select("token"), "token", "left_semi")
            a, b = named(live, "a_", "bits"), named(live, "b_", "bits")
            met = a.join(b, (a["token"] == b["token"]) & (F.col("a_root") < F.col("b_root")) & _meets("a_", "b_", percent) & _near_bits("a_", "b_", percent))
            pairs = met.select(F.col("a_cid").alias("u"), F.col("b_cid").alias("v")).distinct()
        new = stored(verified(pairs, sides, percent), "links")
        if new.isEmpty():
            discard(new)
            continue
        edges = new if roots is None else new.unionByName(roots.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
        found = components(edges)
        discard(new, *([] if roots is None else [roots]))
        roots = found
    discard(sides)
    return roots


def jaccard_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, levels: int = LEVELS) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    sets = shingle_sets(docs, k, percent)
    release(docs.sparkSession)  # the texts' exchange
    some = sets.filter(F.col("class").isNotNull())
    classes = stored(some.groupBy("class").agg(F.min("doc_id").alias("label"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("bits").alias("bits")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    roots = class_links(classes.select("cid", "n", "tokens", "bits"), percent, levels)
    named = classes.select("class", "cid", "label")
    if roots is not None:
        rooted = named.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        least = rooted.groupBy("root").agg(F.min("label").alias("component_id"))
        named = rooted.join(least, "root").select("class", "component_id")
    else:
        named = named.select("class", F.col("label").alias("component_id"))
    return sets.select("doc_id", "n", "class").join(named, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with only the smallest doc_id of each component; rows without doc_id stay, repeated rows become one."""
    keep = fresh("keep", docs.columns)
    found = stored(jaccard_components(docs, percent=percent).filter("doc_id = component_id").select(F.col("doc_id").alias(keep)), "kept")
    kept = docs.join(found, F.col("doc_id").cast("long") == F.col(keep), "left_semi")
    if not found.groupBy(keep).count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.filter(F.col("doc_id").isNull()))


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.c + b.c - i)),
r AS (SELECT x AS doc_id, x AS other FROM l UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.other)
SELECT w.doc_id, coalesce(n.c, 0) AS n_shingles, least(w.doc_id, coalesce(m.o, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS o FROM r GROUP BY 1) m USING (doc_id)
"""
