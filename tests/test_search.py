"""The query sets of searches without an SQL twin, and the recall of the approximate index."""

import os

import numpy as np

from ragloom.operators import retrieval as R
from ragloom.operators.ivf import IvfIndex
from ragloom.plans import search
from ragloom.session import table
from ragloom.sinks.stores import TextTable

SF = os.environ.get("RAGLOOM_TEST_SF", "/root/testdata/sf0.001")


def test_query_sets(spark):
    ids = {r.vec_id for r in table(spark, SF, "embeddings").select("vec_id").collect()}
    want = {i for i in ids if i % 100 == 0}
    assert {r.query_id for r in search.ret2_clustered_search(spark, SF).collect()} == want
    found = {r.query_id for r in search.ret8_ret9_ret10_ret11_srt5_search(spark, SF).collect()}
    assert found and found <= want
    whole = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect() if r.item_id % 100 == 0}
    assert {r.query_id: r.text for r in search.hundredth_texts(spark, SF).collect()} == whole
    assert max(len(t.split()) for t in whole.values()) > 5


def test_vector_search_is_bounded(spark, monkeypatch):
    """A task makes few products at a time and gathers few hits; the rows are brute force's, equal scores by id."""
    monkeypatch.setattr(R, "GATHERED", 200)
    rng = np.random.default_rng(8)
    mat, vectors = R._unit(rng.normal(size=(90, 8))), R._unit(np.repeat(rng.normal(size=(700, 8)), 3, 0))
    vid = rng.permutation(len(vectors))
    sims = np.round(mat @ vectors.T, 9)
    monkeypatch.setattr(R, "PRODUCTS", 90 * 100)
    best, most = R._Best(mat, 7), 0
    for at in range(0, len(vectors), 350):
        best.see(np.arange(90), vectors[at : at + 350], vid[at : at + 350])
        most = max(most, best.n)
    got = list(best.hits(np.arange(90)))
    assert most <= 2 * 7 * 90 and max(len(x) for x in got) <= 200
    rows = [(q, v) for x in got for q, v in zip(x["query_id"].tolist(), x["vec_id"].tolist(), strict=True)]
    assert len(rows) == 7 * 90
    for q in range(90):
        want = sims[q][np.lexsort((vid, -sims[q]))][:7]
        assert sorted((sims[q][np.flatnonzero(vid == v)[0]] for p, v in rows if p == q), reverse=True) == want.tolist()


def test_clustered_recall(spark, tmp_path):
    """recall@10 against the exact search at three sizes of table, and the share of vectors read in full."""
    for sf in (SF, "/root/testdata/sf0.1"):
        vectors, asked = table(spark, sf, "embeddings"), search.hundredth_vectors(spark, sf)
        got = search.clustered(spark, sf).collect()
        want = {(r.query_id, r.vec_id) for r in R.vector_search(asked, vectors, k=10).collect()}
        assert want and len({(r.query_id, r.vec_id) for r in got} & want) >= 0.9 * len(want)
        assert max(r.vectors_read for r in got) <= vectors.count() / 5


def test_clustered_data(spark, tmp_path):
    """Vectors in groups: few cells are probed; deletions, replacements and later inserts show; a null vector is left out."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * 0.12).tolist()) for i in range(4000)]
    index = IvfIndex(spark, f"file://{tmp_path}/ivf")
    schema = "vec_id long, embedding array<float>"
    vectors = spark.createDataFrame([*rows, (9999, None)], schema).repartition(4)
    index.fit(vectors, cells=40, sample=1000)
    index.insert(vectors.filter("vec_id < 3000 or vec_id = 9999"), batch=0)
    index.insert(vectors.filter("vec_id >= 3000"), batch=1)
    index.insert(vectors.filter("vec_id = 7"), batch=1)  # a replay
    index.insert(spark.createDataFrame([(8, rows[9][1])], schema), batch=2)
    index.delete(spark.createDataFrame([(11,), (51,)], "vec_id long"))
    now = {**dict(rows), 8: rows[9][1]}
    del now[11], now[51]
    asked = spark.createDataFrame([(f"q{i}", rows[i][1]) for i in (9, 11, 13, 1234)], "query_id string, qvec array<float>")
    got = index.search(asked, k=10).collect()
    want = {(r.query_id, r.vec_id) for r in R.vector_search(asked, spark.createDataFrame(list(now.items()), schema), k=10).collect()}
    assert len({(r.query_id, r.vec_id) for r in got} & want) >= 0.95 * len(want)
    assert max(r.codes_read for r in got) < 1000 and max(r.vectors_read for r in got) < 400
    assert index.search(asked.limit(0)).collect() == []


def test_search_shuffles_what_was_asked(spark, tmp_path):
    """Marks of all chunks are not shuffled, words are counted in their row, and hits' texts are taken from the candidates' alone."""
    texts = ["b a b . b", "", "a", "c C c d", None]
    chunks = spark.createDataFrame([(i, "u", t) for i, t in enumerate(texts)], "chunk_id long, user_id string, content string")
    asked = R.asked_terms(spark.createDataFrame([(1, "B c")], "query_id long, text string"))
    got = R.matching_postings(chunks, asked)
    assert "Exchange" not in got.filter("term = ''")._jdf.queryExecution().executedPlan().toString()
    every = R.postings(chunks).filter("term in ('', 'b', 'c')").select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.collect()))
    rows = [(0, "u", 0, "h0", 1, None), (1, "u", 1, "h1", 1, 0), (2, "u", 2, "h0", 1, 7)]
    spark.createDataFrame(rows, "chunk_id long, user_id string, document_id long, content_hash string, page_number int, parent_chunk_id long").write.parquet(f"file://{tmp_path}/c")
    spark.createDataFrame([("h0", "x"), ("h1", "y"), ("h2", "z")], "content_hash string, content string").write.parquet(f"file://{tmp_path}/p")
    hits = spark.createDataFrame([(5, "u", i, 1.0) for i in (0, 1, 2, 9)], "query_id long, user_id string, chunk_id long, score double")
    out = R.hydrate(hits, spark.read.parquet(f"file://{tmp_path}/c"), spark.read.parquet(f"file://{tmp_path}/p"))
    assert not [f for f in out.inputFiles() if str(tmp_path) in f]
    assert sorted((r.chunk_id, r.content, r.parent_content) for r in out.collect()) == [(0, "x", None), (1, "y", "x"), (2, "x", None)]


def test_text_table_moves_texts_once(spark, tmp_path):
    """An insertion shuffles chunks and terms, no row for a word; a chunk without a tenant is found; a search shuffles the asked blocks alone."""
    rows = [(f"c{i}", f"d{i}", None if i == 7 else f"u{i % 2}", " ".join(f"w{(i + 1) * j % 97} {j % 10}" for j in range(400)) + " seven" * (i == 7)) for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, user_id string, content string")
    store = spark._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def shuffled() -> int:
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    index = TextTable(spark, f"file://{tmp_path}/text", range_chunks=20)
    before = shuffled()
    index.insert(chunks.filter("chunk_id < 'c4'"))
    index.insert(chunks.filter("chunk_id >= 'c4'"))
    made = shuffled() - before
    words = 60 * 800
    assert made < words / 10, made
    asked = spark.createDataFrame([(1, None, "w5 seven")], "query_id int, user_id string, text string")
    before = shuffled()
    got = {(r.chunk_id, r.score) for r in index.search(asked, 10, tenant=False, digits=9).collect()}
    assert shuffled() - before < index.blocks.read().count() / 2
    assert got == {(r.chunk_id, r.score) for r in R.bm25(asked, R.postings(chunks), 10, tenant=False, digits=9).collect()} and "c7" in dict(got)
