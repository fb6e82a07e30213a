"""Plug-ins, stores, keyed state as streams and the agent's loop."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from ragloom.operators import agent, clients, metrics
from ragloom.operators import retrieval as R
from ragloom.session import kept
from ragloom.sinks.stores import TextTable, VectorTable
from ragloom.streaming import operators as S


class Fixed:
    def __init__(self, value):
        self.value = value

    def encode(self, texts):
        return self.value and [self.value] * len(texts)

    def rerank(self, query, documents):
        if self.value is None:
            raise ConnectionError
        return [float(len(d)) for d in documents]

    def complete(self, prompt):
        return prompt.upper()


def test_protocols():
    assert isinstance(Fixed(1), clients.Embedder) and isinstance(Fixed(1), clients.Reranker) and isinstance(Fixed(1), clients.LanguageModel)
    assert isinstance(clients.Memory(), clients.ObjectStorage) and not isinstance(Fixed(1), clients.Recogniser)
    for table in (VectorTable, TextTable):
        assert all(hasattr(table, name) for name in ("insert", "search", "delete_documents"))


def test_embedding_chain(spark):
    texts = spark.createDataFrame([(i, f"t{i % 3}" if i else None) for i in range(10)], "id int, text string")
    made = clients.embed(texts, {"down": Fixed(None), "api": Fixed([0.5, 0.5])}, 2)
    assert {(r.id, r.source) for r in made.collect()} == {(i, "api" if i else None) for i in range(10)}
    lone = clients.embed(texts, {}, 8).filter("id = 4").first()
    assert lone.source == "dummy" and lone.embedding == pytest.approx(clients.DummyEmbedder(8).encode(["t1"])[0])
    cache = clients.cache_rows(made, F.lit("2024-01-01").cast("timestamp"))
    assert cache.count() == 3
    again = clients.embed(texts, {}, 2, S.live_entries(cache, F.lit("2024-01-05").cast("timestamp")))
    assert {r.source for r in again.collect()} == {"cache", None}
    late = S.live_entries(cache, F.lit("2024-01-09").cast("timestamp"))
    assert late.count() == 0
    asked = spark.range(2).select(clients.ask(F.when(F.col("id") == 1, "hi"), Fixed(1)).alias("x"))
    assert sorted(str(r.x) for r in asked.collect()) == ["HI", "None"]


CHUNKS = [("c1", "d1", "u", "spark and flink compared at length"), ("c2", "d1", "u", "flink alone"), ("c3", "d2", "u", "spark streaming of spark"), ("c4", "d3", "v", "spark and flink for another tenant")]


def chunk_table(spark):
    rows = [(c, u, d, "h" + c, 1, None, t) for c, d, u, t in CHUNKS]
    return spark.createDataFrame(rows, "chunk_id string, user_id string, document_id string, content_hash string, page_number int, parent_chunk_id string, content string")


def test_search_decomposes(spark):
    chunks = chunk_table(spark)
    pool = chunks.select("content_hash", "content")
    vectors = chunks.select(F.col("chunk_id").alias("vec_id"), "user_id").join(clients.embed(chunks.select("chunk_id", "content"), {}, 8, column="content").select(F.col("chunk_id").alias("vec_id"), "embedding"), "vec_id")
    queries = spark.createDataFrame([(1, "u", "spark和flink的区别", None), (2, "v", "flink", "d9")], "query_id int, user_id string, text string, collection_id string")
    found = R.search(queries.drop("collection_id"), chunks, pool, vectors, dim=8).collect()
    assert {r.query_id for r in found} == {1, 2} and all((r.user_id == "v") == (r.chunk_id == "c4") for r in found)
    assert {r.chunk_id for r in found if r.query_id == 1} == {"c1", "c2", "c3"} and {r.rerank_source for r in found if r.query_id == 1} == {"vector"}
    assert [r.rerank_source for r in found if r.query_id == 2] == ["fusion"]  # a lone candidate
    by_client = R.search(queries.drop("collection_id"), chunks, pool, vectors, dim=8, client=Fixed(1)).filter("query_id = 1").orderBy(F.desc("score")).collect()
    assert [r.chunk_id for r in by_client] == ["c1", "c3", "c2"] and by_client[0].score == 34 and by_client[0].rerank_source == "client"
    failed = R.search(queries.drop("collection_id"), chunks, pool, vectors, dim=8, client=Fixed(None)).filter("query_id = 1")
    assert {r.rerank_source for r in failed.collect()} == {"vector"}
    inside = chunks.withColumn("collection_id", F.col("document_id"))
    assert {r.query_id for r in R.search(queries, inside, pool, vectors, dim=8).collect()} == {1}
    history = queries.drop("collection_id").filter("query_id = 1").withColumn("text", F.lit("它的性能")).withColumn("history", F.array(F.lit("flink的索引")))
    assert R.search(history, chunks, pool, vectors, dim=8).count() == 3


def test_stores(spark, tmp_path):
    chunks = chunk_table(spark)
    text = TextTable(spark, f"file://{tmp_path}/text")
    text.insert(chunks.filter("chunk_id <> 'c3'"))
    text.backfill(chunks)
    asked = spark.createDataFrame([(1, "u", "spark flink"), (2, "v", "spark")], "query_id int, user_id string, text string")
    hits = lambda: {(r.query_id, r.chunk_id): round(r.score, 9) for r in text.search(asked).collect()}
    want = {(r.query_id, r.chunk_id): round(r.score, 9) for r in R.bm25(asked, R.postings(chunks)).collect()}
    assert hits() == want
    text.insert(chunks.filter("chunk_id = 'c2'").withColumn("content", F.lit("replaced by words")))
    assert (1, "c2") not in hits() and text.postings().filter("term = ''").count() == 4
    text.delete_documents(spark.createDataFrame([("d2",)], "document_id string"))
    assert text.postings().filter("term = ''").count() == 3
    left = {c: t for c, d, _, t in CHUNKS if d != "d2"} | {"c2": "replaced by words"}
    now = chunks.filter("document_id <> 'd2'").drop("content").join(spark.createDataFrame(list(left.items()), "chunk_id string, content string"), "chunk_id")
    want = {(r.query_id, r.chunk_id): round(r.score, 9) for r in R.bm25(asked, R.postings(now)).collect()}
    assert hits() == want
    text.rewrite()
    assert hits() == want and text.stale.read().count() == 0
    vectors = VectorTable(spark, f"file://{tmp_path}/vectors")
    rows = clients.embed(chunks, {}, 4, column="content").withColumn("snippet", F.repeat(F.col("content"), 30))
    vectors.insert(rows)
    assert vectors.read().agg(F.max(F.length("snippet"))).first()[0] == 500
    found = vectors.search(spark.createDataFrame([(1, "u", clients.DummyEmbedder(4).encode([CHUNKS[0][3]])[0])], "query_id int, user_id string, qvec array<float>"), 2).collect()
    assert len(found) == 2 and max(found, key=lambda r: r.score).chunk_id == "c1"
    vectors.delete_documents(spark.createDataFrame([("d1",)], "document_id string"))
    ids = spark.createDataFrame([("c1",), ("c3",)], "chunk_id string")
    assert {r.chunk_id: any(r.embedding) for r in vectors.vectors(ids, 4).collect()} == {"c1": False, "c3": True}
    assert vectors.vector_of_hash(spark.createDataFrame([("hc3",), ("none",)], "content_hash string")).count() == 1


def test_block_max_postings(spark, tmp_path):
    """Same rows as the plain search, with and without tenants, from few of the blocks."""
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(f"c{i}", f"d{i // 3}", f"u{i % 2}", " ".join(rng.choices(vocab, weights, k=rng.randint(5, 120)) + (["rare"] * 5 if i % 97 == 0 else []))) for i in range(1500)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, user_id string, content string")
    index = TextTable(spark, f"file://{tmp_path}/text", range_chunks=32)
    index.insert(chunks.filter("chunk_id < 'c5'"))
    index.insert(chunks.filter("chunk_id >= 'c4'"))
    asked = spark.createDataFrame([(1, "u0", "rare"), (2, "u1", "w0 w5 rare w17 w40"), (3, "u1", "nowhere"), (4, "u0", " ".join(vocab[:30]))], "query_id int, user_id string, text string")
    hits = lambda found: {(r.query_id, r.chunk_id, r.score) for r in found.collect()}
    plain = kept(R.postings(chunks), "plain")
    for tenant in (True, False):
        assert hits(index.search(asked, 10, tenant, digits=9)) == hits(R.bm25(asked, plain, 10, tenant=tenant, digits=9))
    pairs = spark.createDataFrame([(1, "u0", "w0 w1"), (2, "u1", "w5 rare w2"), (3, "u1", "w3 nowhere"), (4, "u0", "w7")], "query_id int, user_id string, text string")
    for tenant in (True, False):
        found = hits(R.cover_rank(pairs, chunks, 10, 9, tenant))
        assert hits(index.cover_search(pairs, 10, tenant, 9)) == found and len(found) > 20
    read, all_ = index.blocks_read(asked.filter("query_id = 1"), 3, tenant=False)
    assert 0 < read < all_
    assert index.postings().count() == plain.count()


def test_cover_density(spark):
    """Against the plain definition: covers that hold no smaller one."""
    rng = random.Random(2)
    rows = []
    for i in range(60):
        need = rng.randint(1, 4)
        pos = sorted(rng.sample(range(40), rng.randint(1, 14)))
        rows.append((i, need, [(p, rng.randrange(need)) for p in pos]))
    want = {}
    for i, need, at in rows:
        holds = lambda a, b: len({n for _, n in at[a : b + 1]}) == need  # noqa: B023, E731
        covers = [(a, b) for a in range(len(at)) for b in range(a, len(at)) if holds(a, b)]
        least = [(a, b) for a, b in covers if not any((c, d) != (a, b) and c >= a and d <= b for c, d in covers)]
        want[i] = sum(0.1 / (1 + at[b][0] - at[a][0] - (b - a)) for a, b in least)
    got = spark.createDataFrame(rows, "i int, need int, at array<struct<pos:int,name:int>>").select("i", R.cover_density(F.col("at"), F.col("need")).alias("x")).collect()
    assert {r.i: r.x for r in got} == pytest.approx(want)


def test_last_result(spark, tmp_path):
    kept = metrics.LastResult(spark, f"file://{tmp_path}/eval")
    assert kept.load() is None
    kept.save(spark.createDataFrame([(1, 0.5, 1.0, 1.0, 0.7)], "query_id int, recall_5 double, recall_10 double, mrr double, ndcg_10 double"))
    means, details = kept.load()
    assert means.first().recall_at_5 == 0.5 and details.count() == 1


def plain_windows(rows, limit, span):
    """allowed by event; rows(event, user, second), a missing second is 1970."""
    want, state = {}, {}
    for i, u, s in sorted(rows, key=lambda r: (r[2] or 0, r[0])):
        opened, n = state.get(u, (None, 0))
        if opened is None or (s or 0) >= opened + span:
            opened, n = s or 0, 0
        state[u] = (opened, n + 1)
        want[i] = n + 1 <= limit
    return want


@pytest.mark.parametrize(("users", "seconds", "limit", "span", "spans"), [([1, 2, None], 5000, 50, 600, 2), ([None], 100_000, 3, 600, 1), ([None, 1], 3000, 1, 7, 3), ([7, 8, 9, None], 10**6, 2, 3600, 16)])
def test_rate_limit(spark, users, seconds, limit, span, spans):
    """Against a plain loop, with null users first, last and alone, times before 1970 and missing ones, ranges of few windows."""
    rng = random.Random(span)
    rows = [(i, rng.choice(users), rng.randrange(-seconds // 3, seconds) if rng.random() > 0.01 else None) for i in range(2000)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
    assert {r.event_id: r.allowed for r in S.rate_limit(events, limit, span, spans).collect()} == plain_windows(rows, limit, span)
    assert S.rate_limit(events.limit(0)).collect() == []


def test_rate_limit_spreads_a_hot_user(spark):
    """One user with a million events: the plain loop's result, from many tasks."""
    n = 10**6
    events = spark.range(n).select(F.col("id").alias("event_id"), F.lit(1).cast("long").alias("user_id"), F.timestamp_seconds(F.col("id") * 7919 % 3_000_003).alias("ts"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a million rows would fit one task
    try:
        got = S.rate_limit(events, 100, 600).select("event_id", "allowed", F.spark_partition_id().alias("part")).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = plain_windows([(i, 1, i * 7919 % 3_000_003) for i in range(n)], 100, 600)
    assert len(got) == n and all(want[i] == a for i, a in zip(got["event_id"], got["allowed"], strict=True))
    assert got.groupby("part").size().max() < n / 2 and 0 < got["allowed"].sum() < n


def test_streams(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    rows = [(i, i % 3, f"2024-01-01 00:{i % 60:02d}:00", ["pending", "pending", "parsing", "ready", "failed"][i // 12]) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string, status string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(source)
    read = lambda: spark.readStream.schema(events.schema).parquet(source)

    def run(df, name, mode="append"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    changes = run(S.status_changes_stream(read(), "user_id", "status", "event_id"), "changes")
    assert sorted((r.user_id, r.status) for r in changes) == sorted((u, s) for u in range(3) for s in ("pending", "parsing", "ready"))
    sink = S.UpsertSink(spark, f"file://{tmp_path}/table", "event_id long, user_id long, ts timestamp, status string", ["event_id"], "user_id")
    S.ingest(read(), sink, f"{tmp_path}/ingest").awaitTermination()
    assert sink.table.read().count() == 60
    sink(events.withColumn("status", F.lit("again")), 0)  # the same batch once more
    assert sink.table.read().filter("status = 'again'").count() == 0
    sink(events.filter("event_id < 3").withColumn("status", F.lit("new")), 1)
    assert sink.table.read().count() == 60 and sink.table.read().filter("status = 'new'").count() == 3
    lock = S.JobLock(spark, f"file://{tmp_path}/lock")
    assert lock.acquire() and not lock.acquire()
    lock.release()
    assert lock.acquire()
    other = S.JobLock(spark, f"file://{tmp_path}/lock", seconds=0.5)
    time.sleep(1)
    lock.renew()
    assert not other.acquire()
    time.sleep(1)
    assert other.acquire()  # its holder is taken for dead


def test_windows_as_streams(spark, tmp_path):
    """Streams say what the batch says, over several micro-batches; a lock is given again after its time; state goes."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rng = random.Random(5)
        rows = sorted((rng.randrange(20_000), i, rng.choice([1, 2, 3, None])) for i in range(300))
        events = spark.createDataFrame([(i, u, s) for s, i, u in rows], "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
        silent = spark.createDataFrame([(1000 + n, 9, 40_000 + n) for n in range(2)], "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
        parts = [events.filter(F.col("ts") < F.timestamp_seconds(F.lit(7000))), events.filter(F.col("ts") >= F.timestamp_seconds(F.lit(7000))), silent.limit(1), silent.filter("event_id = 1001")]
        for n, part in enumerate(parts):
            part.coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}")
        read = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
        whole = events.unionByName(silent)
        for name, stream, batch in (("limits", S.rate_limit_stream(read, 3, 600), S.rate_limit(whole, 3, 600)), ("locks", S.processing_lock_stream(read, "user_id", 300), S.processing_lock(whole, "user_id", 300))):
            query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
            query.awaitTermination()
            want = {tuple(r) for r in batch.collect()}
            assert {tuple(r) for r in spark.table(name).collect()} == want and len(want) == 302
            rows_kept = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
            assert max(rows_kept) >= 4 > rows_kept[-1]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_alerts(spark, tmp_path):
    """Ranks of the sketches' quantiles, the sustained rule, and a stream that says what the batch says."""
    rng = random.Random(4)
    rows = [(i, float(rng.expovariate(1)), "error" if rng.random() < 0.04 else "ok", i * 30_000 // 20_000) for i in range(20_000)]
    rows += [(90_000 + i, 5.0, "error" if i % 7 == 0 else "ok", 6000 + i * 5) for i in range(60)] + [(99_999, None, "ok", 9000), (99_998, 0.1, "ok", 60_000)]
    events = spark.createDataFrame(rows, "event_id long, value double, event_type string, s long").select("event_id", "value", "event_type", F.timestamp_seconds("s").alias("ts"))
    got = {r.start_s: r for r in S.alerts(events, minutes=100).collect()}
    values = sorted(r[1] for r in rows[:20_000] if r[3] < 6000)
    rank = sum(v <= got[0].p95 for v in values) / len(values)
    assert abs(rank - 0.95) < 0.01 and not got[0].error_alert and not got[60_000].slow_alert
    five = {r.start_s: r for r in S.alerts(events).collect()}
    lone = S.alerts(events.filter("event_id between 90000 and 90059")).collect()
    assert all(r.slow_alert and r.error_alert and r.p95 == 5.0 for r in lone)
    events.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    read = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    S.alerts(read, late="10 minutes").writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    streamed = {r.start_s: r for r in spark.table("alerts").collect()}
    assert len(streamed) >= len(five) - 2 and all(five[k].n == r.n and five[k].errors == r.errors and five[k].slow_alert == r.slow_alert for k, r in streamed.items())


def test_alerts_are_exact(spark):
    """Many values in a minute and a window; ties, nulls and ranks that are whole numbers."""
    rng = random.Random(5)
    rows = [(rng.choice([None, round(rng.expovariate(1), 3)]), s) for s in (10, 70, 400) for _ in range(3000)] + [(float(v), 900) for v in range(1, 41)] + [(7.0, 1300)] * 5 + [(None, 1600)]
    got = S.alerts(spark.createDataFrame(rows, "value double, s long").select("value", F.lit("ok").alias("event_type"), F.timestamp_seconds("s").alias("ts"))).collect()

    def want(at) -> float | None:
        v = sorted(x for x, s in rows if x is not None and at(s))
        return v[-(-len(v) * 95 // 100) - 1] if v else None

    for r in got:
        minutes = [p for m in range(5) if (p := want(lambda s, m=m, r=r: s // 60 == r.start_s // 60 + m)) is not None]
        assert r.p95 == want(lambda s, r=r: s // 300 == r.start_s // 300) and r.slow_alert == (min(minutes) > 2 if minutes else None)
    assert sorted(r.start_s for r in got) == [0, 300, 900, 1200, 1500]


def test_places(spark):
    from ragloom.operators import pool

    ids = random.Random(1).sample(range(-(10**9), 10**9), 3000)
    for range_rows in (50, 10**6):
        got = {r.id: r.place for r in pool.placed(spark.createDataFrame([(i,) for i in ids], "id long"), "id", range_rows).collect()}
        assert got == {x: n for n, x in enumerate(sorted(ids))}
    assert pool.placed(spark.createDataFrame([], "id long"), "id").collect() == []


def test_last_section():
    from ragloom.functions.text import last_section

    rng = random.Random(9)
    text = lambda n: "".join(rng.choices("ab ", k=n))
    for _ in range(200):
        sections, chunks = [text(rng.randint(1, 5)) for _ in range(rng.randint(0, 12))], [text(rng.randint(0, 30)) for _ in range(5)]
        assert last_section(sections, chunks) == [max((i for i, s in enumerate(sections, 1) if s in c), default=0) for c in chunks]
    took = []
    for n in (2500, 10_000):
        sections = [f"section {i} of a long document, with words {i * i}" for i in range(n)]
        began = time.process_time()
        assert last_section(sections, sections) == list(range(1, n + 1))
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.1


def test_agent_json():
    assert agent.extract_json('x ```json\n{"a": 1}``` y') == '{"a": 1}' and agent.extract_json('say {"a": {"b": [1]}} end') == '{"a": {"b": [1]}}' and agent.extract_json("none") is None


def test_agent_plans(spark):
    answers = [(1, "whole", '```json\n{"sub_queries": [{"query": "a", "tool": "magic"}, {"id": "z", "args": {"top_k": 200}, "depends_on": ["q1"]}, {}, {}]}\n```'), (2, "all of it", "no plan"), (3, "none", None)]
    got = {(r.run_id, r.step): (r.id, r.tool, r.query, r.top_k, r.depends_on) for r in agent.plan_steps(spark.createDataFrame(answers, "run_id int, query string, answer string")).collect()}
    assert got == {(1, 0): ("q1", agent.HYBRID, "a", 40, []), (1, 1): ("z", agent.HYBRID, "whole", 100, ["q1"]), (1, 2): ("q3", agent.HYBRID, "whole", 40, []), (2, 0): ("q1", agent.HYBRID, "all of it", 40, []), (3, 0): ("q1", agent.HYBRID, "none", 40, [])}


class Says:
    def __init__(self, answer):
        self.answer = answer

    def complete(self, prompt):
        return self.answer(prompt)


def test_agent_runs(spark):
    """Four questions in one table: one passes, one never does, one finds nothing, one is simple."""

    def hits(found):
        def search(asked):
            rows = asked.filter("query not like 'empty%' and query not like 'nothing%'").withColumn("x", F.explode(found))
            return rows.select("ask_id", F.lit(1).alias("rank"), F.concat("x", F.left("query", F.lit(1))).alias("chunk_id"), F.concat(F.lit("c"), F.repeat(F.col("x"), 150), "user_id", F.lit(" k="), F.col("top_k").cast("string")).alias("content"))

        return search

    def fulltext(asked):
        return asked.filter("query not like 'nothing%'").select("ask_id", F.lit(1).alias("rank"), F.lit("f").alias("chunk_id"), F.concat(F.lit("full "), F.col("top_k").cast("string")).alias("content"))

    tools = {agent.HYBRID: hits(F.array(F.lit("h"), F.lit("i"))), agent.FULLTEXT: fulltext}
    plan = json.dumps({"sub_queries": [{"id": "a", "query": "x one"}, {"id": "b", "query": "empty", "depends_on": ["a"]}, {"id": "c", "query": "x two"}]})
    seen = json.dumps({"pass": True, "scores": {"relevance": 5, "groundedness": 5, "consistency": 5}})
    low = json.dumps({"pass": False, "reason": "off", "scores": {"relevance": 1, "groundedness": 4, "consistency": 4}})
    questions = spark.createDataFrame([(1, "u", None, "good question", "complex"), (2, "v", None, "bad question", "complex"), (3, "v", None, "nothing here", "complex"), (4, "v", None, "easy", "simple")], "run_id int, user_id string, collection_id string, query string, intent string")
    got = {r.run_id: r for r in agent.run(questions, tools, Says(lambda p: plan if p.startswith("good") else None), Says(lambda p: "answer to " + p[-6:]), Says(lambda p: seen if p.startswith("good") else low if p.startswith("bad") else "broken")).collect()}
    assert (got[1].result, got[1].plan_steps, got[1].chunk_count, got[1].retry, got[1].relevance) == ("passed", 3, 3, 0, 5)
    assert [(c.tool, c.result_count) for c in got[1].tools_called] == [(agent.HYBRID, 2), (agent.FULLTEXT, 1), (agent.HYBRID, 0), (agent.HYBRID, 2)]
    assert (got[2].result, got[2].retry, got[2].answer, len(got[2].tools_called)) == ("max_retries_exhausted", 4, agent.NO_DATA, 4)
    assert (got[3].result, got[3].answer, got[3].chunk_count, got[3].retry) == ("parse_failed", agent.NO_DATA, 0, 0)
    assert got[4].intent == "simple" and got[4].result is None


def test_agent_retries_widen(spark):
    steps = agent.plan_steps(spark.createDataFrame([(1, "q", None)], "run_id int, query string, answer string"))
    verdict = lambda retry, r, g, c: spark.createDataFrame([(1, retry, r, g, c, "first")], "run_id int, retry int, relevance int, groundedness int, consistency int, original string")
    step = lambda *v: agent.adjust(steps, verdict(*v)).first()
    assert step(1, 2, 2, None).vector_weight == 0.5 and step(2, 4, 2, 4).tool == agent.FULLTEXT and step(2, 4, 2, 4).top_k == 60
    assert (step(2, 1, 2, 2).query, step(2, 1, 2, 2).top_k) == ("first", 100) and step(1, 1, 2, 2).top_k == 80
    assert (step(1, 3, 3, 1).top_k, step(1, 3, 3, 1).vector_weight) == (50, 0.6)
    assert (step(1, None, None, None).top_k, step(3, None, None, None).top_k, step(3, 1, 1, 1).vector_weight) == (40, 100, 0.5)


def test_agent_events(spark):
    traces = spark.createDataFrame([(1, "text", None, [("hybrid_search", 2)]), (2, None, "down", [])], "run_id int, answer string, error string, tools_called array<struct<tool:string,result_count:long>>")
    cited = spark.createDataFrame([(1, 2, "y", 0.5, "t"), (1, 1, "x", 1.0, "s")], "run_id int, place int, chunk_id string, score double, snippet string")
    got = agent.answer_events(traces, cited).orderBy("run_id", "seq").collect()
    assert [e.type for e in got if e.run_id == 1] == ["conversation", "status", "agent_step", "citations", "token", "done"]
    assert [e.type for e in got if e.run_id == 2] == ["conversation", "status", "error"]
    assert [x["chunk_id"] for x in json.loads(got[3].data)["data"]] == ["x", "y"] and json.loads(got[2].data) == {"type": "agent_step", "tool": "hybrid_search", "result_count": 2}
    assert agent.answer_events(traces.drop("tools_called"), cited).count() == 8
