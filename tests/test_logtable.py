"""The table of runs: batches, replays, deletions, merges, old versions, two writers."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ragloom.sinks import logtable
from ragloom.sinks.logtable import LogTable

SCHEMA = "id long, grp int, text string"


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def files(path):
    return {str(p): p.stat().st_size for p in Path(path).rglob("*.parquet")}


def test_batches(spark, tmp_path):
    table = LogTable(spark, f"file://{tmp_path}/t", SCHEMA, ["id"], "grp")
    assert table.read().count() == 0 and table.versions() == []
    base = [(i, i % 3, f"old{i}") for i in range(5000)]
    table.upsert(make(spark, base), batch=0)
    before = files(tmp_path)
    table.upsert(make(spark, [(1, 1, "new1"), (5000, 2, "more")]), batch=1)
    table.upsert(make(spark, [(2, 0, "moved")]), batch=2)
    added = {k: v for k, v in files(tmp_path).items() if k not in before}
    assert sum(added.values()) < sum(before.values()) / 5 and set(before) <= set(files(tmp_path))  # nothing was rewritten
    table.upsert(make(spark, [(1, 1, "again")]), batch=1)  # a replay
    table.delete(spark.createDataFrame([(3,), (4,), (77_777,)], "id long"), batch=3)
    want = {i: (g, t) for i, g, t in base} | {1: (1, "new1"), 5000: (2, "more"), 2: (0, "moved")}
    del want[3], want[4]
    got = {r.id: (r.grp, r.text) for r in table.read().collect()}
    assert got == want
    assert {r.id for r in table.read(F.col("grp") == 2).collect()} == {i for i, (g, _) in want.items() if g == 2}
    assert table.read(version=0).count() == 5000
    table.compact()
    assert {r.id: (r.grp, r.text) for r in table.read().collect()} == want and len(table.state()["runs"]) == 1
    assert table.read(version=1).filter("id = 3").count() == 1  # readers of an older version
    table.expire(versions=1)
    assert len(table.versions()) == 1 and table.read().count() == len(want)
    assert not set(before) & set(files(tmp_path))
    table.upsert(make(spark, [(3, 0, "back")]), batch=4)
    assert table.read().filter("id = 3").first().text == "back" and table.state()["batch"] == 4


def test_tiers(spark, tmp_path, monkeypatch):
    """Many small batches leave few runs; what is written stays in proportion."""
    monkeypatch.setattr(logtable, "SMALL", 8)
    table = LogTable(spark, f"file://{tmp_path}/t", SCHEMA, ["id"], "grp")
    rng, want, written = random.Random(1), {}, 0
    make_run = table._write
    table._write = lambda rows: written_by(make_run(rows))

    def written_by(run):
        nonlocal written
        written += run["rows"] if run else 0
        return run

    for batch in range(18):
        ids = rng.sample(range(60), 5)
        if batch % 5 == 4:
            table.delete(spark.createDataFrame([(i,) for i in ids], "id long"), batch)
            want = {i: t for i, t in want.items() if i not in ids}
        else:
            table.upsert(make(spark, [(i, i % 2, f"{batch}") for i in ids]), batch)
            want |= {i: str(batch) for i in ids}
    assert {r.id: r.text for r in table.read().collect()} == want
    assert len(table.state()["runs"]) <= 9 and written <= 18 * 5 * 4


def test_two_writers(spark, tmp_path):
    one, two = (LogTable(spark, f"file://{tmp_path}/t", SCHEMA, ["id"], "grp") for _ in range(2))
    one.upsert(make(spark, [(1, 1, "a")]))
    commit, late = two._commit, []

    def after_the_other(change):
        def slow(state):
            if not late:
                late.append(1)
                one.upsert(make(spark, [(2, 1, "b")]))  # comes between reading and writing
            return change(state)

        commit(slow)

    two._commit = after_the_other
    two.upsert(make(spark, [(3, 1, "c")]))
    assert {r.id for r in one.read().collect()} == {1, 2, 3}
    with pytest.raises(Exception):
        one.read(version=99).count()
