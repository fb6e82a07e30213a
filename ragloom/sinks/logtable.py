"""A keyed table of runs: a batch writes in proportion to itself, readers of older versions are left alone.

Every change appends a run, a parquet folder of rows and of tombstones (keys that are gone) that is partitioned by one
column. Runs of like size merge: as soon as ``FAN`` neighbours are of one tier they become one run of the next, so a row is
rewritten once per tier, and a table of n batches has some log(n) runs. The oldest run, which holds most rows, is
read as it is but for the keys that later runs hold; later runs give each key's last row. A tombstone goes when it merges
into the oldest run.

A version is one small file in ``_log`` that lists its runs. It is made last, by a call that fails if the file is there, so
a version is whole or absent, and of two writers one starts again from the newer version. What a version no longer lists stays
on disk until ``expire``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Runs of one tier that merge, and rows of the smallest tier.
FAN = 4
SMALL = 1000
TRIES = 20


class LogTable:
    """``schema`` with unique ``key`` columns; ``by`` is the column that folders are partitioned by, if any.

    Without ``deal`` rows are written by the tasks that made them, not dealt by ``by`` first: for large rows that many tasks make."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], by: str | None, deal: bool = True):
        self.spark, self.path, self.schema, self.key, self.by, self.deal = spark, path.rstrip("/"), schema, key, by, deal and by is not None
        self.columns = spark.createDataFrame([], schema).columns

    # --- versions ---

    def _place(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), place

    def versions(self) -> list[int]:
        fs, place = self._place("_log")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(place) if s.getPath().getName().endswith(".json")) if fs.exists(place) else []

    def state(self, version: int | None = None) -> dict:
        """{version, batch (the last one applied), runs (oldest first: name, rows), note}."""
        found = self.versions() if version is None else [version]
        if not found:
            return {"version": -1, "batch": -1, "runs": [], "note": {}}
        fs, place = self._place(f"_log/{found[-1]:012d}.json")
        jvm = self.spark._jvm
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(place)))
        try:
            return json.loads(reader.readLine())
        finally:
            reader.close()

    def _commit(self, change: Callable[[dict], dict | None]) -> None:
        """Makes the next version from the last one by ``change``; starts again if another writer was first."""
        for _ in range(TRIES):
            state = self.state()
            new = change(state)
            if new is None:
                return
            new |= {"version": state["version"] + 1, "at": time.time()}
            fs, place = self._place(f"_log/{new['version']:012d}.json")
            try:
                out = fs.create(place, False)
            except Exception as error:
                if "AlreadyExists" in str(error) or "already exists" in str(error):
                    continue
                raise
            out.writeBytes(json.dumps(new) + "\n")
            out.close()
            return
        raise RuntimeError(f"{self.path}: other writers were first {TRIES} times")

    # --- reading ---

    def _runs(self, runs: list[dict]) -> DataFrame:
        """All rows and tombstones of these runs, with ``_run`` (the larger, the newer)."""
        schema = f"{self.schema}, _gone boolean"
        each = [self.spark.read.schema(schema).parquet(f"{self.path}/{run['name']}").withColumn("_run", F.lit(i)) for i, run in enumerate(runs)]
        return reduce(DataFrame.unionByName, each) if each else self.spark.createDataFrame([], f"{schema}, _run int")

    def _last(self, rows: DataFrame) -> DataFrame:
        latest = F.row_number().over(Window.partitionBy(*self.key).orderBy(F.desc("_run")))
        return rows.withColumn("_n", latest).filter("_n = 1").drop("_n", "_run")

    def _merged(self, runs: list[dict], where: Column | None = None, *some: DataFrame) -> DataFrame:
        """Each key's last row or tombstone."""
        cut = lambda df: df if where is None else df.filter(where)
        own = lambda df: reduce(lambda a, keys: a.join(keys, keys.columns, "left_semi"), some, df)
        if len(runs) < 2:
            return own(cut(self._runs(runs).drop("_run")))
        newer = own(self._runs(runs[1:]))
        old = own(cut(self._runs(runs[:1]).drop("_run"))).join(newer.select(*self.key).distinct(), self.key, "left_anti")
        # a key may have moved to another partition, so the newer runs are cut only after each key's last row is known
        return old.unionByName(cut(self._last(newer)))

    def read(self, where: Column | None = None, version: int | None = None, some: list[DataFrame] | None = None) -> DataFrame:
        """The table's rows, of the last version or an older one that has not expired; ``where`` on ``by`` prunes folders.

        ``some`` are tables of key columns: rows that lack there go before runs meet, so no others are shuffled if these are small."""
        if any(set(keys.columns) - set(self.key) for keys in some or ()):
            raise ValueError(f"keys are {self.key}")
        return self._merged(self.state(version)["runs"], where, *(some or ())).filter(~F.col("_gone")).select(*self.columns)

    # --- writing ---

    def _write(self, rows: DataFrame) -> dict | None:
        name, seen = f"r-{uuid.uuid4().hex}", Observation()
        made = rows.select(*self.columns, "_gone")
        counted = (made.repartition(self.by) if self.deal else made).observe(seen, F.count(F.lit(1)).alias("n"))
        (counted.write.partitionBy(self.by) if self.by else counted.write).parquet(f"{self.path}/{name}")
        return {"name": name, "rows": seen.get["n"]} if seen.get["n"] else None

    @staticmethod
    def _tier(run: dict) -> int:
        tier, n = 0, run["rows"]
        while n >= SMALL:
            tier, n = tier + 1, n // FAN
        return tier

    def _add(self, rows: DataFrame, batch: int | None, note: dict | None) -> None:
        if batch is not None and batch <= self.state()["batch"]:
            return
        self._list(self._write(rows), batch, note)

    def _list(self, run: dict | None, batch: int | None, note: dict | None) -> None:
        def change(state: dict) -> dict | None:
            if batch is not None and batch <= state["batch"]:
                return None
            return state | {"runs": state["runs"] + ([run] if run else []), "batch": state["batch"] if batch is None else batch} | ({"note": note} if note else {})

        self._commit(change)
        while self._merge_tier():
            pass

    def upsert(self, rows: DataFrame, batch: int | None = None, note: dict | None = None) -> None:
        """Rows replace those of the same key; keys are unique in ``rows``. A ``batch`` that was applied already is left out.

        ``note`` is kept with the version and those after it (``state()["note"]``)."""
        self._add(rows.withColumn("_gone", F.lit(False)), batch, note)

    def prepare(self, rows: DataFrame) -> tuple[dict | None, DataFrame]:
        """A run of these rows that no version lists before ``append``, and the rows as they were written."""
        run = self._write(rows.withColumn("_gone", F.lit(False)))
        return run, self._runs([run] if run else []).select(*self.columns)

    def append(self, run: dict | None, note: dict | None = None) -> None:
        """What ``prepare`` wrote, as ``upsert`` adds it."""
        self._list(run, None, note)

    def delete(self, keys: DataFrame, batch: int | None = None, note: dict | None = None) -> None:
        """Rows of these keys go."""
        kinds = dict(self.spark.createDataFrame([], self.schema).dtypes)
        gone = keys.select(*self.key).distinct()
        folder = {self.by} - {None, *self.key}
        if folder:
            gone = self.read().select(*self.key, self.by).join(gone, self.key, "left_semi")
        self._add(gone.select(*self.key, *folder, *(F.lit(None).cast(kinds[c]).alias(c) for c in self.columns if c not in {*self.key, *folder}), F.lit(True).alias("_gone")), batch, note)

    def _replace(self, old: list[dict], whole: bool) -> None:
        """Neighbouring runs become one; without their tombstones if they begin the table."""
        rows = self._merged(old)
        run = self._write(rows.filter(~F.col("_gone")) if whole else rows)
        names = [r["name"] for r in old]

        def change(state: dict) -> dict | None:
            now = [r["name"] for r in state["runs"]]
            if not set(names) <= set(now):
                return None  # another writer has merged them
            at = now.index(names[0])
            return state | {"runs": state["runs"][:at] + ([run] if run else []) + state["runs"][at + len(names) :]}

        self._commit(change)

    def _merge_tier(self) -> bool:
        runs = self.state()["runs"]
        for at in range(len(runs) - FAN, -1, -1):
            some = runs[at : at + FAN]
            if len({self._tier(r) for r in some}) == 1:
                self._replace(some, at == 0)
                return True
        return False

    def compact(self) -> None:
        """All runs become one."""
        runs = self.state()["runs"]
        if len(runs) > 1:
            self._replace(runs, True)

    def expire(self, versions: int = 1, seconds: float = 0.0) -> None:
        """Versions go but for the last ``versions`` and those made in the last ``seconds``, and the runs that only they list."""
        found = self.versions()
        states = {v: self.state(v) for v in found}
        stay = set(found[-versions:]) | {v for v, s in states.items() if s["at"] >= time.time() - seconds}
        live = {r["name"] for v in stay for r in states[v]["runs"]}
        for v in found:
            if v not in stay:
                fs, place = self._place(f"_log/{v:012d}.json")
                fs.delete(place, False)
        for name in {r["name"] for v in found for r in states[v]["runs"]} - live:
            fs, place = self._place(name)
            fs.delete(place, True)
