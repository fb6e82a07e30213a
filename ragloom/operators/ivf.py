"""A stored inverted-file index with product-quantised residuals: codes are scanned first, few vectors are read after.

Vectors (compared by cosine) lie in cells, the partition column of a table of runs, so inserts and deletions write in proportion
to themselves. A row holds the vector, its code (one byte for each pair of dimensions: the nearest of up to 256 centres
of the residual to the cell's centre) and what the code misses (``err``). Centres are fitted on the ``SAMPLE`` vectors with
the smallest hashes of their ids, a documented bound; every vector is indexed.

A search estimates scores from codes. The true score differs from the estimate by the product of the query with the missed
part, of which ``z`` standard deviations (err / sqrt(dim) each) are allowed for. In a query's nearest cells this gives a
score that the k-th best surely reaches; a cell is probed only if its centre's score and its widest residual can reach that
(its distance bound), a row of it is read in full only if its estimate can reach that and the k-th best that its task has seen. The few that are read are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.operators.retrieval import CANDIDATES, _in_blocks, _unit, top_k
from ragloom.sinks.logtable import LogTable

#: Vectors that centres are fitted on, and rounds of fitting.
SAMPLE = 1 << 16
ROUNDS = 8
MOST_CELLS = 4096
#: Dimensions that one byte of a code stands for, and its centres.
WIDTH, CENTRES = 2, 256
#: Estimates (of a query and a row) that are made at a time.
SLICE = 1 << 20
#: Standard deviations of the estimate that are allowed for.
Z = 4.0
ROW = "vec_id long, cell int, code binary, res float, err float, embedding array<float>"
CENTRE = "space int, entry int, centre array<float>"


def _nearest(x: np.ndarray, centres: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """The nearest centre of each row."""
    half = (centres**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + step] @ centres.T - half, 1) for i in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def _fitted(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds from distinct rows; an empty centre stays where it is."""
    x = x.astype(np.float32)
    distinct = np.unique(x, axis=0)
    centres = distinct[np.sort(np.random.default_rng(seed).permutation(len(distinct))[:k])]
    for _ in range(ROUNDS if len(centres) < len(distinct) else 0):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.stack([np.bincount(at, x[:, j], len(centres)) for j in range(x.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres).astype(np.float32)
    return centres


class Model:
    """Cell centres and, for each pair of dimensions, the centres of residuals."""

    def __init__(self, rows: pd.DataFrame):
        table = {s: np.stack(g.sort_values("entry")["centre"].to_list()).astype(np.float32) for s, g in rows.groupby("space")}
        self.cells = table.pop(-1)
        self.dim = self.cells.shape[1]
        self.books = [table[s] for s in sorted(table)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cells, codes, lengths of residuals and of what codes miss."""
        cell = _nearest(x, self.cells)
        rest = x - self.cells[cell]
        code = np.stack([_nearest(rest[:, s * WIDTH : (s + 1) * WIDTH], b) for s, b in enumerate(self.books)], 1).astype(np.uint8)
        return cell, code, np.linalg.norm(rest, axis=1), np.linalg.norm(x - self.decode(cell, code), axis=1)

    def decode(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        return self.cells[cell] + np.concatenate([b[code[:, s]] for s, b in enumerate(self.books)], 1)


class IvfIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.table = LogTable(spark, f"{self.path}/rows", ROW, ["vec_id"], "cell")

    def fit(self, vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> None:
        """Centres from at most ``sample`` of vectors(vec_id, embedding), stored beside the rows."""
        some = vectors.filter(F.col("embedding").isNotNull()).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding")

        def coarse(rows: pd.DataFrame) -> pd.DataFrame:
            x = _unit(rows["embedding"])
            k = cells or int(np.clip(round(len(x) ** 0.5), 1, MOST_CELLS))
            centres = _fitted(x, k)
            return pd.DataFrame({"space": -1, "entry": range(len(centres)), "centre": list(centres)})

        some.groupBy().applyInPandas(coarse, CENTRE).write.mode("overwrite").parquet(f"{self.path}/cells")
        centres = np.stack(self.spark.read.parquet(f"{self.path}/cells").toPandas().sort_values("entry")["centre"].to_list())  # at most MOST_CELLS

        def residuals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                x = _unit(rows["embedding"]).astype(np.float32)
                rest = x - centres[_nearest(x, centres)]
                for s in range(0, -(-x.shape[1] // WIDTH)):
                    yield pd.DataFrame({"space": s, "part": list(rest[:, s * WIDTH : (s + 1) * WIDTH])})

        def fine(rows: pd.DataFrame) -> pd.DataFrame:
            book = _fitted(np.stack(rows["part"].to_list()), CENTRES)
            return pd.DataFrame({"space": rows["space"].iloc[0], "entry": range(len(book)), "centre": list(book)})

        books = some.mapInPandas(residuals, "space int, part array<float>").groupBy("space").applyInPandas(fine, CENTRE)
        books.write.mode("overwrite").parquet(f"{self.path}/books")

    def model(self) -> Model:
        """The stored centres: at most MOST_CELLS of the whole width and CENTRES for each pair of dimensions."""
        return Model(self.spark.read.schema(CENTRE).parquet(f"{self.path}/cells", f"{self.path}/books").toPandas())

    def insert(self, vectors: DataFrame, batch: int | None = None) -> None:
        """vectors(vec_id, embedding); a known id is replaced, a null vector left out."""
        model = self.model()

        def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                if len(rows):
                    x = _unit(rows["embedding"]).astype(np.float32)
                    cell, code, res, err = model.encode(x)
                    yield pd.DataFrame({"vec_id": rows["vec_id"], "cell": cell, "code": [c.tobytes() for c in code], "res": res, "err": err, "embedding": rows["embedding"]})

        some = vectors.filter(F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        self.table.upsert(some.mapInPandas(encoded, ROW), batch)

    def delete(self, ids: DataFrame, batch: int | None = None) -> None:
        self.table.delete(ids.select(F.col("vec_id").cast("long").alias("vec_id")), batch)

    def _scan(self, model: Model, ids: np.ndarray, mat: np.ndarray, near: np.ndarray, least: np.ndarray, k: int, z: float) -> DataFrame:
        """query_id, vec_id, score (the estimate) and low (its lower bound) of the rows in the cells that each query looks
        into (``near``), as far as they can reach both ``least`` and the k-th best lower bound that the task has seen."""

        def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best, step = np.full((len(ids), k), -np.inf), max(64, SLICE // len(ids))
            for batch in batches:
                for at in range(0, len(batch), step):
                    rows = batch.iloc[at : at + step]
                    cell = rows["cell"].to_numpy()
                    code = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
                    scores = mat @ model.decode(cell, code).T
                    slack = z * rows["err"].to_numpy() / model.dim**0.5
                    low = np.where(near[:, cell], scores - slack, -np.inf)
                    best = np.partition(np.concatenate([best, low], 1), -k, 1)[:, -k:]
                    q, i = np.nonzero(near[:, cell] & (scores + slack >= np.maximum(least, best[:, 0])[:, None]))
                    yield pd.DataFrame({"query_id": ids[q], "vec_id": rows["vec_id"].to_numpy()[i], "score": scores[q, i], "low": low[q, i]})

        some = np.flatnonzero(near.any(0)).tolist()
        where = F.col("cell").isin(some) if len(some) < near.shape[1] else None
        return self.table.read(where).select("vec_id", "cell", "code", "err").mapInPandas(estimate, f"{self._schema}, low double")

    def search(self, queries: DataFrame, k: int = CANDIDATES, z: float = Z) -> DataFrame:
        """query_id, vec_id, score, codes_read, vectors_read of the ``k`` nearest of queries(query_id, qvec)."""
        model = self.model()
        self._schema = f"query_id {dict(queries.dtypes)['query_id']}, vec_id long, score double"
        cells = self.table.read().groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("res").alias("res")).toPandas()  # a row for each cell
        size, reach = np.zeros(len(model.cells), np.int64), np.zeros(len(model.cells))
        size[cells["cell"]], reach[cells["cell"]] = cells["n"], cells["res"]
        schema = f"{self._schema}, codes_read long, vectors_read long"

        def find(block: list) -> DataFrame:
            ids, mat = np.array([r.query_id for r in block]), _unit([r.qvec for r in block])
            at_centre = mat @ model.cells.T.astype(float)
            order = np.argsort(-np.where(size > 0, at_centre, -np.inf), 1, kind="stable")
            first = np.zeros(at_centre.shape, bool)
            # the nearest cells up to the one in which 4 * k rows are seen
            np.put_along_axis(first, order, np.cumsum(size[order], 1) - size[order] < 4 * k, 1)
            first &= size > 0
            low = self._scan(model, ids, mat, first, np.full(len(ids), -2.0), k, z)
            kth = top_k(low, k, "query_id", [F.desc("low")]).groupBy("query_id").agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("n")).toPandas()  # a row for each query
            least = pd.Series(np.where(kth["n"] == k, kth["least"], -2.0), kth["query_id"]).reindex(ids).fillna(-2.0).to_numpy()
            near = (at_centre + z * reach / model.dim**0.5 >= least[:, None]) & (size > 0) | first
            some = self._scan(model, ids, mat, near, least, k, z)
            codes = self.spark.createDataFrame([(i.item(), n.item()) for i, n in zip(ids, (near * size).sum(1), strict=True)], f"query_id {dict(queries.dtypes)['query_id']}, codes_read long")
            place = {q: i for i, q in enumerate(ids.tolist())}

            def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for rows in batches:
                    if len(rows):
                        q = rows["query_id"].map(place).to_numpy()
                        yield pd.DataFrame({"query_id": rows["query_id"], "vec_id": rows["vec_id"], "score": (mat[q] * _unit(rows["embedding"])).sum(1)})

            full = some.select("query_id", "vec_id").join(self.table.read().select("vec_id", "embedding"), "vec_id")
            scored = full.select("query_id", "vec_id", "embedding").mapInPandas(exact, self._schema)
            best = top_k(scored, k, "query_id", [F.desc("score"), F.asc("vec_id")])
            read = some.groupBy("query_id").agg(F.count(F.lit(1)).alias("vectors_read"))
            return best.join(F.broadcast(codes), "query_id").join(read, "query_id").select("query_id", "vec_id", "score", "codes_read", "vectors_read")

        return _in_blocks(queries.select("query_id", "qvec"), schema, find)
