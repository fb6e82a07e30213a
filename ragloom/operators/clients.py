"""Plug-in points: what a client must offer, offline defaults that are deterministic, and how columns reach them.

A client's method may return None or raise: callers then take the next in their chain. Clients are pickled to the
workers and called there in batches; none is called on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that one call of an embedder gets.
BATCH = 64


@runtime_checkable
class VectorStore(Protocol):
    """A table of chunk vectors by tenant."""

    def insert(self, rows: DataFrame) -> None: ...
    def search(self, queries: DataFrame, k: int) -> DataFrame: ...
    def delete_documents(self, gone: DataFrame) -> None: ...


@runtime_checkable
class TextIndex(Protocol):
    """Postings of chunks by tenant."""

    def insert(self, rows: DataFrame) -> None: ...
    def search(self, queries: DataFrame, k: int) -> DataFrame: ...
    def delete_documents(self, gone: DataFrame) -> None: ...


@runtime_checkable
class ObjectStorage(Protocol):
    def save(self, key: str, data: bytes) -> str: ...
    def load(self, key: str) -> bytes: ...
    def delete(self, key: str) -> None: ...


@runtime_checkable
class Embedder(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]] | None: ...


@runtime_checkable
class Reranker(Protocol):
    def rerank(self, query: str, documents: list[str]) -> list[float] | None: ...


@runtime_checkable
class Recogniser(Protocol):
    def recognise(self, image: bytes) -> str | None: ...


@runtime_checkable
class LanguageModel(Protocol):
    def complete(self, prompt: str) -> str | None: ...


class DummyEmbedder:
    """Unit vectors drawn from a generator that the text's SHA-256 seeds: equal texts, equal vectors."""

    def __init__(self, dim: int):
        self.dim = dim

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            seed = int.from_bytes(hashlib.sha256(t.encode()).digest()[:4], "little")
            v = np.random.RandomState(seed).randn(self.dim).astype(np.float32)
            out.append((v / (np.linalg.norm(v) + 1e-8)).tolist())
        return out


class Memory:
    """Object storage in a dictionary, for tests."""

    def __init__(self):
        self.kept: dict[str, bytes] = {}

    def save(self, key: str, data: bytes) -> str:
        self.kept[key] = data
        return key

    def load(self, key: str) -> bytes:
        return self.kept[key]

    def delete(self, key: str) -> None:
        self.kept.pop(key, None)


def first_of(*tries: Callable[[], object]) -> object | None:
    """The first result that is not None; a try that raises counts as None."""
    for t in tries:
        try:
            if (got := t()) is not None:
                return got
        except Exception:  # a client's failure is the next one's turn
            continue
    return None


def ask(prompt: Column, model: LanguageModel) -> Column:
    """The model's answers; null where the prompt is null or the model fails."""

    @F.pandas_udf("string")
    def answers(rows: pd.Series) -> pd.Series:
        return rows.map(lambda p: first_of(lambda: model.complete(p)), na_action="ignore")

    return answers(prompt)


def recognised(image: Column, *chain: Recogniser) -> Column:
    """Text of images by the first recogniser that answers, else the empty text."""

    @F.pandas_udf("string")
    def texts(rows: pd.Series) -> pd.Series:
        return rows.map(lambda raw: first_of(*(lambda c=c: c.recognise(raw) for c in chain)) or "", na_action="ignore")

    return texts(image)


def embed(texts: DataFrame, chain: dict[str, Embedder], dim: int, cache: DataFrame | None = None, column: str = "text", batch: int = BATCH) -> DataFrame:
    """``texts`` with embedding and source (``cache``, a client's name, or ``dummy``).

    Vectors are looked up in ``cache`` (key, embedding) by the MD5 of the text; each distinct miss is computed once, in
    batches, by the first client of the chain that answers, else by ``DummyEmbedder``. A null text has no vector.
    """
    keyed = texts.withColumn("key", F.md5(column))
    known = None if cache is None else cache.select("key", F.col("embedding").cast("array<float>").alias("embedding")).dropDuplicates(["key"]).withColumn("source", F.lit("cache"))
    asked = keyed.filter(F.col(column).isNotNull()).select("key", F.col(column).alias("text")).dropDuplicates(["key"])
    missing = asked if known is None else asked.join(known, "key", "left_anti")

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = DummyEmbedder(dim)
        for rows in batches:
            for at in range(0, len(rows), batch):
                part = rows.iloc[at : at + batch]
                some = part["text"].tolist()
                name, got = first_of(*(lambda n=n, c=c: (n, v) if (v := c.encode(some)) is not None else None for n, c in chain.items())) or ("dummy", last.encode(some))
                yield pd.DataFrame({"key": part["key"], "embedding": got, "source": name})

    made = missing.mapInPandas(compute, "key string, embedding array<float>, source string")
    every = made if known is None else made.unionByName(known.join(asked.select("key"), "key", "left_semi"))
    return keyed.join(every, "key", "left")


def cache_rows(embedded: DataFrame, now: Column) -> DataFrame:
    """key, embedding, stored_at: what an embedding run adds to the cache."""
    return embedded.filter("source <> 'cache'").dropDuplicates(["key"]).select("key", "embedding", now.alias("stored_at"))
