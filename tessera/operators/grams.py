"""Top-k by the Jaccard coefficient of character n-grams, for a stated query set against every item.

The queries' grams are an inverted index that goes to the tasks in blocks of BLOCK_POSTINGS postings at most; an item's grams are looked up in it and counted
by query, so grams that no query has cost a look-up and nothing is exploded or shuffled. Each batch of items keeps the k best of each query; their ranks come last."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_POSTINGS = 2_000_000


def grams(text: str | None, n: int) -> set[str]:
    return {text[i : i + n] for i in range(len(text) - n + 1)} if text else set()


class Index:
    """Postings of some queries: gram to a row of owners."""

    def __init__(self, rows: list[tuple[int, set[str]]]):
        self.keys = np.array([k for k, _ in rows], np.int64)
        self.sizes = np.array([len(g) for _, g in rows], np.int64)
        self.at = {g: r for r, g in enumerate(sorted(set().union(*(g for _, g in rows))))}
        gram = np.array([self.at[g] for _, own in rows for g in own], np.int64)
        owner = np.repeat(np.arange(len(rows)), self.sizes)
        order = np.argsort(gram, kind="stable")
        self.owners = owner[order]
        self.starts = np.searchsorted(gram[order], np.arange(len(self.at) + 1))

    def common(self, own: set[str]) -> np.ndarray:
        """Grams in common with each query."""
        rows = np.array([r for r in map(self.at.get, own) if r is not None], np.int64)
        first, size = self.starts[rows], self.starts[rows + 1] - self.starts[rows]
        place = np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return np.bincount(self.owners[place], minlength=len(self.keys))


def _blocks(queries: DataFrame, key: str, text: str, n: int) -> Iterator[Index]:
    held: list[tuple[int, set[str]]] = []
    count = 0
    for r in queries.select(F.col(key).cast("long"), text).toLocalIterator():
        own = grams(r[1], n)
        if held and count + len(own) > BLOCK_POSTINGS:
            yield Index(held)
            held, count = [], 0
        held.append((r[0], own))
        count += len(own)
    if held:
        yield Index(held)


def topk(queries: DataFrame, corpus: DataFrame, query_key: str, key: str, query_text: str = "t", text: str = "t", n: int = 5, k: int = 3) -> DataFrame:
    """(query_key, key, jac, rank) of the k items with the highest coefficient above 0 (ties, after rounding to nine digits, by smaller key)."""
    spark = corpus.sparkSession
    shape = f"{query_key} long, {key} long, jac double"
    narrow = corpus.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    found = None
    for index in _blocks(queries, query_key, query_text, n):
        shared = spark.sparkContext.broadcast(index)  # bounded by BLOCK_POSTINGS

        def near(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            for pdf in parts:
                for at in range(0, len(pdf), 500):
                    part = pdf.iloc[at : at + 500].sort_values("k", kind="stable")
                    keys = part["k"].to_numpy()
                    jac = np.zeros((len(part), len(index.keys)))
                    for r, t in enumerate(part["t"]):
                        own = grams(t, n)
                        i = index.common(own)
                        jac[r] = i / np.maximum(1, len(own) + index.sizes - i)
                    best = np.argsort(-np.round(jac, 9), axis=0, kind="stable")[:k]
                    value = np.take_along_axis(jac, best, 0)
                    some = value > 0
                    yield pd.DataFrame({query_key: np.broadcast_to(index.keys, best.shape)[some], key: keys[best][some], "jac": value[some]})

        own = narrow.mapInPandas(near, shape)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = spark.createDataFrame([], shape)
    w = Window.partitionBy(query_key).orderBy(F.desc(F.round("jac", 9)), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
