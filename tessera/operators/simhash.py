"""SimHash by bit votes, and the Hamming top-k join."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.scores import hamming
from ..store import written

NGRAM, BITS = 7, 64
MEMO_LIMIT = 200_000
#: Rows of the query side that go to the tasks at once.
QUERY_ROWS = 2000


class _Digests(dict):
    """Gram to the first half of its MD5; holds MEMO_LIMIT grams at most."""

    def __missing__(self, gram: str) -> bytes:
        if len(self) >= MEMO_LIMIT:
            self.clear()
        value = self[gram] = hashlib.md5(gram.encode()).digest()[:8]
        return value


_DIGESTS = _Digests()


def votes(text: str | None) -> int:
    """The SimHash of one text."""
    s = f" {text} " if text is not None else ""
    grams = len(s) - NGRAM + 1
    if text is None or grams < 1:
        return -1
    ones = np.zeros(BITS, np.int64)
    for at in range(0, grams, 1 << 16):  # so many grams at a time, however long the text
        raw = b"".join(map(_DIGESTS.__getitem__, [s[i : i + NGRAM] for i in range(at, min(grams, at + (1 << 16)))]))
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones >= grams).view(">i8")[0])


@F.pandas_udf(LongType())
def _votes(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in parts:
        yield pd.Series([votes(t) for t in series], dtype="int64")


def simhash(text: Column) -> Column:
    """64 bits as a long: bit k is one if at least half of all 7-grams (of the text with a space to each side, repeats
    counted) have a one there in the first half of their MD5; all ones for a text without grams."""
    return _votes(text)


def topk(queries: DataFrame, corpus: DataFrame, query_key: str, key: str, hash_col: str = "simhash", k: int = 50, scope: tuple[str, ...] = ()) -> DataFrame:
    """The k nearest items of each query by Hamming distance, ties by smaller key: (query_key, key, distance, rank). Without scopes the
    stated query set goes out in blocks of QUERY_ROWS, and each batch of items keeps the k best of each query. Inside scopes every two rows meet, as two numbers a side."""
    w = Window.partitionBy(*scope, query_key).orderBy("distance", key)
    if scope:
        q = queries.select(*scope, query_key, F.col(hash_col).alias("_q"))
        met = q.join(corpus.select(*scope, key, F.col(hash_col).alias("_c")), list(scope)).withColumn("distance", hamming(F.col("_q"), F.col("_c")).cast("long"))
        return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*scope, query_key, key, "distance", "rank")
    spark = corpus.sparkSession
    narrow = corpus.select(F.col(key).cast("long").alias("k"), F.col(hash_col).alias("h"))
    found = None
    for ids, hashes in _blocks(queries, query_key, hash_col):
        shared = spark.sparkContext.broadcast((ids, hashes))  # bounded by QUERY_ROWS

        def near(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            q_ids, q = shared.value
            for pdf in parts:
                for at in range(0, len(pdf), 1000):
                    part = pdf.iloc[at : at + 1000].sort_values("k", kind="stable")
                    keys, h = part["k"].to_numpy(), part["h"].to_numpy().view(np.uint64)
                    d = np.bitwise_count(q[:, None] ^ h[None, :])
                    best = np.argsort(d, axis=1, kind="stable")[:, :k]
                    yield pd.DataFrame({query_key: np.repeat(q_ids, best.shape[1]), key: keys[best].ravel(), "distance": np.take_along_axis(d, best, 1).ravel().astype(np.int64)})

        own = narrow.mapInPandas(near, f"{query_key} long, {key} long, distance long")
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = spark.createDataFrame([], f"{query_key} long, {key} long, distance long")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _blocks(queries: DataFrame, key: str, hash_col: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rows = ((r[0], r[1]) for r in queries.select(F.col(key).cast("long"), hash_col).toLocalIterator())
    while held := list(islice(rows, QUERY_ROWS)):
        yield np.array([k for k, _ in held], np.int64), np.array([h for _, h in held], np.int64).view(np.uint64)


def within(items: DataFrame, key: str, hash_col: str = "simhash", distance: int = 3) -> DataFrame:
    """All pairs (a < b) at ``distance`` or less: two such hashes agree in one of ``distance + 1`` bands, so equality on a band finds
    them. Items of one hash are one row of the join, with their smallest key, and their number is kept."""
    bands = distance + 1
    width = BITS // bands
    one = written(items.groupBy(F.col(hash_col).alias("h")).agg(F.min(key).alias("k"), F.count("*").alias("n")), "hashes")
    parts = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("h", i * width).bitwiseAND((1 << width) - 1 if i + 1 < bands else (1 << (BITS - i * width)) - 1).alias("v")) for i in range(bands)])
    dealt = one.select("k", "h", "n", F.explode(parts).alias("p")).select("k", "h", "n", "p.band", "p.v")
    a, b = dealt.alias("a"), dealt.alias("b")
    # A pair is taken in the first band on which it agrees.
    met = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.k") < F.col("b.k")))
    x = F.col("a.h").bitwiseXOR(F.col("b.h"))
    first = F.coalesce(*[F.when(F.shiftrightunsigned(x, i * width).bitwiseAND((1 << width) - 1 if i + 1 < bands else (1 << (BITS - i * width)) - 1) == 0, F.lit(i)) for i in range(bands)])
    return met.where((F.bit_count(x) <= distance) & (first == F.col("a.band"))).select(F.col("a.k").alias("a"), F.col("b.k").alias("b"), F.bit_count(x).cast("long").alias("distance"), F.col("a.n").alias("a_copies"), F.col("b.n").alias("b_copies"))
