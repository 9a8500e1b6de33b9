"""Candidates of a chunk and what is kept of them: union, prefilter, gate, join back, best by score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_cut(found: list[DataFrame], a: str, b: str, most: int, scope: tuple[str, ...] = (), by_score: bool = False) -> DataFrame:
    """Distinct pairs of all retrievers, the first ``most`` of each a by smallest b (or, by_score, by best rank)."""
    every = reduce(DataFrame.unionByName, [f.select(*scope, a, b, "rank") for f in found]).groupBy(*scope, a, b).agg(F.min("rank").alias("rank"))
    w = Window.partitionBy(*scope, a).orderBy(*(["rank", b] if by_score else [b]))
    return every.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).select(*scope, a, b)


def prefilter(pairs: DataFrame, a: str, b: str, scope: tuple[str, ...] = (), bi: str = "bi", lex: str = "lex", least_bi: float = 0.30, least_lex: float = 0.20, fallback: int = 3) -> DataFrame:
    """Adds ``eligible``: bi or lex high enough; where no pair of an a is, its first ``fallback`` by b are."""
    w = Window.partitionBy(*scope, a)
    good = (F.col(bi) >= least_bi) | (F.col(lex) >= least_lex)
    marked = pairs.withColumn("_good", good).withColumn("_any", F.max("_good").over(w)).withColumn("_n", F.row_number().over(w.orderBy(b)))
    return marked.withColumn("eligible", F.when(F.col("_any"), F.col("_good")).otherwise(F.col("_n") <= fallback)).drop("_good", "_any", "_n")


def gated(pairs: DataFrame, a: str, b: str, scope: tuple[str, ...] = (), bi: str = "bi", most: int = 10, low: float = 0.25, high: float = 0.92) -> DataFrame:
    """The eligible pairs among the ``most`` best by bi whose bi lies from low to high: what the pair scorer gets."""
    w = Window.partitionBy(*scope, a).orderBy(F.desc(bi), b)
    return pairs.where("eligible").withColumn("_n", F.row_number().over(w)).where((F.col("_n") <= most) & F.col(bi).between(low, high)).drop("_n")


def join_back(pairs: DataFrame, scored: DataFrame, keys: list[str], name: str = "cross") -> DataFrame:
    """Scores of the gated pairs joined back; 0 where there is none."""
    return pairs.join(scored.select(*keys, name), keys, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def best(pairs: DataFrame, a: str, b: str, score: Column, most: int = 5, scope: tuple[str, ...] = ()) -> DataFrame:
    """The ``most`` best pairs of each a by score, ties by smaller b, with their rank."""
    w = Window.partitionBy(*scope, a).orderBy(F.desc(score), b)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def missing(keys: DataFrame, cache: DataFrame, on: str) -> DataFrame:
    """Rows whose result isn't cached."""
    return keys.join(cache.select(on), on, "left_anti")


def cached(keys: DataFrame, cache: DataFrame, on: str) -> DataFrame:
    return keys.join(cache, on)
