"""Aggregates over match records: levels, histogram, coverage, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import SCORE_BINS, score_bin

NAMES = ("very_high", "high", "medium", "low")


def level_counts(pairs: DataFrame) -> DataFrame:
    """One row: pairs and a count for each level, 0 included."""
    return pairs.agg(F.count("*").alias("pairs"), *[F.count_if(F.col("level") == n).alias(n) for n in NAMES])


def summary(pairs: DataFrame, chunks_a: DataFrame, chunks_b: DataFrame) -> DataFrame:
    return level_counts(pairs).crossJoin(chunks_a.agg(F.count("*").alias("chunks_A"))).crossJoin(chunks_b.agg(F.count("*").alias("chunks_B")))  # one row each


def histogram(pairs: DataFrame, score: str = "score") -> DataFrame:
    """(bin, n) of the five score bins, empty ones included."""
    names = [*(n for _, n in SCORE_BINS), ">=0.9"]
    one = pairs.agg(*[F.count_if(score_bin(F.col(score)) == n).alias(n) for n in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("bin"), F.col(f"`{n}`").alias("n")) for n in names])).alias("x")).select("x.*")


def filtered(pairs: DataFrame, level: str | None = None, least: float = 0.0, contains: str = "") -> DataFrame:
    """Pairs of a level, of a score or more, that hold a text on either side, best first."""
    out = pairs.where(F.col("score") >= least)
    if level:
        out = out.where(F.col("level") == level)
    if contains:
        held = lambda c: F.contains(F.lower(c), F.lit(contains.lower()))
        out = out.where(held(F.col("a_text")) | held(F.col("b_text")))
    return out.orderBy(F.desc("score"), "a_chunk_id", "b_chunk_id")


def union_coverage(spans: DataFrame, key: str, start: Column, end: Column, length: Column) -> DataFrame:
    """Per key: covered characters of the union of its spans (touching ones join), length, percentage, words of about five characters."""
    s = spans.select(key, start.alias("s"), end.alias("e"), length.alias("n"))
    before = Window.partitionBy(key).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.max("e").over(before)
    fresh = s.withColumn("reach", upto).withColumn("new", F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce("reach", F.col("s")))))
    out = fresh.groupBy(key).agg(F.sum("new").cast("long").alias("covered"), F.max("n").cast("long").alias("length"))
    return out.select(key, "covered", "length", F.when(F.col("length") > 0, F.col("covered") / F.col("length") * 100).otherwise(F.lit(0.0)).alias("pct"), F.floor(F.col("covered") / 5 + 0.5).cast("long").alias("words"))


def heat(start: Column, end: Column, length: Column) -> tuple[Column, Column]:
    """Left edge and width in percent of a span on a bar; 0.2 wide at least."""
    return start / length * 100, F.greatest(F.lit(0.2), (end - start) / length * 100)


def heat_pairs(pairs: DataFrame, least: float = 0.72) -> DataFrame:
    """The pairs that a heat map shows: those of a score of ``least`` (the bound of level high) or more."""
    return pairs.where(F.col("score") >= least)
