"""Similarity features, penalties, fusion and levels as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower bounds of the levels, and the weights of cross, bi, lexical and BM25 scores.
LEVELS = (("very_high", 0.82), ("high", 0.72), ("medium", 0.60))
WEIGHTS = (0.55, 0.25, 0.15, 0.05)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + 1e-9)


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x))


def ratio(inter: Column, a: Column, b: Column) -> Column:
    """Jaccard coefficient of two sets from the size of their intersection and their own; 0 if both are empty."""
    union = a + b - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets."""
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_similarity(a: Column, b: Column, bits: int = 64) -> Column:
    return 1 - hamming(a, b) / F.lit(float(bits))


def lexical_base(jac: Column, ham: Column) -> Column:
    return 0.5 * jac + 0.5 * ham


def phrase_hits(text: Column, phrases: Sequence[str], ignore_case: bool) -> Column:
    """The phrases that the text holds."""
    held = F.lower(text) if ignore_case else text
    known = sorted({p.lower() if ignore_case else p for p in phrases if p})
    if not known:
        return F.array().cast("array<string>")
    return F.filter(F.array(*map(F.lit, known)), lambda p: F.contains(held, p))


def shared_hits(a: Column, b: Column) -> Column:
    """Hits of both sides over hits of either; 0 if there are none."""
    return ratio(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def pattern_count(text: Column, patterns: Sequence[str]) -> Column:
    """How many of the patterns match, each counted once."""
    return reduce(lambda s, p: s + text.rlike(p).cast("int"), patterns, F.lit(0))


def citation_penalty(a: Column, b: Column) -> Column:
    """From the two pattern counts: the smaller over the larger, 0 if one is 0."""
    return F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b)).otherwise(F.lit(0.0))


def penalised(base: Column, boilerplate: Column, stop: Column, citation: Column, factors: Sequence[float] = (0.5, 0.2, 0.15)) -> Column:
    b, s, c = factors
    return base * (1 - b * boilerplate) * (1 - s * stop) * (1 - c * citation)


def bm25_norm(raw: Column, k: float = 10.0) -> Column:
    return 1 - F.exp(-F.greatest(raw, F.lit(0.0)) / k)


def fuse(cross: Column, bi: Column, lex: Column, bm25_raw: Column, weights: Sequence[float] = WEIGHTS) -> Column:
    """The weighted sum of the four scores, BM25 normalised, held between 0 and 1."""
    a, b, c, d = weights
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), a * cross + b * bi + c * lex + d * bm25_norm(bm25_raw)))


def level(score: Column, bounds: Sequence[tuple[str, float]] = LEVELS, last: str = "low") -> Column:
    found = F.lit(last)
    for name, low in reversed(list(bounds)):
        found = F.when(score >= low, F.lit(name)).otherwise(found)
    return found


def fallback_bounds(cfg: dict) -> tuple[tuple[str, float], ...]:
    """Bounds of a report reader from a configuration's thresholds: very_high falls back to high, then to its fixed value."""
    t = (cfg or {}).get("thresholds") or {}
    high = t.get("high", 0.72)
    return ("very_high", float(t.get("very_high", t.get("high", 0.82)))), ("high", float(high)), ("medium", float(t.get("medium", 0.60)))


def minmax(x: Column, low: Column, high: Column) -> Column:
    return F.when(high - low < 1e-9, F.lit(0.0)).otherwise((x - low) / (high - low))


SCORE_BINS = ((0.6, "<0.6"), (0.7, "0.6-0.7"), (0.8, "0.7-0.8"), (0.9, "0.8-0.9"))


def score_bin(score: Column) -> Column:
    found = F.lit(">=0.9")
    for high, name in reversed(SCORE_BINS):
        found = F.when(score < high, F.lit(name)).otherwise(found)
    return found
