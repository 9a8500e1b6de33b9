"""Operator 2, quality classifier with hierarchical empirical Bayes.

1. Evidence: a logistic model over a document's words (those that differ most between good and bad labelled
   documents) and over bins of its shape. It is fitted on the labelled rows with the ``FIT_ROWS`` smallest hashes of their identifiers, a
   bounded sample; good means quality 1 and not toxic.
2. Hosts and paths: grouped sums of the documents' probabilities. A host's posterior mean shrinks its mean
   towards the global mean, a path's posterior mean shrinks its own towards the host's; the weight of the prior is
   the method-of-moments strength of a beta prior, so that a site with few documents counts little.
3. A document's posterior: the evidence (its log odds less those of the fit) added to its path's posterior log odds,
   the latter no further than ``SITE_LIMIT`` from the global ones. It is kept if the posterior is ``KEEP`` or more.

Nulls and empties: null texts are empty and judged as such; null host, path or identifier is a value like any other.
Repeated rows count each. An empty table of documents gives no rows; without labelled rows of both kinds the evidence is 0
and all documents are kept. Very long texts count whole. Ties: of rows with one labelled identifier the smallest hash of the text is fitted;
words of equal statistic go in order of the word; a posterior of exactly ``KEEP`` is kept. Other columns aren't read, or pass through in ``accepted``."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FIT_ROWS = 8192
WORDS = 512
KEEP = 0.5
SITE_LIMIT = 1.0
#: A name that no column of a table has.
SITE = "__tessera_site__"
_BINS = np.array([0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8])
SHAPES = ("symbols", "capitals", "bars", "repeats", "digits", "bangs", "short", "echo")


@cache
def _upper() -> np.ndarray:
    """Whether a code point is a capital."""
    return np.fromiter((chr(k).isupper() for k in range(0x110000)), bool, 0x110000)


def capitals(text: str, chars: int = 1 << 20) -> int:
    """The capitals of the whole text, so many characters at a time."""
    parts = (text[k : k + chars] for k in range(0, len(text), chars))
    return sum(int(np.count_nonzero(_upper()[np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4")])) for x in parts)


def _shape(text: str, words: list[str]) -> list[int]:
    """The bin of each shape measure: a share between 0 and 1."""
    n = max(1, len(text))
    count = len(words)
    symbols = sum(map(text.count, "*$%&#@^~=<>{}\\_"))
    lines = [x for x in text.split("\n") if x]
    sentences = [x for line in lines for x in line.split(". ")]
    raw = (
        symbols / n,
        capitals(text) / n,
        text.count("|") / n,
        1 - len(set(sentences)) / max(1, len(sentences)),
        sum(map(text.count, "0123456789")) / n,
        text.count("!") / n,
        1 / max(1, count),
        sum(map(eq, words, islice(words, 1, None))) / max(1, count),
    )
    return np.searchsorted(_BINS, raw, side="right").tolist()


class Model:
    """Log odds of a document being good: bias + words present + bins."""

    def __init__(self, words: dict[str, float], bins: np.ndarray, bias: float, base: float):
        self.words, self.bins, self.bias, self.base = words, bins, bias, base
        self.keys = frozenset(words)

    def evidence(self, text: str) -> float:
        """The log odds less those of the fitted rows."""
        words = common.WORD.findall(text.lower())
        x = self.bias + sum(sorted(map(self.words.__getitem__, self.keys.intersection(words))))
        for k, b in enumerate(_shape(text, words)):
            x += self.bins[k, b]
        return float(x - self.base)


def _fit_weights(x: np.ndarray, y: np.ndarray, strength: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column is the bias and isn't shrunk."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], strength)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, words: int = WORDS) -> Model:
    """docs: doc_id, text; labels: doc_id, quality, toxic. A labelled identifier counts once: as bad if any of its labels is, with the
    text of the smallest hash if several rows have it."""
    common.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    # At most ``rows`` rows, so that they can be broadcast.
    labelled = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(good.cast("int")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    labelled = common.written(labelled, "labelled")
    chosen = common.written(docs.join(F.broadcast(labelled), "doc_id").groupBy("doc_id").agg(F.min("h").alias("h"), F.first("y").alias("y")), "chosen")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin()
        schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("words", pa.list_(pa.string())), ("bins", pa.list_(pa.int32()))])
        for batch in batches:
            for part in common.slices(batch, "text"):
                own = []
                for text in common.texts_of(part.column("text")):
                    found = common.WORD.findall(text.lower())
                    own.append((sorted(set(found)), _shape(text, found)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array([o[0] for o in own], pa.list_(pa.string())), pa.array([o[1] for o in own], pa.list_(pa.int32()))], schema=schema)

    # Rows that repeat identifier and text have the same features; partial sums leave one of them before the shuffle.
    rowset = docs.join(F.broadcast(chosen), ["doc_id", "h"]).select("doc_id", "text", "y").mapInArrow(features, "doc_id long, y int, words array<string>, bins array<int>")
    rowset = common.written(rowset.groupBy("doc_id").agg(F.first("y").alias("y"), F.first("words").alias("words"), F.first("bins").alias("bins")), "fit")
    n = {r["y"]: r["n"] for r in rowset.groupBy("y").agg(F.count("*").alias("n")).collect()}
    flat = np.zeros((len(SHAPES), len(_BINS) + 1))
    if not n.get(0) or not n.get(1):
        return Model({}, flat, 0.0, 0.0)
    # The words whose shares differ most between the two kinds, by the chi-square statistic.
    per = rowset.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    a, b, n1, n0 = F.col("a"), F.col("b"), n[1], n[0]
    chi = (a * n0 - b * n1) ** 2 * (n1 + n0) / (F.lit(float(n1)) * n0 * (a + b) * (n1 + n0 - a - b) + 1e-9)
    top = per.where((a + b >= 3) & (a + b < n1 + n0)).withColumn("chi", chi).orderBy(F.desc("chi"), "word").limit(words)
    chosen_words = sorted(r["word"] for r in top.where("chi > 8").collect())  # at most ``words``
    at = {w: k for k, w in enumerate(chosen_words)}
    known = F.array(*[F.lit(w) for w in chosen_words]).cast("array<string>")
    small = rowset.select("doc_id", "y", "bins", F.array_intersect("words", known).alias("words")).orderBy("doc_id").collect()  # at most ``rows`` short rows
    width = len(at) + flat.size
    x, y = np.zeros((len(small), width + 1), np.float32), np.array([r["y"] for r in small], float)
    x[:, -1] = 1
    for r, row in enumerate(small):
        x[r, [at[w] for w in row["words"]]] = 1
        x[r, [len(at) + k * flat.shape[1] + v for k, v in enumerate(row["bins"])]] = 1
    used = x.any(axis=0)
    w = np.zeros(width + 1)
    w[used] = _fit_weights(x[:, used].astype(float), y)
    return Model({word: float(w[k]) for word, k in at.items()}, w[len(at) : width].reshape(flat.shape), float(w[-1]), float(np.log(n[1] / n[0])))


def _logit(p):
    p = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.log(p / (1 - p))


def with_evidence(docs: DataFrame, model: Model, text_col: str, name: str) -> DataFrame:
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``WORDS`` words and the bins

    @F.pandas_udf("double")
    def evidence(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        common.begin()
        for texts in parts:
            yield pd.Series([shared.value.evidence(t or "") for t in texts], dtype="float64")

    return docs.withColumn(name, evidence(F.col(text_col).cast("string")))


def posteriors(scored: DataFrame, base: float) -> DataFrame:
    """scored: host, path, p (probability by the evidence alone). A row per (host, path) with its posterior mean."""
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = hosts.agg(F.sum("hn").alias("gn"), F.sum("hs").alias("gs"), F.sum(F.col("hn") * (F.col("hs") / F.col("hn")) ** 2).alias("hq"), F.count("*").alias("hk"))
    named = hosts.withColumnRenamed("host", "_hh")
    within = paths.join(named, F.col("host").eqNullSafe(F.col("_hh"))).select(F.col("host").alias("_h"), F.col("path").alias("_p"), "n", "s", "hn", "hs")
    spread = within.agg(F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col("hs") / F.col("hn")) ** 2).alias("pq"), F.count("*").alias("pk"))
    g = F.col("gs") / F.col("gn")

    def strength(between, rate):
        # Method of moments of a beta: rate (1 - rate) / variance - 1, between 1 and 1e6.
        return F.least(F.greatest(rate * (1 - rate) / F.greatest(between, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(1e6))

    one = total.crossJoin(spread).select(  # one row each
        g.alias("g"),
        strength(F.greatest(F.col("hq") / F.col("gn") - g**2 - F.col("hk") * g * (1 - g) / F.col("gn"), F.lit(0.0)), g).alias("kh"),
        strength(F.greatest(F.col("pq") / F.col("gn") - F.col("pk") * g * (1 - g) / F.col("gn"), F.lit(0.0)), g).alias("kp"),
    )
    host_mean = (F.col("hs") + F.col("kh") * F.col("g")) / (F.col("hn") + F.col("kh"))
    path_mean = (F.col("s") + F.col("kp") * F.col("host_posterior")) / (F.col("n") + F.col("kp"))
    return within.crossJoin(F.broadcast(one)).withColumn("host_posterior", host_mean).withColumn("path_posterior", path_mean).select("_h", "_p", F.col("n").alias("_n"), F.col("g").alias("global_mean"), "host_posterior", "path_posterior")


RESULTS = ("evidence", "host_posterior", "path_posterior", "posterior", "keep")


def classify(docs: DataFrame, model: Model, host: str = "source", path: str = "lang", text_col: str = "text", prefix: str = "_", keep_text: bool = True) -> DataFrame:
    """All columns of docs (or all but the text), and RESULTS with a prefix; columns of docs with those names are replaced. The evidence is computed once and
    written with the columns; sites meet those rows by ``common.hot_join``."""
    named = {r: prefix + r for r in RESULTS}
    docs = docs.drop(*named.values())
    evidence = named["evidence"]
    scored = with_evidence(docs, model, text_col, evidence)
    key = F.struct(F.col(host).cast("string").alias("h"), F.col(path).cast("string").alias("p"))
    scored = common.written((scored if keep_text else scored.drop(text_col)).withColumn(SITE, key), "scored")
    prob = 1 / (1 + F.exp(-(F.col(evidence) + model.base)))
    sites = posteriors(scored.select(F.col(f"{SITE}.h").alias("host"), F.col(f"{SITE}.p").alias("path"), prob.alias("p")), model.base)
    sites = common.written(sites.select(F.struct(F.col("_h").alias("h"), F.col("_p").alias("p")).alias(SITE), *[F.col(c).alias(SITE + c) for c in ("_n", "global_mean", "host_posterior", "path_posterior")]), "sites")
    met = common.hot_join(scored, sites, SITE, SITE + "_n")
    away = _logit(F.col(SITE + "path_posterior")) - _logit(F.col(SITE + "global_mean"))
    prior = F.lit(model.base) + F.least(F.greatest(away, F.lit(-SITE_LIMIT)), F.lit(SITE_LIMIT))
    post = 1 / (1 + F.exp(-(F.col(evidence) + prior)))
    if not model.words and not model.bins.any():
        post = F.lit(1.0)
    own = [c for c in scored.columns if c != SITE]
    return met.select(*[F.col(f"`{c}`") for c in own], F.col(SITE + "host_posterior").alias(named["host_posterior"]), F.col(SITE + "path_posterior").alias(named["path_posterior"]), post.alias(named["posterior"]), (post >= KEEP).alias(named["keep"]))


def accepted(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that are kept, with their own columns."""
    out = classify(docs, fit(docs, labels), prefix="__tessera__", **how).where(F.col("__tessera__keep"))
    return out.select(*docs.columns)
