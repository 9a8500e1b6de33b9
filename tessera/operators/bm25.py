"""BM25 over an inverted index: statistics, scores and top-k. Fixed values are the usual defaults k1 1.5, b 0.75, epsilon 0.25.

``scope`` names columns (or none): statistics, scores and ranks are held apart by them, so that many document pairs run in one
plan. The corpus is read twice: once for the statistics of all terms, once for the postings of the queries' terms. The latter meet the
queries' postings, with their weights, by a broadcast if those are ASKED_AT_ONCE at most, so no posting list of a frequent term is shuffled; beyond that
terms join by equality and adaptive execution splits the long lists. No pair without a common term is made but for the zero-filled rows that top-k asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..store import written

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Postings of queries that are broadcast, about 100 bytes each.
ASKED_AT_ONCE = 500_000


def postings(items: DataFrame, key: str, text: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, term, tf)."""
    return items.select(*extra, key, F.explode(tokens(text)).alias("term")).groupBy(*extra, key, "term").agg(F.count("*").alias("tf"))


def statistics(corpus: DataFrame, text: Column, scope: tuple[str, ...] = ()) -> DataFrame:
    """(term, df, idf, n, avgdl), written. A negative idf becomes EPSILON times the mean of all terms' raw idf."""
    split = corpus.select(*scope, tokens(text).alias("_t"))
    # The null term of each item stands for the item itself, so that one pass has both the terms and the sizes.
    sized = split.select(*scope, F.size("_t").cast("long").alias("_n"), F.array_append(F.array_distinct("_t"), F.lit(None).cast("string")).alias("_t"))
    said = sized.select(*scope, "_n", F.explode("_t").alias("term"))
    counts = written(said.groupBy(*scope, "term").agg(F.count("*").alias("df"), F.sum("_n").alias("_n")), "terms")
    size = counts.where("term IS NULL").select(*scope, F.col("df").alias("n"), (F.col("_n") / F.col("df")).alias("avgdl"))  # a row per scope
    met = lambda a, b: a.join(b, list(scope)) if scope else a.crossJoin(F.broadcast(b))  # noqa: E731  one row, without scopes
    raw = met(counts.where("term IS NOT NULL").drop("_n"), size).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    # In decimals, so that the order of the terms doesn't show in the last digits.
    mean = raw.groupBy(*scope).agg(F.avg(F.col("raw").cast("decimal(30,18)")).cast("double").alias("mean"))
    return written(met(raw, mean).select(*scope, "term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"), "n", "avgdl"), "statistics")


def scores(queries: DataFrame, corpus: DataFrame, query_key: str, key: str, query_text: Column, text: Column, scope: tuple[str, ...] = ()) -> DataFrame:
    """(query_key, key, score, common, terms) of every pair with a common term: the number of different terms that both have, and that the item has."""
    asked = postings(queries, query_key, query_text, scope).withColumnRenamed("tf", "qtf")
    asked = written(asked.join(statistics(corpus, text, scope), [*scope, "term"]), "asked")
    few = asked.count() <= ASKED_AT_ONCE
    known = asked.select(*scope, "term").distinct()
    split = corpus.select(*scope, key, tokens(text).alias("_t"))
    # The sizes are columns before the terms are unrolled: beside the generator they would be computed for every term anew.
    sized = split.select(*scope, key, F.size("_t").cast("long").alias("dl"), F.size(F.array_distinct("_t")).alias("terms"), "_t")
    said = sized.select(*scope, key, "dl", "terms", F.explode("_t").alias("term"))
    said = said.join(F.broadcast(known) if few else known, [*scope, "term"], "left_semi")
    if few:
        # Dealt by item once: counting terms, meeting the queries and summing up then need no other shuffle. The work is in the pairs, not in these few bytes, so
        # the number of partitions is given.
        spark = corpus.sparkSession
        said = said.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *scope, key)
    post = said.groupBy(*scope, key, "dl", "terms", "term").agg(F.count("*").alias("tf"))
    met = post.join(F.broadcast(asked) if few else asked, [*scope, "term"])
    weight = F.col("qtf") * (F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
    return met.groupBy(*scope, query_key, key).agg(F.sum(weight).alias("score"), F.count("*").alias("common"), F.first("terms").cast("long").alias("terms"))


def topk(queries: DataFrame, corpus: DataFrame, query_key: str, key: str, query_text: Column, text: Column, k: int = 30, scope: tuple[str, ...] = (), fill: bool = True, scored: DataFrame | None = None) -> DataFrame:
    """The k best items of each query, ties by smaller key: (query_key, key, score, rank). fill: where fewer than k items
    score, the smallest keys are added with score 0. They are among the k smallest keys that don't score, so
    at most 2k keys per scope are looked at, not every pair. scored: what ``scores`` gave, if it is there already."""
    scored = (scores(queries, corpus, query_key, key, query_text, text, scope) if scored is None else scored).select(*scope, query_key, key, "score")
    # Ranked by rounded score, so that the last digit of a sum doesn't decide.
    w = Window.partitionBy(*scope, query_key).orderBy(F.desc(F.round("score", 9)), key)
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if not fill:
        return best
    best = written(best, "best")
    # A scored item may be negative only by idf, which the floor excludes unless the mean is negative.
    short = written(queries.select(*scope, query_key).join(best.groupBy(*scope, query_key).agg(F.count("*").alias("have")), [*scope, query_key], "left").where(F.coalesce("have", F.lit(0)) < k), "short")
    if not short.limit(1).count():
        return best
    first = corpus.select(*scope, key).orderBy(key).limit(2 * k) if not scope else corpus.select(*scope, key).withColumn("_r", F.row_number().over(Window.partitionBy(*scope).orderBy(key))).where(F.col("_r") <= 2 * k).drop("_r")
    pairs = short.select(*scope, query_key).join(first, list(scope)) if scope else short.select(query_key).crossJoin(F.broadcast(first))  # 2k rows at most
    zero = pairs.join(best.select(*scope, query_key, key), [*scope, query_key, key], "left_anti").withColumn("score", F.lit(0.0))
    every = best.select(*scope, query_key, key, "score").unionByName(zero)
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
