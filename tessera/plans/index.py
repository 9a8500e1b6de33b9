"""A stored index of chunks and vectors over a folder of documents, and its search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import models, text
from ..operators import candidates, segment, vectors
from ..sources import docx, report


def build(spark: SparkSession, folder: str, out: str, cfg: Config | None = None, embedder: models.Embedder | None = None, cache: str | None = None) -> dict:
    """Chunks every DOCX below folder by sentences after NFC and lower case, embeds them (from the cache where it has them) and writes out/chunks and out/meta."""
    cfg, embedder = cfg or Config(), embedder or models.HashedGrams()
    docs = docx.documents(docx.read(spark, folder), cfg.keep_tables).select("path", F.lower(text.nfc(F.col("text"))).alias("text"))
    cut = segment.chunks(docs, cfg.size_tokens, cfg.overlap, paragraphs=False, key="path").select("path", "chunk_id", F.col("disp").alias("text"), "char_start", "char_end", text.content_key(embedder.name, F.col("disp")).alias("key"))
    if cache:
        known = report.cache_read(spark, cache, "key string, embedding array<float>")
        fresh = candidates.missing(cut.select("key", "text").dropDuplicates(["key"]), known, "key").select("key", models.embed(F.col("text"), embedder).alias("embedding"))
        report.cache_add(fresh, cache)
        rows = cut.join(report.cache_read(spark, cache, "key string, embedding array<float>").dropDuplicates(["key"]), "key")
    else:
        rows = cut.withColumn("embedding", models.embed(F.col("text"), embedder))
    rows = rows.withColumn("vec_id", F.monotonically_increasing_id())
    rows.write.mode("overwrite").parquet(f"{out}/chunks")
    count = spark.read.parquet(f"{out}/chunks").count()
    spark.createDataFrame([(count, embedder.name)], "num_chunks long, model string").write.mode("overwrite").json(f"{out}/meta")
    return {"num_chunks": count, "out": out}


def search(spark: SparkSession, index: str, queries: DataFrame, k: int = 10, embedder: models.Embedder | None = None, approximate: bool = False) -> DataFrame:
    """queries: (query_id, text). The k nearest chunks of each."""
    asked = queries.select("query_id", models.embed(F.col("text"), embedder or models.HashedGrams()).alias("embedding"))
    chunks = spark.read.parquet(f"{index}/chunks")
    near = vectors.approximate if approximate else vectors.topk
    found = near(asked, chunks, "query_id", "vec_id", k=k)
    return found.join(chunks.select("vec_id", "path", "chunk_id", "text"), "vec_id")
