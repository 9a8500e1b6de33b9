"""New documents as a stream against a stored corpus: an extension, as the batch plan needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import hamming
from ..operators.simhash import simhash


def near_known(arriving: DataFrame, known: DataFrame, distance: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stream-static join: arriving documents that lie within a Hamming distance of a known SimHash (key, simhash), by equality on a band."""
    bands, width = distance + 1, 64 // (distance + 1)
    parts = lambda h: F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(h, i * width).bitwiseAND((1 << width) - 1 if i + 1 < bands else (1 << (64 - i * width)) - 1).alias("v")) for i in range(bands)]))
    left = arriving.select(F.col(key).alias("new_id"), simhash(F.col(text)).alias("h")).withColumn("band", parts(F.col("h")))
    right = known.select(F.col(key).alias("known_id"), F.col("simhash").alias("g")).withColumn("band", parts(F.col("g")))
    return left.join(right, "band").where(hamming(F.col("h"), F.col("g")) <= distance).select("new_id", "known_id", hamming(F.col("h"), F.col("g")).alias("distance"), F.col("band.i").alias("band"))
