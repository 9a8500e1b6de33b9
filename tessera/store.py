"""Tables that cut a plan: written once in the folder that driver and executors share, and read by whatever needs them."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_roots: set[str] = set()


def root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which is removed when Python exits. Only a local master may
    leave that setting out: then a temporary folder of this machine is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tessera-{spark.sparkContext.applicationId}"
    _roots.add(path)
    return path


@atexit.register
def _remove() -> None:
    jvm = SparkContext._jvm
    for path in _roots:
        with contextlib.suppress(Exception):  # the JVM may be gone
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table of their own: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables below so many bytes may have fewer row groups than there are cores.
SMALL_TABLE = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a small table to all cores before dear work, as its few row groups would leave most of them idle. A larger table is read as
    it lies: no shuffle."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= SMALL_TABLE:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)
