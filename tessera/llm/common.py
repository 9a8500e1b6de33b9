"""What the operators of this subpackage share: scratch tables, word hashes, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the similarity operators: runs of Unicode letters, digits and underscores.
WORD = re.compile(r"\w+")
#: Entries that a worker's memo of words may hold before it is emptied.
MEMO_LIMIT = 150_000
#: Rows of an Arrow batch at most, so that a batch of texts is a few MB in the JVM and in a worker.
ARROW_ROWS, ARROW_BYTES = 1000, 4_000_000

_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to ARROW_ROWS rows and ARROW_BYTES bytes, if they aren't smaller."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where it is unset, as in
    local tests, a temporary folder of this machine is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet in the shared folder and reads it back, so that a lost executor
    costs no recomputation of what came before."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of the small side of a join that are broadcast whole, slim ones of 100 bytes or so.
JOIN_AT_ONCE = 200_000
#: Beyond that, keys with more than one of HOT_SHARE of all rows, and HOT_ROWS rows at least, are broadcast; there are fewer than HOT_SHARE of them.
HOT_SHARE, HOT_ROWS = 1000, 1000


def hot_join(rows: DataFrame, small: DataFrame, key: str, count: str, wide: int = 1) -> DataFrame:
    """Inner join of ``rows`` with ``small`` on ``key``, where ``small`` has a row per key and says in ``count`` how many of the rows have it. Rows of
    hot keys stay where they are; the others are shuffled, if the small side isn't broadcast whole. Both are read more than once, so they should be written tables.
    wide: how many times a slim row's bytes a row of the small side has; so many times fewer are broadcast."""
    one = small.agg(F.sum(count), F.count("*")).first()
    if one[1] * wide <= JOIN_AT_ONCE:
        return rows.join(F.broadcast(small), key)
    is_hot = (F.col(count) > HOT_ROWS) & (F.col(count) * max(1, HOT_SHARE // wide) > F.lit(one[0]))
    hot, cold = small.where(is_hot), small.where(~is_hot)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")  # fewer than HOT_SHARE rows
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def made() -> list[str]:
    """The scratch paths that aren't deleted yet."""
    return list(_made)


def release(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes scratch paths: call it once the results that read them have been written."""
    _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), paths)


def _delete(jvm, conf, paths: Iterable[str]) -> None:
    for path in list(paths):
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        if path in _made:
            _made.remove(path)


@atexit.register
def _release_all() -> None:
    """What is left goes when Python exits, whether the session was stopped or not."""
    jvm = SparkContext._jvm
    with contextlib.suppress(Exception):  # the JVM may be gone
        _delete(jvm, jvm.org.apache.hadoop.conf.Configuration(), made())


def filesystem(uri: str):
    """(file system, path) of a folder in the shared store; Spark's ``file:/x`` form is taken too."""
    from pyarrow import fs

    if ":" not in uri.split("/")[0]:
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def attempt(folder: str, name: str, suffix: str) -> Iterator[tuple]:
    """(path, open stream) of a file of this attempt of a task: attempts never meet, and the manifest names those that
    counted. The file of an attempt that fails is deleted."""
    store, top = filesystem(folder)
    path = f"{top}/{name}-{uuid.uuid4().hex}{suffix}"
    sink = store.open_output_stream(path, compression=None)
    try:
        yield path, sink
        sink.close()
    except BaseException:
        with contextlib.suppress(Exception):
            sink.close()
            store.delete_file(path)
        raise


def tidy(folder: str, keep: Iterable[str]) -> None:
    """Deletes the files of attempts that didn't count, as of speculative tasks."""
    from pyarrow import fs

    store, top = filesystem(folder)
    names = {k.rsplit("/", 1)[-1] for k in keep}
    for info in store.get_file_info(fs.FileSelector(top)):
        if info.is_file and info.base_name not in names:
            store.delete_file(info.path)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, column: str, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts a batch where the texts of ``column`` add up to ``chars`` bytes, so that a worker holds few of them
    as Python objects at a time. A longer single text is a slice of its own."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + chars, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


class WordHashes(dict):
    """Word to the 64-bit hash of the word; holds ``MEMO_LIMIT`` words at most."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


HASHES = WordHashes()
#: Every memo that a worker may hold: emptied, all but its own, by an operator's task that begins in that worker.
MEMOS: list = [HASHES]


def begin(*own) -> None:
    """To be called where a task begins: workers are used again, and what another operator left in one would add up."""
    for memo in MEMOS:
        if not any(memo is x for x in own):
            memo.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


_P = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply) over each element."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` consecutive elements."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for k in range(1, width):
        out *= _P
        out += h[k : k + n]
    return mix(out)
