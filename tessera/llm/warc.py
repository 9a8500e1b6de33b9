"""Operator 4, a dictionary-compressed WARC writer and its reader.

Each task writes one archive: a skippable frame (magic 0x184D2A5D) with a Zstandard dictionary built from the
archive's own records, then a Zstandard frame per record. The dictionary is trained on the first ``SAMPLE_BYTES`` of records, or more, up to
``HOLD_BYTES``, until there are ``SAMPLES``; if training finds too little in common, it is the last ``DICT_BYTES`` of those records as they stand. The first
row with a payload of ``least`` bytes or more, by smallest page_id, is a ``response``; equal payloads after it are ``revisit``
records, which name the response and keep only the HTTP headers. Shorter payloads are all responses.

Archives are written to a folder that all executors share. Each attempt of a task writes a file of its own; the list that ``write`` returns names those
that counted, and the others are deleted.

Nulls and empties: a null payload is empty; a null url is the empty target; a null page_id is archived as a response (it can't be referred to) and read back
as null; rows that repeat a page_id with one payload: one is the response, the rest revisit it. An empty table writes
no archive and gives no rows. Very long payloads are records like others. Ties: of rows that repeat a page_id and payload any may be the response; their rows
read back are the same. Other columns aren't read."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = 0x184D2A5D
SAMPLE_BYTES, HOLD_BYTES, SAMPLES, DICT_BYTES, LEVEL = 2 << 20, 32 << 20, 8, 64 << 10, 3
DATE = "2024-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None, copy: int = 0) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{copy}')}"


def _line(text: str) -> str:
    """A header value on one line: control characters and spaces are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, copy: int = 0) -> bytes:
    """A whole record. For a revisit refers_to is the response's page_id, and the block has the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_uri(page_id, copy)}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"WARC-X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_uri(refers_to)}>", f"WARC-X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers (lower-case names), HTTP headers and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    size = int(fields["content-length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n" or fields["warc-block-digest"] != "sha1:" + digest_of(block):
        raise ValueError(f"a damaged record: {fields['warc-record-id']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary from records, or else their last bytes."""
    try:
        if len(samples) >= SAMPLES:
            return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        pass
    return b"".join(samples[-64:])[-DICT_BYTES:]


class Writer:
    """Writes records to a binary stream. Records are held until there is a sample to build the dictionary from."""

    def __init__(self, out):
        self.out, self.held, self.size, self.compress = out, [], 0, None
        self.records = 0

    def add(self, raw: bytes) -> None:
        self.records += 1
        if self.compress:
            self.out.write(self.compress(raw))
            return
        self.held.append(raw)
        self.size += len(raw)
        if self.size >= (SAMPLE_BYTES if len(self.held) >= SAMPLES else HOLD_BYTES):
            self._start()

    def _start(self) -> None:
        raw = build_dictionary(self.held)
        self.out.write(struct.pack("<II", MAGIC, len(raw)) + raw)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None).compress
        for x in self.held:
            self.out.write(self.compress(x))
        self.held = []

    def close(self) -> None:
        if not self.compress:
            self._start()


def read_archive(file) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    magic, size = struct.unpack("<II", file.read(8))
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    raw = file.read(size)
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    left = b""
    while True:
        one = unpack.decompressobj()
        out = io.BytesIO()
        while not one.eof:
            piece = left or file.read(1 << 20)
            left = b""
            if not piece:
                if out.tell():
                    raise ValueError("a cut record")
                return
            out.write(one.decompress(piece))
            left = one.unused_data
        yield out.getvalue()


def planned(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload, refers_to and copy (rows of one page_id and payload are numbered; all but number 0 revisit it)."""
    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    keyed = narrow.withColumn("_d", F.when(F.octet_length("payload") >= least, F.sha1("payload")))
    # Partial sums first: a payload that a third of all pages have is one row of this.
    low = keyed.where("_d is not null").groupBy("_d").agg(F.min("page_id").alias("_m"), F.count("*").alias("_n"))
    firsts = common.written(low.where("_n > 1 and _m is not null").select("_d", F.col("_m").alias("_first"), "_n"), "firsts")
    few = firsts.count() <= common.JOIN_AT_ONCE
    cols = ["page_id", "url", "payload", "refers_to", "copy"]
    if few:
        met = keyed.join(F.broadcast(firsts), "_d", "left")
    else:
        alone = keyed.join(firsts.select("_d"), "_d", "left_anti")
        met = common.hot_join(keyed, firsts, "_d", "_n").unionByName(alone.select("_d", "page_id", "url", "payload", F.lit(None).cast("long").alias("_first"), F.lit(None).cast("long").alias("_n")))
    refers = F.when(F.col("page_id") > F.col("_first"), F.col("_first"))
    # Rows that repeat the response's page_id and payload are few or none; only if there are some, they are numbered.
    is_first = F.coalesce(F.col("page_id") == F.col("_first"), F.lit(False))
    slim = met.where(is_first).select("_d")
    again = common.written(slim.groupBy("_d").agg(F.count("*").alias("_c")).where("_c > 1"), "again")
    if not again.limit(1).count():
        return met.select("page_id", "url", "payload", refers.alias("refers_to"), F.lit(0).alias("copy"))
    first = common.written(met.where(is_first).drop("_n").withColumn("_u", F.monotonically_increasing_id()), "repeats")
    least_u = common.written(first.groupBy("_d").agg(F.min("_u").alias("_low"), F.count("*").alias("_c")), "least")
    numbered = common.hot_join(first, least_u, "_d", "_c").withColumn("copy", F.when(F.col("_u") == F.col("_low"), F.lit(0)).otherwise(F.col("_u") + 1))
    rest = met.where(~is_first).select("page_id", "url", "payload", refers.alias("refers_to"), F.lit(0).cast("long").alias("copy"))
    return rest.unionByName(numbered.select("page_id", "url", "payload", F.when(F.col("copy") > 0, F.col("page_id")).alias("refers_to"), F.col("copy").cast("long").alias("copy"))).select(*cols)


def write(pages: DataFrame, folder: str, **how) -> list[dict]:
    """Writes the archives; returns path and number of records of each."""
    common.small_batches(pages.sparkSession)
    plan = planned(pages, **how)
    at, root = common.filesystem(folder)
    at.create_dir(root, recursive=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin()
        rows = (r for batch in batches for part in common.slices(batch, "payload") for r in zip(*(c.to_pylist() for c in part.columns), strict=True))
        if (first := next(rows, None)) is None:
            return
        with common.attempt(folder, f"pages-{TaskContext.get().partitionId():06d}", ".warc.zst") as (path, sink):
            out = Writer(sink)
            for page_id, url, payload, refers_to, copy in chain([first], rows):
                out.add(record(page_id, url, payload.encode("utf-8", "surrogatepass"), refers_to, copy))
            out.close()
        yield pa.RecordBatch.from_pydict({"path": [path], "records": [out.records]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

    archives = [r.asDict() for r in plan.mapInArrow(put, "path string, records long").collect()]  # one per archive
    common.tidy(folder, [a["path"] for a in archives])
    return archives


SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_OUT = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def facts(raw: bytes) -> tuple:
    """The row of a record. A response's digest and size are taken from its payload and must be those in its headers."""
    fields, http, payload = parse(raw)
    kind = fields["warc-type"]
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    if kind == "response" and (size, digest) != (len(payload), digest_of(payload)):
        raise ValueError(f"a damaged payload: {fields['warc-record-id']}")
    number = lambda k: int(fields[k]) if k in fields else None
    return number("warc-x-page-id"), size, digest, kind, number("warc-x-refers-to-page-id")


def read(spark: SparkSession, archives: list[dict]) -> DataFrame:
    """A row per record, from the archives."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, where = common.filesystem(path)
                rows = []
                with store.open_input_stream(where, compression=None) as file:
                    for raw in read_archive(file):
                        rows.append(facts(raw))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

    files = spark.createDataFrame([(a["path"],) for a in archives], "path string")
    return files.repartition(max(1, len(archives))).mapInArrow(load, SCHEMA)
