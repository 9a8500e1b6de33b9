"""Operator 1, packing: shortest-pack-first over the length histogram.

1. Texts are encoded and cut into pieces of at most ``max_len`` ids: full pieces, then the rest of the document.
2. The histogram of piece lengths (``max_len`` numbers, whatever the corpus) is packed on the driver: lengths go longest
   first, each into the shortest pack that has room; what is kept is how often each packing pattern occurs.
3. Pieces of one length are ranked over a range partitioning, so that a length held by a third of all pieces is
   spread; a piece's rank gives its pattern, sequence and offset.

Nulls and empties: a null text is empty and still has its end id. A null identifier is kept as null. Repeated rows are
packed each for itself. An empty table gives no rows. Only the identifier and text columns are read, so other columns
of any name do no harm. Very long texts are encoded whole and cut. Ties: pieces of one length go by identifier, start and checksum."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, encode

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])
END_ID = 1


def pieces(docs: DataFrame, max_len: int = 2048, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of at most ``max_len`` ids, the document's end id included."""
    common.small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encode.encoder(tokenizer)
        for batch in batches:
            for part in common.slices(batch, "text"):
                rows: list[tuple] = []
                for doc, raw in zip(part.column("doc_id").to_pylist(), enc.ids(common.texts_of(part.column("text"))), strict=True):
                    ids = np.append(np.frombuffer(raw, enc.kind), enc.kind.type(END_ID)).astype("<u4")
                    rows += [(doc, at, min(max_len, len(ids) - at), encode.crc(ids[at : at + max_len]), len(ids)) for at in range(0, len(ids), max_len)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


def patterns(histogram: dict[int, int], max_len: int = 2048) -> list[tuple[int, list[int]]]:
    """Shortest-pack-first: (how often, lengths) of each pattern. Each step extends or splits one pattern, so their
    number is bounded by the number of distinct lengths, not by the number of pieces."""
    open_: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)  # by room left
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        grown: list[tuple[int, int, list[int]]] = []
        for room in sorted((r for r in open_ if r >= length), reverse=True):
            # Packs of one room take as many of this length as fit, longest room first.
            while left and open_[room]:
                count, lengths = open_[room].pop()
                fit = min(room // length, -(-left // count))
                full = min(count, left // fit)
                if full < count:
                    open_[room].append((count - full, lengths))
                if not full:  # fewer pieces than one pack could take
                    open_[room][-1] = (count - 1, lengths)
                    full, fit = 1, left
                left -= full * fit
                grown.append((room - fit * length, full, lengths + [length] * fit))
                open_[room] = [x for x in open_[room] if x[0]]
            if not left:
                break
        for room, count, lengths in grown:
            open_[room].append((count, lengths))
        if left:
            fit = max_len // length
            if left >= fit:
                open_[max_len - fit * length].append((left // fit, [length] * fit))
            if left % fit:
                open_[max_len - left % fit * length].append((1, [length] * (left % fit)))
    return [(count, lengths) for group in open_.values() for count, lengths in group]


def _slots(found: list[tuple[int, list[int]]], max_len: int) -> dict[str, np.ndarray]:
    """For each length, the ranks each place of each pattern takes: sorted by (length, first rank)."""
    taken: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for count, lengths in found:
        offset = 0
        for length in lengths:
            rows.append((length, taken[length], base, offset))
            taken[length] += count
            offset += length
        base += count
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return {"length": cols[0], "rank": cols[1], "base": cols[2], "offset": cols[3]}


def pack(spark: SparkSession, docs: DataFrame, max_len: int = 2048, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their ``sequence_id`` and ``offset``."""
    cut = common.written(pieces(docs, max_len, tokenizer, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most max_len rows
    slots = _slots(patterns(histogram, max_len), max_len)
    # Place of each piece: its partition and its place there, fixed by writing them.
    dealt = common.written(cut.repartitionByRange("length", "doc_id", "start", "ids_crc32").sortWithinPartitions("length", "doc_id", "start", "ids_crc32").withColumn("_at", F.monotonically_increasing_id()), "dealt")
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND((1 << 33) - 1))
    # A partition holds a run of lengths, so this has about one row per partition and one per length.
    runs = dealt.groupBy("length", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = dealt.join(runs.select("length", "_part", (before - F.col("_first")).alias("_shift")), ["length", "_part"]).select(*_ARROW.names, (F.col("_row") + F.col("_shift")).alias("_rank"))
    out = pa.schema([*_ARROW, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Length and rank in one sortable number: ranks stay below 2**50.
        known = (slots["length"] << 50) + slots["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            k = np.searchsorted(known, (length << 50) + rank, side="right") - 1
            at = slots["base"][k] + rank - slots["rank"][k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _ARROW.names), pa.array(at), pa.array(slots["offset"][k])], schema=out)

    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
