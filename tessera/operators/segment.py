"""Texts to lines, blocks, sentences and chunks, with offsets.

Lines, blocks and sentences are native; chunks come from one Arrow pass over whole texts, as a chunk starts where the one before
it says, and need no shuffle."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SENTENCE

# Line ends: CR LF, or one of LF VT FF CR FS GS RS NEL LS PS.
_ENDS = "\\n\\x0B\\x0C\\r\\x1C-\\x1E\\u0085\\u2028\\u2029"
LINE = f"[^{_ENDS}]*(?:\\r\\n|[{_ENDS}])|[^{_ENDS}]+"


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per line with its end, its number and offsets: key, line_no, line, start, end."""
    found = docs.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(LINE), 0)).alias("line_no", "line"))
    w = Window.partitionBy(key).orderBy("line_no")
    return found.withColumn("end", F.sum(F.length("line")).over(w)).withColumn("start", F.col("end") - F.length("line"))


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, "^[\\p{IsWhite_Space}\\x1c-\\x1f]+|[\\p{IsWhite_Space}\\x1c-\\x1f]+$", "")


def blocks(docs: DataFrame, headings: Iterable[str] = (), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of lines: a blank line ends one, a heading line is one of its own. key, block_no, text, start, end, is_heading."""
    known = sorted({h.strip().lower() for h in headings if h.strip()})
    found = lines(docs, key, text).withColumn("bare", _bare(F.col("line")))
    kind = F.when(F.col("bare") == "", F.lit("blank")).when(F.lower("bare").isin(known) if known else F.lit(False), F.lit("heading")).otherwise(F.lit("text"))
    w = Window.partitionBy(key).orderBy("line_no")
    found = found.withColumn("kind", kind).withColumn("before", F.lag("kind").over(w))
    opens = (F.col("kind") == "heading") | ((F.col("kind") == "text") & (F.coalesce("before", F.lit("blank")) != "text"))
    found = found.withColumn("island", F.sum(opens.cast("int")).over(w)).where("kind != 'blank'")
    whole = found.groupBy(key, "island").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "").alias("raw"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.max("bare").alias("bare"),
        (F.max("kind") == "heading").alias("is_heading"),
    )
    lead = F.instr("raw", F.col("bare")) - 1
    shaped = whole.select(
        key,
        (F.col("island") - 1).cast("int").alias("block_no"),
        F.when(F.col("is_heading"), F.col("bare")).otherwise(F.col("raw")).alias("text"),
        (F.col("start") + F.when(F.col("is_heading"), lead).otherwise(F.lit(0))).cast("int").alias("start"),
        F.when(F.col("is_heading"), F.col("start") + lead + F.length("bare")).otherwise(F.col("end")).cast("int").alias("end"),
        "is_heading",
    )
    return shaped


def sentences_with_offsets(text: Column) -> Column:
    """Array of (text, start, end): each sentence trimmed of spaces, its offsets carried from the splitting itself."""
    raw = F.regexp_extract_all(text, F.lit("[^.!?\\n]+[.!?]*|[.!?\\n]"), 0)
    empty = F.array().cast("array<struct<text:string,start:int,end:int>>")

    def step(acc, piece):
        lead = F.length(piece) - F.length(F.ltrim(piece))
        body = F.trim(piece)
        held = piece.rlike("^[^.!?\\n]") & (body != "")
        one = F.struct(body.alias("text"), (acc["at"] + lead).alias("start"), (acc["at"] + lead + F.length(body)).alias("end"))
        return F.struct((acc["at"] + F.length(piece)).alias("at"), F.when(held, F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(raw, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def locate_all(text: Column, parts: Column) -> Column:
    """(start, end) of given parts, looked for one after another; a part that isn't found is put where the search stands."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc, s):
        found = F.call_function("locate", s, text, acc["at"] + 1)
        start = F.when(found > 0, found - 1).otherwise(acc["at"])
        return F.struct((start + F.length(s)).alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), (start + F.length(s)).alias("end"))).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


# --- chunks -------------------------------------------------------------------------------------------------------

_SENTENCE = re.compile(SENTENCE)
_TOKEN = re.compile(r"\w+|[^\w\s]")


def split_sentences(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in _SENTENCE.finditer(text):
        body = m[0].strip(" ")
        if body:
            start = m.start() + len(m[0]) - len(m[0].lstrip(" "))
            out.append((body, start, start + len(body)))
    return out


def count_tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


def windows(sizes: Sequence[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Which items [i, j) each chunk holds, from the items' token counts: as many as fit into ``size`` (one at least), the
    next beginning after ``size - overlap`` tokens or one item on, until the last item is in."""
    total = [0]
    for n in sizes:
        total.append(total[-1] + n)
    out, i, n = [], 0, len(sizes)
    step = max(1, size - overlap)
    while i < n:
        # Items without tokens never fill a chunk, so the first item that counts is always taken.
        j = i
        while j < n and (total[j + 1] - total[i] <= size or total[j] == total[i]):
            j += 1
        out.append((i, j))
        if j == n:
            break
        i = next((k for k in range(i + 1, j + 1) if total[k] - total[i] >= step), i + 1)
    return out


def text_blocks(text: str, headings: frozenset[str] = frozenset()) -> Iterator[tuple[str, int, bool]]:
    """(text, start, is_heading) of the blocks, as ``blocks`` has them."""
    at, first, held = 0, 0, []
    for line in text.splitlines(keepends=True):
        bare = line.strip()
        if held and (not bare or bare.lower() in headings):
            yield "".join(held), first, False
            held = []
        if bare and bare.lower() in headings:
            yield bare, at + line.index(bare), True
        elif bare:
            first = first if held else at
            held.append(line)
        at += len(line)
    if held:
        yield "".join(held), first, False


CHUNK = "chunk_id int, disp string, char_start int, char_end int, n_tokens int, is_heading boolean"


def chunk_text(text: str, size: int, overlap: int, paragraphs: bool, headings: frozenset[str], sentence_split: Callable = split_sentences, tokens: Callable = count_tokens) -> list[tuple]:
    out: list[tuple] = []
    for body, base, heading in text_blocks(text, headings) if paragraphs else [(text, 0, False)]:
        if heading:
            out.append((len(out), body, base, base + len(body), tokens(body), True))
            continue
        parts = sentence_split(body)
        sizes = [tokens(s) for s, _, _ in parts]
        for i, j in windows(sizes, size, overlap):
            out.append((len(out), " ".join(s for s, _, _ in parts[i:j]), base + parts[i][1], base + parts[j - 1][2], sum(sizes[i:j]), False))
    return out


def chunks(docs: DataFrame, size: int = 260, overlap: int = 50, paragraphs: bool = True, headings: Iterable[str] = (), key: str = "doc_id", text: str = "text", sentence_split: Callable = split_sentences, tokens: Callable = count_tokens) -> DataFrame:
    """A row per chunk: key and CHUNK. Null and blank texts have none."""
    known = frozenset(h.strip().lower() for h in headings if h.strip())
    key_type = docs.schema[key].dataType
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    shape = StructType([StructField(key, key_type), *_parse_datatype_string(CHUNK).fields])
    schema = to_arrow_schema(shape)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            weight = 0
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(k, *c) for c in chunk_text(t or "", size, overlap, paragraphs, known, sentence_split, tokens)]
                weight += len(t or "")
                if weight > 4_000_000:
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, weight = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select(key, F.col(text).cast("string")).mapInArrow(cut, shape)
