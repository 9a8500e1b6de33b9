"""DOCX documents as rows, read with the standard library on the executors."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cell_offsets, linearized

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "path string, paragraphs array<string>, tables array<array<array<string>>>"


def _text(element) -> str:
    out = []
    for e in element.iter():
        if e.tag == f"{_W}t":
            out.append(e.text or "")
        elif e.tag == f"{_W}tab":
            out.append("\t")
        elif e.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def parse(raw: bytes) -> tuple[list[str], list[list[list[str]]]]:
    """Non-empty stripped paragraphs of the body, and the stripped cells of its tables."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    paragraphs = [t for p in body.findall(f"{_W}p") if (t := _text(p).strip())]
    tables = [[["\n".join(_text(p) for p in cell.findall(f"{_W}p")).strip() for cell in row.findall(f"{_W}tc")] for row in table.findall(f"{_W}tr")] for table in body.findall(f"{_W}tbl")]
    return paragraphs, tables


def read(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """A row per .docx file below path: path, paragraphs, tables."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", str(recursive).lower()).load(path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("paragraphs", pa.list_(pa.string())), ("tables", pa.list_(pa.list_(pa.list_(pa.string()))))])
        for batch in batches:
            got = [parse(raw) for raw in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path").cast(pa.string()), pa.array([g[0] for g in got], schema.field(1).type), pa.array([g[1] for g in got], schema.field(2).type)], schema=schema)

    return files.select("path", "content").mapInArrow(rows, SCHEMA)


def ignore_sections(paragraphs: Column, headers: tuple[str, ...]) -> Column:
    """Drops paragraphs that hold one of the headers, whatever the case; those that stay are lower-cased. Without headers nothing changes."""
    known = [h.lower() for h in headers if h]
    if not known:
        return paragraphs
    return F.filter(F.transform(paragraphs, F.lower), lambda p: ~F.exists(F.array(*map(F.lit, known)), lambda h: F.contains(p, h)))


def documents(docs: DataFrame, keep_tables: bool = True, headers: tuple[str, ...] = ()) -> DataFrame:
    """Adds the linearised text and the cells' offsets."""
    tables = F.col("tables") if keep_tables else F.array().cast("array<array<array<string>>>")
    kept = docs.withColumn("tables", tables).withColumn("paragraphs", ignore_sections(F.col("paragraphs"), headers))
    return kept.withColumn("text", linearized(F.col("paragraphs"), F.col("tables"))).withColumn("cells", cell_offsets(F.col("paragraphs"), F.col("tables")))


def build(paragraphs: list[str], tables: list[list[list[str]]] = ()) -> bytes:
    """A minimal DOCX file."""
    from xml.sax.saxutils import escape

    def para(t: str) -> str:
        return f'<w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>'

    body = "".join(map(para, paragraphs)) + "".join("<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in row) + "</w:tr>" for row in t) + "</w:tbl>" for t in tables)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()
