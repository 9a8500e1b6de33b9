"""String functions over columns: the three views of a chunk's text, n-grams, tokens and sentences."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The code points without width that are replaced or deleted.
ZERO_WIDTH = "​‌‍⁠﻿"
_WHITE = "[\\p{IsWhite_Space}\\x1c-\\x1f]+"
TOKEN = "[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]"
SENTENCE = "[^.!?\\n]+[.!?]*"


def strip_zero_width(text: Column, keep_length: bool = False) -> Column:
    """Deletes characters without width, or puts a space for each."""
    return F.translate(text, ZERO_WIDTH, " " * len(ZERO_WIDTH) if keep_length else "")


def mask_numbers(text: Column) -> Column:
    """Every decimal digit of any script becomes 0."""
    return F.regexp_replace(text, "\\p{Nd}", "0")


def normalize_whitespace(text: Column) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, _WHITE, " "))


def canonical_phrases(phrases: Iterable[str]) -> list[str]:
    """The order in which phrases are removed: longer first, then by value."""
    return sorted({p for p in phrases if p}, key=lambda p: (-len(p), p))


def remove_phrases(text: Column, phrases: Iterable[str], keep_length: bool = False) -> Column:
    """Each phrase, wherever it stands, becomes one space, or as many as it has characters."""
    for p in canonical_phrases(phrases):
        text = F.replace(text, F.lit(p), F.lit(" " * len(p) if keep_length else " "))
    return text


def expand_plain(text: Column, mapping: Mapping[str, str]) -> Column:
    """Plain replacements one after another, in the mapping's order."""
    for src, dst in mapping.items():
        text = F.replace(text, F.lit(src), F.lit(dst))
    return text


def align_form(text: Column, lowercase: bool = True, numbers: bool = True, zero_width: bool = True) -> Column:
    """The view for alignment, which keeps the length: no characters without width, lower case, digits as 0."""
    if zero_width:
        text = strip_zero_width(text, keep_length=True)
    if lowercase:
        text = F.lower(text)
    return mask_numbers(text) if numbers else text


def html_escape(text: Column, quotes: bool = False) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quotes else ())):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def char_ngrams(text: Column, n: int, pad: bool = False) -> Column:
    """All n-grams of characters in order, repeats included; none of a shorter text."""
    if pad:
        text = F.concat(F.lit(" "), text, F.lit(" "))
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), 1)


def tokens(text: Column) -> Column:
    """Words and single signs."""
    return F.regexp_extract_all(text, F.lit(TOKEN), 0)


def sentences(text: Column) -> Column:
    """Sentences, trimmed, without empty ones."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), 0), lambda s: F.trim(s)), lambda s: s != "")


def linearized(paragraphs: Column, tables: Column) -> Column:
    """Paragraphs, then all cells by table, row and column, joined by line ends."""
    return F.concat_ws("\n", F.concat(F.coalesce(paragraphs, F.array().cast("array<string>")), F.coalesce(F.flatten(F.flatten(tables)), F.array().cast("array<string>"))))


def cell_offsets(paragraphs: Column, tables: Column) -> Column:
    """Per cell: text, table, row, column and its place in the linearised text, the line end included."""
    first = F.aggregate(F.coalesce(paragraphs, F.array().cast("array<string>")), F.lit(0), lambda n, p: n + F.length(p) + 1)
    cells = F.flatten(F.flatten(F.transform(tables, lambda t, i: F.transform(t, lambda r, j: F.transform(r, lambda c, k: F.struct(c.alias("text"), i.alias("table_id"), j.alias("row"), k.alias("col")))))))
    empty = F.array().cast("array<struct<text:string,table_id:int,row:int,col:int,start:int,end:int>>")

    def put(acc, c):
        size = F.length(c["text"]) + 1
        return F.struct((acc["at"] + size).alias("at"), F.array_append(acc["cells"], F.struct(c["text"].alias("text"), c["table_id"].alias("table_id"), c["row"].alias("row"), c["col"].alias("col"), acc["at"].alias("start"), (acc["at"] + size).alias("end"))).alias("cells"))

    return F.aggregate(cells, F.struct(first.alias("at"), empty.alias("cells")), put, lambda acc: acc["cells"])


def content_key(model: str, text: Column) -> Column:
    """Identity of a text under a model: its cache key."""
    return F.md5(F.concat(F.lit(model + "||"), text))


def content_key_list(texts: Column) -> Column:
    """Identity of a list of texts in order: a record separator stands before each."""
    return F.md5(F.array_join(F.transform(texts, lambda t: F.concat(F.lit("\x1e"), t)), ""))


def content_key_texts(model: str, texts: Column) -> Column:
    """Identity of a list of texts under a model."""
    return F.md5(F.concat(F.lit(f"model={model}||"), content_key_list(texts)))


def content_key_bytes(raw: Column) -> Column:
    return F.md5(raw.cast("binary"))


def dual_form(text: Column, lowercase: bool = True, form: str | None = "NFC") -> Column:
    """The text normalised and lower-cased, and the same without accents: (text, plain)."""
    full = nfc(text, form) if form else text
    full = F.lower(full) if lowercase else full
    return F.struct(full.alias("text"), remove_accents(full).alias("plain"))


def percent(score: Column) -> Column:
    """A score as a label: 12.3 %, without the space."""
    return F.format_string("%.1f%%", score.cast("double") * 100)


def label(level: Column) -> Column:
    """A level as a label: upper case, words apart."""
    return F.upper(F.replace(level, F.lit("_"), F.lit(" ")))


# Functions for which Spark has no expression: Arrow UDFs.


def fold_accents(text: str) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return bare.replace("đ", "d").replace("Đ", "D")


@F.pandas_udf(StringType())
def remove_accents(text: pd.Series) -> pd.Series:
    return text.map(fold_accents, na_action="ignore")


def nfc(text: Column, form: str = "NFC") -> Column:
    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return normal(text)


class WordMap:
    """Replaces whole words in one pass, longest key first, whatever their case; the value is put in as it is."""

    def __init__(self, mapping: Mapping[str, str]):
        self.values = {k.lower(): v for k, v in mapping.items() if k}
        keys = sorted(self.values, key=lambda k: (-len(k), k))
        self.pattern = re.compile(rf"\b(?:{'|'.join(map(re.escape, keys))})\b", re.IGNORECASE) if keys else None

    def __call__(self, text: str) -> str:
        return self.pattern.sub(lambda m: self.values.get(m[0].lower(), m[0]), text) if self.pattern else text


class Retrieval:
    """The lossy view for retrieval: NFC, lower case, no characters without width, abbreviations, then synonyms, then
    phrases out, white space collapsed. Each step can be left out."""

    def __init__(self, abbreviations: Mapping[str, str] = {}, synonyms: Mapping[str, str] = {}, stop_phrases: Sequence[str] = (), boilerplate: Sequence[str] = (), lowercase: bool = True, form: str | None = "NFC", zero_width: bool = True):
        self.maps = [WordMap(abbreviations), WordMap(synonyms)]
        self.phrases = [*canonical_phrases(stop_phrases), *canonical_phrases(boilerplate)]
        self.lowercase, self.form = lowercase, form
        self.zero = dict.fromkeys(map(ord, ZERO_WIDTH)) if zero_width else {}

    def __call__(self, text: str) -> str:
        if self.form:
            text = unicodedata.normalize(self.form, text)
        if self.lowercase:
            text = text.lower()
        text = text.translate(self.zero)
        for m in self.maps:
            text = m(text)
        for p in self.phrases:
            text = text.replace(p, " ")
        return " ".join(text.split())


def retrieval_form(text: Column, how: Retrieval) -> Column:
    @F.pandas_udf("string")
    def view(s: pd.Series) -> pd.Series:
        return s.map(how, na_action="ignore")

    return view(text)
