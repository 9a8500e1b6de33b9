"""Operator 8, information-theoretic sanitisation of personal data.

Base spans: e-mail addresses, IP addresses, card and phone numbers, each kind leftmost and without overlaps of its own.
Then terms that reveal them, by co-occurrence over all documents. A term is a lower-cased word, or a word with digits generalised to its
shape ("#9:16" sixteen digits, "#x:40" forty letters and digits), outside entities. It discloses a kind k by PMI(t; k) / IC(k), and
exceeds the threshold at ``DISCLOSURE`` or more. Two scopes are estimated:

* Windows: of N words, n_k stand among the ``WINDOW`` words to each side of the entities of kind k (line ends don't matter);
  PMI = log(N n_tk / (n_t n_k)), IC = -log(n_k / N). All counts are of occurrences, copies included, a word next to several entities of a kind
  once for that kind. A term needs ``SUPPORT`` windows with different entities or words. It is revealing in a window of an entity of that kind.
* Documents: the same with documents that hold an entity of kind k, or of any kind, in place of windows. Of documents with equal sets of entities one
  counts, that with the smallest hash of its text, and of equal texts without entities one, as copies say nothing new. A term needs ``SUPPORT`` documents, and more than chance would give any of the
  V terms if the entities were shuffled over the documents: by Chernoff's bound, n_t KL(n_tk / n_t || n_k / N) >= log(V / ``CHANCE``). It is
  revealing wherever it stands, in documents without an entity too: it tells that there is or was personal data.

Revealing terms are spans of kind ``term``. ``sanitised`` replaces entities by their kind, removes revealing words, and generalises revealing
words with digits to "[CODE]".

Nulls and empties: a null text is empty and has no spans; a null identifier is kept as null; repeated rows give a row each; an
empty table gives no rows; columns other than the text aren't read. Very long texts are read whole. Ties: spans that start
together stand in the order email, ip, card, phone, term."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
WINDOW, SUPPORT, DISCLOSURE, CHANCE = 3, 8, 0.8, 1e-3
#: Scopes: a term is revealing near an entity of kind 0 to 3, or, as kind ANYWHERE, wherever it stands.
ANY, ANYWHERE = 4, 5
#: One of so many texts is read first, for a bound that rules most terms out.
PART = 8
#: Terms that may reach SUPPORT are collected if they are so many at most; more are counted by a join.
TERMS_AT_ONCE = 200_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match starts where a run of digits does: from within the run it would fail alike.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"\d")


def _emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)  # what stands before this sign can't begin a later match
        at = text.find("@", end)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and (not p or int(p) <= 255) for x in text.split("."))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def entities(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) in order of start, then kind; code points, end exclusive."""
    found = [(s, e, 0) for s, e in _emails(text)] if "@" in text else []
    found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if _octets(m[0])]
    found += [(m.start(), m.end(), 2) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
    if "+" in text:
        found += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda x: (x[0], x[2]))


def term_of(word: str) -> str:
    """The term a word stands for: itself, lower-cased, or its shape if it has digits."""
    if not _DIGIT.search(word):
        return word.lower()
    return f"#9:{len(word)}" if word.isdigit() else f"#x:{len(word)}"


def said(text: str) -> list[str]:
    """The terms of all words of a text."""
    words = _WORD.findall(text)
    return list(map(term_of if _DIGIT.search(text) else str.lower, words))


def terms_in(text: str, found: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the words outside all entities."""
    edges: list[list[int]] = []  # the entities, merged where they overlap
    for s, e, _ in found:
        if edges and s <= edges[-1][1]:
            edges[-1][1] = max(edges[-1][1], e)
        else:
            edges.append([s, e])
    k = 0
    for m in _WORD.finditer(text):
        while k < len(edges) and edges[k][1] <= m.start():
            k += 1
        if k == len(edges) or m.end() <= edges[k][0]:
            yield term_of(m[0]), m.start(), m.end()


def around(found: list[tuple[int, int, int]], words: list[tuple[str, int, int]], window: int = WINDOW) -> list[tuple[int, list[tuple[str, int, int]]]]:
    """For each entity its kind and the words (term, start, end) next to it, of those outside all entities."""
    starts, ends = [w[1] for w in words], [w[2] for w in words]
    out = []
    for start, end, kind in found:
        left, right = bisect_right(ends, start), bisect_left(starts, end)
        out.append((kind, words[max(0, left - window) : left] + words[right : right + window]))
    return out


def _hash(text: str) -> int:
    """A 64-bit key; that of the empty text stands for all words, or for the document itself."""
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _rows(rows, schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _listed(terms: DataFrame):
    """The distinct terms, broadcast, or None if they are over TERMS_AT_ONCE."""
    names = terms.select("term").distinct()
    return terms.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in names.collect()) if names.count() <= TERMS_AT_ONCE else None)


def _disclosed(n_tk, n_t, n_k, total):
    """PMI over information content."""
    return F.log(total * n_tk / (n_t * n_k)) / -F.log(n_k / total)


def revealing(docs: DataFrame, text_col: str = "text", window: int = WINDOW, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(kind, term) of the terms that exceed the threshold, from counts over all documents: kind 0 to 3 in windows, ANYWHERE in documents."""
    common.small_batches(docs.sparkSession)
    narrow = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marks = pa.schema([("kind", pa.int32()), ("term", pa.string()), ("place", pa.int64()), ("n", pa.int64()), ("h", pa.int64())])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A row for each term of a window, with its occurrences; and, of kind -1, one for each document with entities: all its terms, its set of entities, its kinds as bits.
        common.begin()
        for batch in batches:
            for part in common.slices(batch, "text"):
                own: Counter = Counter()
                rows: list[tuple] = []
                for text in common.texts_of(part.column("text")):
                    if not (found := entities(text)):
                        continue
                    counted: set[tuple[int, int]] = set()
                    words = list(terms_in(text, found))
                    for (start, end, _), (kind, close) in zip(found, around(found, words, window), strict=True):
                        place = _hash("\n".join([text[start:end], *(w for w, _, _ in close)]))
                        for w, at, _ in close:
                            own[kind, w, place] += (kind, at) not in counted
                            counted.add((kind, at))
                    unit = _hash("\n".join(sorted({text[s:e] for s, e, _ in found})))
                    rows.append((-1, "\n".join(sorted({w for w, _, _ in words})), unit, sum(1 << k for k in {k for *_, k in found}), _hash(text)))
                if rows:
                    yield _rows(rows + [(*k, n, None) for k, n in own.items()], marks)

    seen = common.written(narrow.mapInArrow(near, "kind int, term string, place long, n long, h long"), "seen")
    each = seen.where("kind >= 0").groupBy("kind", "term", "place").agg(F.sum("n").alias("n"))
    windows = common.written(each.groupBy("kind", "term").agg(F.count("*").alias("support"), F.sum("n").alias("n_tk")), "windows")
    by_kind = {r["kind"]: float(r["n"]) for r in windows.groupBy("kind").agg(F.sum("n_tk").alias("n")).collect()}  # four at most
    windows = common.written(windows.where((F.col("support") >= support) & (F.col("n_tk") > 0)).select("kind", "term", "n_tk"), "windows")
    # Of the documents with one set of entities, that with the smallest hash of its text.
    units = seen.where("kind = -1").groupBy("place").agg(F.min_by(F.struct("n", "term"), "h").alias("one")).select("one.n", "one.term")
    shape = pa.schema([("term", pa.string()), *((f"n{k}", pa.int64()) for k in range(ANY + 1))])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The empty term stands for the document itself.
        common.begin()
        own: dict[str, np.ndarray] = {}
        for batch in batches:
            for bits, terms in zip(batch.column("n").to_pylist(), batch.column("term").to_pylist(), strict=True):
                one = np.array([*(bits >> k & 1 for k in range(ANY)), 1])
                for w in {"", *terms.split("\n")}:
                    own[w] = own[w] + one if w in own else one
                if len(own) > 50_000:
                    yield _rows([(w, *n.tolist()) for w, n in own.items()], shape)
                    own = {}
        if own:
            yield _rows([(w, *n.tolist()) for w, n in own.items()], shape)

    names = [f"n{k}" for k in range(ANY + 1)]
    found = units.mapInArrow(held, "term string, " + ", ".join(f"{c} long" for c in names)).groupBy("term").agg(*[F.sum(c).alias(c) for c in names])
    found = common.written(found.where(F.col(f"n{ANY}") >= support), "found")
    whole = found.where("term = ''").first()
    u = [float(whole[c]) if whole else 0.0 for c in names]
    terms = found.where("term != ''")
    tried = terms.count()
    if tried:
        # A term can't exceed the threshold if the documents without entities in a part of the corpus, picked by hash, already hold it too often: the share of
        # kind k must be p ** (1 - disclosure), and p is u / rows at least. What is left is counted in all documents.
        part = _counted(narrow.where(F.pmod(F.xxhash64("text"), F.lit(PART)) == 0), terms, terms.where("false"))
        most = float(narrow.count() + u[ANY] + 1)
        met = terms.join(part.select("key", F.col("clean").alias("some")), _key("term") == F.col("key"), "left")
        can = [F.col(f"n{k}") >= support for k in range(ANY + 1)]
        can = [c & (F.col(f"n{k}") >= (F.col(f"n{ANY}") + F.coalesce("some", F.lit(0))) * float((max(u[k], 1.0) / most) ** (1 - disclosure)) * (1 - 1e-9)) for k, c in enumerate(can)]
        terms = common.written(met.where(reduce(Column.__or__, can)).select("term", *names), "possible")
    counts = _counted(narrow, terms, windows.select("term").distinct())
    all_words = counts.where(F.col("key") == _hash("")).first()
    total, clean = (float(all_words["n_t"]), all_words["clean"]) if all_words else (0.0, 0)
    n_k = F.element_at(F.create_map(*[F.lit(x) for k in range(ANY) for x in (k, by_kind.get(k, 1.0))]), F.col("kind"))
    near_by = windows.join(counts, _key("term") == F.col("key")).where(_disclosed(F.col("n_tk"), F.greatest("n_t", "n_tk"), n_k, F.lit(total + 1)) >= disclosure)
    n_docs = F.lit(u[ANY] + clean + 1)
    met = terms.join(counts, _key("term") == F.col("key"))
    sure = F.lit(False)
    for k in range(ANY + 1):
        n_t, p = F.col(f"n{ANY}") + F.col("clean"), F.lit(max(u[k], 1.0)) / n_docs
        q = F.col(f"n{k}") / n_t
        kl = n_t * (q * F.log(q / p) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0))
        sure |= (F.col(f"n{k}") >= support) & (q > p) & (kl >= math.log(max(1, tried) / CHANCE)) & (_disclosed(F.col(f"n{k}"), n_t, F.lit(max(u[k], 1.0)), n_docs) >= disclosure)
    return near_by.select("kind", "term").unionByName(met.where(sure).select(F.lit(ANYWHERE).alias("kind"), "term"))


def _key(term: str) -> Column:
    """The key of a term, as ``_counted`` has it."""

    @F.pandas_udf("long")
    def keys(s: pd.Series) -> pd.Series:
        return s.map(_hash)

    return keys(F.col(term))


def _counted(texts: DataFrame, terms: DataFrame, words: DataFrame) -> DataFrame:
    """(key, n_t, clean), written: of ``words`` the occurrences, of ``terms`` the different documents without entities that hold them. The key of the empty text
    has the number of all words and of all different documents without entities."""
    known, counted = _listed(terms), _listed(words)
    schema = pa.schema([("h", pa.int64()), ("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Part -1: a document without entities, by the hash of its text, with the keys of its terms. Other parts: occurrences, summed over some batches.
        common.begin()
        own: Counter = Counter()
        total, seq, part_id = 0, 0, TaskContext.get().partitionId()
        picked = lambda xs, of: xs if of.value is None else filter(of.value.__contains__, xs)

        def sums() -> tuple:
            return seq, part_id, np.array([_hash(w) for w in own], "<i8").tobytes(), np.array(list(own.values()), "<i8").tobytes()

        for batch in batches:
            for part in common.slices(batch, "text"):
                rows: list[tuple] = []
                for text in common.texts_of(part.column("text")):
                    spoken = said(text)
                    total += len(spoken)
                    own.update(picked(spoken, counted))
                    if not entities(text):
                        rows.append((_hash(text), -1, np.array([_hash(w) for w in {"", *picked(spoken, known)}], "<i8").tobytes(), None))
                if len(own) > 50_000:
                    rows.append(sums())
                    own, seq = Counter(), seq + 1
                if rows:
                    yield _rows(rows, schema)
        own[""] += total
        yield _rows([sums()], schema)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin()
        n_t: Counter = Counter()
        clean: list[np.ndarray] = []

        def rows() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(clean) if clean else np.empty(0, np.int64), return_counts=True)
            key, n = np.concatenate([key, np.fromiter(n_t, np.int64, len(n_t))]), np.concatenate([n, np.zeros(len(n_t), np.int64)])
            return pa.RecordBatch.from_pydict({"key": key, "n_t": np.concatenate([np.zeros(len(key) - len(n_t), np.int64), np.fromiter(n_t.values(), np.int64, len(n_t))]), "clean": n})

        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if counts is None:
                    clean.append(np.frombuffer(keys, "<i8"))
                else:
                    for k, n in zip(np.frombuffer(keys, "<i8").tolist(), np.frombuffer(counts, "<i8").tolist(), strict=True):
                        n_t[k] += n
            if sum(map(len, clean)) > 1_000_000 or len(n_t) > 100_000:
                yield rows()
                n_t, clean = Counter(), []
        yield rows()

    once = texts.mapInArrow(read, "h long, part long, keys binary, counts binary").groupBy("h", "part").agg(F.first("keys").alias("keys"), F.first("counts").alias("counts"))
    sums = once.select("keys", "counts").mapInArrow(tally, "key long, n_t long, clean long").groupBy("key").agg(F.sum("n_t").alias("n_t"), F.sum("clean").alias("clean"))
    return common.written(sums, "counted")


OWN, OWN_HASH = "__tessera_pii_terms__", "__tessera_pii_hash__"


def _with_terms(docs: DataFrame, terms: DataFrame, text_col: str):
    """What tells a task the revealing terms: one broadcast set if they are TERMS_AT_ONCE at most, or else a column with
    the terms of each document that has some, joined to it by the hash of its text."""
    terms = common.written(terms, "revealing")
    spark = docs.sparkSession
    if terms.count() <= TERMS_AT_ONCE:
        return docs.withColumn(OWN, F.lit(None).cast("array<string>")), spark.sparkContext.broadcast(frozenset((r["kind"], r["term"]) for r in terms.collect()))
    schema = pa.schema([("h", pa.int64()), ("kind", pa.int32()), ("term", pa.string())])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin()
        for batch in batches:
            for part in common.slices(batch, "text"):
                rows: list[tuple] = []
                for h, text in zip(part.column("h").to_pylist(), common.texts_of(part.column("text")), strict=True):
                    found = entities(text)
                    words = list(terms_in(text, found))
                    rows += {(h, kind, w) for kind, close in around(found, words) for w, _, _ in close} | {(h, ANYWHERE, w) for w, _, _ in words}
                if rows:
                    yield _rows(rows, schema)

    keyed = docs.select(F.xxhash64(F.col(text_col).cast("string")).alias("h"), F.col(text_col).cast("string").alias("text"))
    own = keyed.mapInArrow(near, "h long, kind int, term string").distinct().join(terms, ["kind", "term"])
    own = own.groupBy(F.col("h").alias(OWN_HASH)).agg(F.collect_set(F.concat_ws(":", "kind", "term")).alias(OWN))  # a document's own terms
    met = docs.join(own, F.xxhash64(F.col(text_col).cast("string")) == own[OWN_HASH], "left")
    return met.drop(OWN_HASH), spark.sparkContext.broadcast(None)


def _terms_of(shared, own) -> frozenset:
    if shared.value is not None:
        return shared.value
    return frozenset((int(k), t) for k, _, t in (x.partition(":") for x in (own if own is not None else ())))


@lru_cache(4)
def _anywhere(terms: frozenset) -> frozenset:
    return frozenset(t for k, t in terms if k == ANYWHERE)


def spans(text: str, terms: frozenset, window: int = WINDOW) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The entities, and all spans (kind 4 is a term)."""
    found = entities(text)
    if not terms:
        return found, found
    anywhere = _anywhere(terms)
    if not found and (not anywhere or anywhere.isdisjoint(said(text))):
        return found, found
    words = list(terms_in(text, found))
    extra = {(s, e, 4) for kind, close in around(found, words, window) for w, s, e in close if (kind, w) in terms}
    extra |= {(s, e, 4) for w, s, e in words if w in anywhere}
    return found, sorted({*found, *extra}, key=lambda x: (x[0], x[2]))


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{(*KINDS, 'term')[k]}:{s}:{e}" for s, e, k in found)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms and n_spans (the terms, and all spans)."""
    common.small_batches(docs.sparkSession)
    docs, shared = _with_terms(docs, revealing(docs, text_col) if terms is None else terms, text_col)
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_terms", pa.int64()), ("n_spans", pa.int64())])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.begin()
        for batch in batches:
            for part in common.slices(batch, "text"):
                rows = []
                for doc, text, own in zip(part.column("doc_id").to_pylist(), common.texts_of(part.column("text")), part.column("own").to_pylist(), strict=True):
                    base, every = spans(text, _terms_of(shared, own))
                    n = np.bincount([k for _, _, k in base], minlength=4).tolist() if base else [0] * 4
                    rows.append((doc, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(every) - len(base), len(every)))
                yield _rows(rows, schema)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(OWN).alias("own"))
    return narrow.mapInArrow(tell, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_terms long, n_spans long")


def mask(text: str, terms: frozenset) -> str:
    """Entities become [KIND], revealing words with digits [CODE]; other revealing words go. Overlapping entities become one."""
    _, every = spans(text, terms)
    out, at = [], 0
    for s, e, k in every:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]" if k < 4 else "[CODE]" if _DIGIT.search(text, s, e) else ""]
        at = max(at, e)
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with their texts sanitised; a null text stays null."""
    names = docs.columns
    docs, shared = _with_terms(docs, revealing(docs, text_col), text_col)

    @F.pandas_udf("string")
    def clean(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        common.begin()
        for texts, own in parts:
            yield pd.Series([None if t is None else mask(t, _terms_of(shared, o)) for t, o in zip(texts, own, strict=True)], dtype=object)

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string"), F.col(OWN))).select(*names)
