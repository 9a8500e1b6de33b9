"""Operator 10, benchmark decontamination by template canonicalisation.

Words of documents and items are canonicalised: words with a leading digit become <number>, capitalised words <name> (those that open a sentence too,
unless they are ``OPENERS``), words of measure <unit>; all others are lower-cased. A number with separators ('1,200', '3.5') is one word here,
and so is a name of several words. Every ``width`` consecutive canonical words of an
item are a template window (an item of fewer words is one window). Windows with fewer than half literal words don't count, unless the item has no others.
An item of fewer than four times ``width`` words has windows of a quarter of its words too (``NARROW`` at least), judged apart.
Documents' windows are hash-joined to the items' windows; windows of one document and item whose alignments
(document position less item position) lie within ``DRIFT`` words or a quarter of the item's of each other, as words were inserted or deleted
between them, are one occurrence, kept if its different windows are ``min_coverage`` of the item's; narrower windows must also cover ``width`` words of
the item, or all of a shorter one. Then the slots are checked, each on the alignment of the nearest window found: equal slot values of the item must
stand against equal values in the document and different against different, kind by kind; a slot in a gap between two alignments stands against nothing.
An occurrence whose values are the item's own is a verbatim one, else a re-parameterised one. ``windows`` and ``coverage`` are of the width that found it.

Items none of whose windows has half literal words (arithmetic, lists of names) are searched for in two ways: by all their template windows with a literal
word, of which ``LOW_COVERAGE`` must be found, and verbatim. Items of fewer than ``MIN_WORDS`` words are searched for verbatim alone, as they are no template. Verbatim
windows are of lower-cased words as they stand (runs of letters and digits), ``width`` of them or a shorter item's all, and start_word then counts those.

The items' windows go to the tasks in blocks of ``BLOCK_WINDOWS`` at most, so what is broadcast has a fixed bound and
any number of items is searched for, in several passes over the documents.

Nulls and empties: null texts are empty; an empty document or item, or one without words, has no occurrence. Null identifiers are kept as null. Repeated
documents and items give rows each. An empty table gives no rows. Very long texts are read whole. Columns other than identifier and text aren't read. Ties go
to the wider windows, then to the smaller alignment, then to template windows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH, MIN_COVERAGE, MIN_WORDS = 8, 0.3, 5
NARROW, DRIFT = 4, 8
LOW_COVERAGE = 0.8
BLOCK_WINDOWS = 1_000_000
#: Names that no column of a table has.
OWN, OWN_HASH = "__tessera_leak__", "__tessera_leak_hash__"
#: Words of measure, fixed values.
UNITS = frozenset("mm cm m km g kg mg t l ml s ms min h hz khz mhz ghz w kw mw v a n pa kpa j kj b kb mb gb tb percent inch inches foot feet yard yards mile miles ounce ounces pound pounds gram grams kilogram kilograms meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters litre litres liter liters second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents degree degrees".split())
#: Stands before a word that is taken for a name; a letter, so that it is part of the word.
_MARK = "ⵯ"
#: Words that open sentences and are no names, in English, German, French and Spanish; fixed values.
OPENERS = (
    "A An And Are As At But By Can Compute Do Does Each Every Find Each For From Given Has Have He How If In Into Is It Its Let No Not Of On Or She Solve Some That The Their Then There These They This Those To Was We Were What When Where Which While Who Why With You Your "
    "Aber Als Am An Auf Aus Bei Das Dem Den Der Des Die Dies Diese Dieser Dieses Ein Eine Einen Einer Er Es Für Ich Ihr Im In Ist Jede Jeder Kein Man Mit Nach Nicht Oder Sie Sind Um Und Von Vor Wann Warum Was Wenn Wer Wie Wir Wo Zu Zum Zur "
    "Au Aux Avec Ce Ces Cette Comment Dans De Des Du Elle En Est Et Il Ils Je La Le Les Leur Mais Nous On Ou Par Pas Pour Quand Que Quel Quelle Qui Sans Si Son Sur Un Une Vous "
    "Al Como Con Cuando Del Desde Donde El Ella En Ellos Entre Es Esta Este Esto La Las Lo Los Más No Para Pero Por Porque Que Quien Se Si Sin Sobre Son Su Sus Un Una Y Yo"
).split()


def _openers() -> str:
    """A pattern for the rest of an opener, after its first letter."""
    by: dict[str, list[str]] = defaultdict(list)
    for w in sorted(set(OPENERS)):
        by[w[0]].append(w[1:])
    return "|".join(rf"(?<={k})(?:{'|'.join(rest)})\b" for k, rest in sorted(by.items()))


#: The first letter of a capitalised word: inside a sentence, or where one may begin if it isn't an opener.
_NAME = re.compile(rf"[A-ZÀ-ÖØ-Þ](?:(?<=[\w,;:’'] .)|(?<!\w.)(?!{_openers()}))(?=\w)")
_DIGIT = re.compile(r"\d")
#: A name of one or more words, a number with its separators, or a word.
_TOKEN = re.compile(rf"{_MARK}\w+(?:(?: {_MARK}|-)\w+)*|\d\w*(?:[.,:/'’\u00a0\u202f-]\d\w*)*|\w+")
NUMBER, NAME, UNIT = np.uint64(11), np.uint64(13), np.uint64(17)
_SLOTS = np.array([NUMBER, NAME, UNIT])


class _Canon(dict):
    """Word to the hash of its canonical form."""

    def __missing__(self, word: str) -> int:
        if len(self) >= common.MEMO_LIMIT:
            self.clear()
        if word[0] == _MARK:
            h = int(NAME)
        elif _DIGIT.match(word):
            h = int(NUMBER)
        elif (low := word.lower()) in UNITS:
            h = int(UNIT)
        else:
            h = xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass"))
        self[word] = h
        return h


_CANON = _Canon()
common.MEMOS.append(_CANON)


def canonical(text: str) -> tuple[list[str], np.ndarray]:
    """The words (names marked) and the hashes of their canonical forms."""
    words = _TOKEN.findall(_NAME.sub(_MARK + r"\g<0>", text))
    return words, np.fromiter(map(_CANON.__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows, and which of them have enough literal words."""
    if not len(h):
        return np.empty(0, np.uint64), np.empty(0, bool)
    width = min(width, len(h))
    slots = np.concatenate([[0], np.cumsum(np.isin(h, _SLOTS))])
    return common.rolling(h, width), (slots[width:] - slots[:-width]) * 2 <= width


def widths(n: int, width: int) -> list[int]:
    """The widths of the windows of an item of ``n`` words."""
    return sorted({min(width, n), min(width, n, max(NARROW, n // 4))}, reverse=True)


def verbatim(text: str) -> np.ndarray:
    """Hashes of the words as they stand, lower-cased."""
    return common.word_hashes(common.WORD.findall(text.lower()))


@dataclass(frozen=True)
class Owner:
    """What windows belong to: the windows of one width of an item. exact: they are verbatim ones. least: the share of them that must be found."""

    item: int
    width: int
    windows: int
    exact: bool
    least: float


class Index:
    """Windows of some items, sorted by hash, with a bit table in front. Each width of an item has its windows, as an owner of its own."""

    BITS = 22

    def __init__(self, items: list[tuple[int, str]], width: int, min_coverage: float = MIN_COVERAGE):
        self.width, self.items = width, []
        hashes, owners, places = [], [], []
        self.owned: list[Owner] = []

        def own(w: np.ndarray, at: np.ndarray, size: int, exact: bool, least: float) -> None:
            hashes.append(w[at])
            owners.append(np.full(len(at), len(self.owned)))
            places.append(at)
            self.owned.append(Owner(len(self.items), size, len(at), exact, least))

        for item_id, text in items:
            words, h = canonical(text)
            plain = verbatim(text)
            if not len(h):
                continue
            some = False
            for size in widths(len(h), width) if len(plain) >= MIN_WORDS else ():
                w, literal = windows(h, size)
                at = np.flatnonzero(literal)
                # Narrower windows that cover too little of the item would miss even its verbatim copies.
                if len(at) and (size >= min(width, len(h)) or len(np.unique(at[:, None] + np.arange(size))) >= min(width, len(h))):
                    own(w, at, size, False, min_coverage)
                    some = True
            if not some:
                size = min(width, len(h))
                w, _ = windows(h, size)
                slots = np.concatenate([[0], np.cumsum(np.isin(h, _SLOTS))])
                low = np.flatnonzero(slots[size:] - slots[:-size] < size)
                if len(low) and len(plain) >= MIN_WORDS:
                    own(w, low, size, False, max(min_coverage, LOW_COVERAGE))
                w = common.rolling(plain, min(width, len(plain)))
                own(w, np.arange(len(w)), min(width, len(plain)), True, min_coverage)
            self.items.append((item_id, words, h))
        self.sizes = {False: {x.width for x in self.owned if not x.exact}, True: {x.width for x in self.owned if x.exact}}
        self.hashes, self.owners, self.places = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (hashes, owners, places))
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.owners, self.places = self.hashes[order], self.owners[order].astype(np.int64), self.places[order].astype(np.int64)
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[self.hashes >> np.uint64(64 - self.BITS)] = True

    def hits(self, w: np.ndarray) -> np.ndarray:
        """Positions whose hash is an item window's."""
        maybe = np.flatnonzero(self.table[w >> np.uint64(64 - self.BITS)])
        k = np.searchsorted(self.hashes, w[maybe])
        k[k == len(self.hashes)] = 0
        return maybe[self.hashes[k] == w[maybe]] if len(self.hashes) else maybe[:0]


def consistent(doc_words: list[str], doc_h: np.ndarray, item_words: list[str], item_h: np.ndarray, found: dict[int, int], size: int) -> tuple[bool, int, int]:
    """Of an occurrence (the alignment of each window found): whether its slots are consistent, how many it has, how many differ."""
    to: dict[tuple, str] = {}
    back: dict[tuple, str] = {}
    slots = differ = 0
    places = np.array(sorted(found))
    for k in np.flatnonzero(np.isin(item_h, _SLOTS)).tolist():
        i = int(np.searchsorted(places, k, side="right"))
        before, after = (int(places[i - 1]) if i else None), (int(places[i]) if i < len(places) else None)
        if before is None or (after is not None and k >= before + size and found[before] != found[after]):
            if before is not None:
                continue
            before = after
        d = found[before] + k
        if not 0 <= d < len(doc_h) or doc_h[d] != item_h[k]:
            continue
        slots += 1
        a, b = item_words[k].lower(), doc_words[d].lower()
        differ += a != b
        kind = int(item_h[k])
        if kind == int(UNIT):  # a unit may be changed in one place and not in another
            continue
        if to.setdefault((kind, a), b) != b or back.setdefault((kind, b), a) != a:
            return False, slots, differ
    return True, slots, differ


def occurrences(by: dict[int, set[int]], least: float, reach: int) -> Iterator[dict[int, int]]:
    """by: the windows found on each alignment. The alignments that have ``least`` windows or more, alone or with those up to
    ``reach`` words after them, each as the alignment of each of its windows."""
    for at, places in by.items():
        if len(places) >= least:
            yield dict.fromkeys(places, at)
    ats = sorted(by)
    held: Counter = Counter()
    end = 0
    for start, low in enumerate(ats):
        grown = end
        while end < len(ats) and ats[end] <= low + reach:
            held.update(by[ats[end]])
            end += 1
        if end > grown and end - start > 1 and len(held) >= least:
            out: dict[int, int] = {}
            for at in sorted(ats[start:end], key=lambda x: (-len(by[x]), x)):
                for p in by[at]:
                    out.setdefault(p, at)
            yield out
        for p in by[low]:
            held[p] -= 1
            if not held[p]:
                del held[p]


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("windows", pa.int64()), ("coverage", pa.float64()), ("slots", pa.int64()), ("changed_slots", pa.int64()), ("h", pa.int64())])
SCHEMA = "doc_id long, item_id long, start_word long, windows long, coverage double, slots long, changed_slots long, h long"


def search(doc_ids: list, texts: list[str], index: Index) -> list[tuple]:
    """The best occurrence of each item in each document."""
    split, parts = [], []
    for text in texts:
        words, h = canonical(text)
        split.append(words)
        parts.append(h)
    votes: dict[tuple[int, int], dict[int, dict[int, set[int]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
    for exact in (False, True):
        if not index.sizes[exact]:
            continue
        held = [verbatim(t) for t in texts] if exact else parts
        ends = np.cumsum([len(p) for p in held])
        flat = np.concatenate(held) if held else np.empty(0, np.uint64)
        for size in sorted(index.sizes[exact]):
            w = common.rolling(flat, size)
            for p in index.hits(w).tolist():
                d = int(np.searchsorted(ends, p, side="right"))
                if p + size > ends[d]:
                    continue
                at = p - (int(ends[d - 1]) if d else 0)
                for k in range(np.searchsorted(index.hashes, w[p]), np.searchsorted(index.hashes, w[p], side="right")):
                    own, place = index.owned[index.owners[k]], int(index.places[k])
                    if own.width == size and own.exact == exact:
                        votes[d, own.item][int(index.owners[k])][at - place].add(place)
    rows = []
    for (d, item), by_owner in sorted(votes.items()):
        item_id, words, h = index.items[item]
        options = []
        for owner, by in by_owner.items():
            own = index.owned[owner]
            for found in occurrences(by, own.least * own.windows, max(DRIFT, len(h) // 4)):
                covered = own.exact or own.width >= index.width or len({p + k for p in found for k in range(own.width)}) >= min(index.width, len(h))
                if covered:
                    options.append((-len(found) / own.windows, -own.width, found[min(found)], own.exact, sorted(found.items()), own.windows))
        for _, size, at, exact, found, total in sorted(options):
            good, slots, differ = (True, 0, 0) if exact else consistent(split[d], parts[d], words, h, dict(found), -size)
            if good:
                rows.append((doc_ids[d], item_id, at, len(found), len(found) / total, slots, differ))
                break
    return rows


def item_blocks(benchmark: DataFrame, width: int, min_coverage: float, id_col: str, text_col: str) -> Iterator[Index]:
    """Indexes of at most BLOCK_WINDOWS windows each (more only for a single longer item)."""
    held: list[tuple[int, str]] = []
    count = 0
    for r in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        text = r[1] or ""
        n = len(common.WORD.findall(text)) * 2  # two widths at most
        if held and count + n > BLOCK_WINDOWS:
            yield Index(held, width, min_coverage)
            held, count = [], 0
        held.append((r[0], text))
        count += n
    yield Index(held, width, min_coverage)


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row per document and item that it holds."""
    return _found(docs, benchmark, width, min_coverage, id_col, text_col, item_id_col, item_text_col).drop("h")


def _found(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """As ``find``, with h, the hash of the document's text."""
    common.small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("h"))
    found = None
    for index in item_blocks(benchmark, width, min_coverage, item_id_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by BLOCK_WINDOWS

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            common.begin(_CANON, common.HASHES)
            for batch in batches:
                for part in common.slices(batch, "text"):
                    rows = search(list(zip(part.column("doc_id").to_pylist(), part.column("h").to_pylist(), strict=True)), common.texts_of(part.column("text")), shared.value)
                    rows = [(doc_id, *rest, h) for (doc_id, h), *rest in rows]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

        own = narrow.mapInArrow(match, SCHEMA)
        found = own if found is None else found.unionByName(own)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that hold no item, all columns. A document is known by identifier and hash of its text, as identifiers may be null or repeat."""
    hit = common.written(_found(docs, benchmark, **how).select(F.col("doc_id").alias(OWN), F.col("h").alias(OWN_HASH)).distinct(), "leaks")
    same = docs[how.get("id_col", "doc_id")].cast("long").eqNullSafe(hit[OWN]) & (F.xxhash64(docs[how.get("text_col", "text")].cast("string")) == hit[OWN_HASH])
    return docs.join(hit, same, "left_anti")
