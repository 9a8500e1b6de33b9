"""Operators on arrays of spans as folds: ``[(s, e)]`` on one text, ``[(a0, a1, b0, b1)]`` on two."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import html_escape

SPAN, PAIR = "array<struct<s:int,e:int>>", "array<struct<a0:int,a1:int,b0:int,b1:int>>"


def spans_of(pairs: Column, side: str) -> Column:
    """One side ('a' or 'b') of span pairs."""
    return F.transform(pairs, lambda p: F.struct(p[f"{side}0"].alias("s"), p[f"{side}1"].alias("e")))


def _fold(items: Column, kind: str, near, joined) -> Column:
    """Goes through sorted items, joining one to the last kept where ``near`` holds."""

    def step(acc, x):
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) > 0) & near(F.when(F.size(acc) > 0, last), x), F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), joined(F.when(F.size(acc) > 0, last), x))).otherwise(F.array_append(acc, x))

    return F.aggregate(items, F.array().cast(kind), step)


def merged(spans: Column, gap: int = 5) -> Column:
    """Spans whose distance is ``gap`` or less become one."""
    return _fold(F.array_sort(spans.cast(SPAN)), SPAN, lambda last, x: x["s"] <= last["e"] + gap, lambda last, x: F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e")))


def merged_pairs(pairs: Column, gap: int = 10) -> Column:
    """Span pairs that are near on both texts become one."""
    near = lambda last, x: (x["a0"] <= last["a1"] + gap) & (x["b0"] <= last["b1"] + gap)
    return _fold(F.array_sort(pairs.cast(PAIR)), PAIR, near, lambda last, x: F.struct(last["a0"].alias("a0"), F.greatest(last["a1"], x["a1"]).alias("a1"), last["b0"].alias("b0"), F.greatest(last["b1"], x["b1"]).alias("b1")))


def overlap(x: Column, y: Column) -> Column:
    """The smaller of the two intersections over the mean of the two unions (the larger if one is empty)."""
    inter = lambda s: F.greatest(F.lit(0), F.least(x[s + "1"], y[s + "1"]) - F.greatest(x[s + "0"], y[s + "0"]))
    union = lambda s: (x[s + "1"] - x[s + "0"]) + (y[s + "1"] - y[s + "0"]) - inter(s)
    a, b = union("a"), union("b")
    of = F.when((a > 0) & (b > 0), (a + b) / 2).otherwise(F.greatest(a, b).cast("double"))
    return F.when(of == 0, F.lit(0.0)).otherwise(F.least(inter("a"), inter("b")) / of)


def suppressed(pairs: Column, limit: float = 0.6) -> Column:
    """Longest pairs first (earlier ones on ties); one that overlaps a kept one by ``limit`` or more goes."""
    size = lambda p: (p["a1"] - p["a0"]) + (p["b1"] - p["b0"])
    keyed = F.array_sort(F.transform(pairs.cast(PAIR), lambda p, i: F.struct((-size(p)).alias("n"), i.alias("i"), p.alias("p"))))
    return F.aggregate(F.transform(keyed, lambda k: k["p"]), F.array().cast(PAIR), lambda acc, x: F.when(F.forall(acc, lambda y: overlap(x, y) < limit), F.array_append(acc, x)).otherwise(acc))


def coverage(spans: Column, length: Column) -> Column:
    """Summed lengths (overlaps count twice) over the text's length, 1 at most; 0 without spans or text."""
    total = F.aggregate(spans, F.lit(0), lambda n, x: n + F.greatest(F.lit(0), x["e"] - x["s"]))
    return F.when((F.size(spans) > 0) & (length > 0), F.least(F.lit(1.0), total / length)).otherwise(F.lit(0.0))


def passes_rule(spans: Column, long: int = 24, short: int = 12, several: int = 2) -> Column:
    """A span of ``long`` characters, or ``several`` of ``short``."""
    size = lambda x: x["e"] - x["s"]
    return F.exists(spans, lambda x: size(x) >= long) | (F.size(F.filter(spans, lambda x: size(x) >= short)) >= several)


def snippets(text: Column, spans: Column, around: int = 40, merge: bool = True) -> Column:
    """Per merged span (or per span as given): what stands before, the hit, what follows, and the offsets."""
    cut = lambda s, e: F.substring(text, s + 1, F.greatest(F.lit(0), e - s))
    return F.transform(
        merged(spans) if merge else spans.cast(SPAN),
        lambda x: F.struct(
            cut(F.greatest(F.lit(0), x["s"] - around), x["s"]).alias("before"),
            cut(x["s"], x["e"]).alias("hit"),
            cut(x["e"], F.least(F.length(text), x["e"] + around)).alias("after"),
            F.array(x["s"], x["e"]).alias("offset"),
        ),
    )


def marked_by_level(text: Column, spans: Column, level: Column) -> Column:
    """The text as HTML with each span, in order of start and without merging (so that what two spans share stands twice), in a mark element
    of its level's class; an empty text is empty."""
    n = F.length(text)
    held = F.transform(F.array_sort(spans.cast(SPAN)), lambda x: F.struct(F.greatest(F.lit(0), x["s"]).alias("s"), F.least(n, x["e"]).alias("e")))
    piece = lambda s, e: html_escape(F.substring(text, s + 1, F.greatest(F.lit(0), e - s)))

    def step(acc, x):
        mark = F.concat(F.lit('<mark class="lvl-'), F.coalesce(level, F.lit("low")), F.lit('">'))
        return F.struct(F.concat(acc["out"], piece(acc["at"], x["s"]), mark, piece(x["s"], x["e"]), F.lit("</mark>")).alias("out"), x["e"].alias("at"))

    return F.aggregate(held, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], piece(acc["at"], n)))


def marked(text: Column, spans: Column) -> Column:
    """The text as HTML with its merged spans in mark elements; an empty text is empty."""
    n = F.length(text)
    held = F.transform(merged(spans), lambda x: F.struct(F.greatest(F.lit(0), F.least(n, x["s"])).alias("s"), F.greatest(F.lit(0), F.least(n, x["e"])).alias("e")))
    piece = lambda s, e: html_escape(F.substring(text, s + 1, F.greatest(F.lit(0), e - s)), quotes=True)

    def step(acc, x):
        return F.struct(F.concat(acc["out"], piece(acc["at"], x["s"]), F.lit("<mark>"), piece(x["s"], x["e"]), F.lit("</mark>")).alias("out"), x["e"].alias("at"))

    body = F.aggregate(held, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], piece(acc["at"], n)))
    return F.when(n > 0, F.concat(F.lit("<pre>"), body, F.lit("</pre>"))).otherwise(F.lit(""))
