"""Worked cases of the operators, and properties over random strings."""

from __future__ import annotations

import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scores, spans, text
from tessera.functions.align import common_blocks, tiles
from tessera.operators import segment

ALPHABET = ["a", "B", "đ", "ệ", " ", "​", "﻿", "٣", "😀", "\n", " ", "1", ".", "é"]


def strings(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 12))) for _ in range(n)]


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_align_form_keeps_length(spark):
    assert one(spark, text.align_form(F.lit("A​B 12")))[0] == "a b 00"
    rows = spark.createDataFrame([(s,) for s in strings(200)], "t string").select("t", text.align_form(F.col("t")).alias("a")).collect()
    for t, a in rows:
        assert a == re.sub(r"\d", "0", re.sub("[​‌‍⁠﻿]", " ", t).lower())


def test_whitespace_and_ngrams(spark):
    got = spark.createDataFrame([(s,) for s in strings(300)], "t string").select("t", text.normalize_whitespace(F.col("t")).alias("w"), text.char_ngrams(F.col("t"), 3).alias("g")).collect()
    for t, w, g in got:
        assert w == " ".join(t.split())
        assert g == [t[i : i + 3] for i in range(len(t) - 2)]


def test_retrieval_view():
    how = text.Retrieval(abbreviations={"sv": "sinh viên"}, stop_phrases=("trong",))
    assert how("SV  trong lớp") == "sinh viên lớp"
    assert text.WordMap({"sv": "sinh viên"})("đsv svđ sv") == "đsv svđ sinh viên"
    chained = text.Retrieval(abbreviations={"ab": "CD"}, synonyms={"cd": "x"})
    assert chained("ab") == "x"
    assert text.fold_accents("Đường phố") == "Duong pho"


def test_phrases_plain_maps_and_escapes(spark):
    r = one(spark, text.remove_phrases(F.lit("xaby ab"), ["ab", "a"]), text.remove_phrases(F.lit("ab"), ["ab"], True), text.expand_plain(F.lit("a b"), {"a": "b", "b": "c"}), text.html_escape(F.lit("<&>\"'"), True))
    assert list(r) == ["x y  ", "  ", "c c", "&lt;&amp;&gt;&quot;&#x27;"]


def test_linearized_with_cells(spark):
    df = spark.createDataFrame([(["p", "qq"], [[["a", ""], ["b"]]])], "p array<string>, t array<array<array<string>>>")
    t, cells = df.select(text.linearized(F.col("p"), F.col("t")), text.cell_offsets(F.col("p"), F.col("t"))).first()
    assert t == "p\nqq\na\n\nb"
    assert [(c["text"], c["row"], c["col"], c["start"], c["end"]) for c in cells] == [("a", 0, 0, 5, 7), ("", 0, 1, 7, 8), ("b", 1, 0, 8, 10)]


def test_blocks(spark):
    df = spark.createDataFrame([(1, "x\ny\nPhụ lục\nz"), (2, ""), (3, " \n\na\r\n b"), (4, None)], "doc_id long, text string")
    got = {}
    for r in segment.blocks(df, ["Phụ lục"]).orderBy("doc_id", "block_no").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.start, r.end, r.is_heading))
    assert got[1] == [("x\ny\n", 0, 4, False), ("Phụ lục", 4, 11, True), ("z", 12, 13, False)]
    assert 2 not in got and 4 not in got
    for t in strings(80, 9):
        assert [(b, s, h) for b, s, h in segment.text_blocks(t)] == [(b, s, False) for b, s, _ in [(x, t.index(x), 0) for x, _, _ in segment.text_blocks(t)]]


def test_chunk_windows():
    assert segment.windows([100, 100, 200], 260, 50) == [(0, 2), (1, 2), (2, 3)]
    assert segment.windows([300, 10], 260, 50) == [(0, 1), (1, 2)]
    r = random.Random(1)
    for _ in range(300):
        sizes = [r.randint(0, 40) for _ in range(r.randint(0, 12))]
        got = segment.windows(sizes, 60, 20)
        assert sorted({k for i, j in got for k in range(i, j)}) == list(range(len(sizes)))
        assert all(sum(sizes[i:j]) <= 60 or sum(map(bool, sizes[i:j])) == 1 for i, j in got)


def test_sentences_with_offsets(spark):
    t = " Ab c. D!? \n e"
    s, parts = one(spark, segment.sentences_with_offsets(F.lit(t)), segment.locate_all(F.lit("aXbX"), F.array(F.lit("X"), F.lit("q"), F.lit("X"))))
    assert [(x["text"], t[x["start"] : x["end"]]) for x in s] == [(x, x) for x in ("Ab c.", "D!?", "e")]
    assert [(x["start"], x["end"]) for x in parts] == [(1, 2), (2, 3), (3, 4)]


def test_scores(spark):
    r = one(
        spark,
        scores.bm25_norm(F.lit(10.0)),
        scores.bm25_norm(F.lit(-3.0)),
        scores.fuse(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(20.0)),
        scores.citation_penalty(F.lit(2), F.lit(1)),
        scores.penalised(F.lit(1.0), F.lit(0.5), F.lit(0.0), F.lit(0.0)),
        scores.jaccard(text.char_ngrams(F.lit("abcdef"), 5), text.char_ngrams(F.lit("abcdeg"), 5)),
        scores.jaccard(text.char_ngrams(F.lit("abc"), 5), text.char_ngrams(F.lit("abc"), 5)),
        scores.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))),
        scores.minmax(F.lit(3), F.lit(3), F.lit(3)),
    )
    assert [round(x, 6) for x in r] == [0.632121, 0.0, 0.443233, 0.5, 0.75, round(1 / 3, 6), 0.0, round(1 / 2**0.5, 6), 0.0]
    levels = spark.createDataFrame([(x,) for x in (0.82, 0.8199, 0.72, 0.60, 0.5999)], "s double").select(scores.level(F.col("s"))).collect()
    assert [x[0] for x in levels] == ["very_high", "high", "high", "medium", "low"]
    assert scores.fallback_bounds({"thresholds": {"high": 0.84}})[0] == ("very_high", 0.84)


def _arr(rows, names):
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])


def test_spans(spark):
    ab = ("a0", "a1", "b0", "b1")
    nms = [(0, 100, 0, 100), (10, 100, 10, 100), (200, 230, 200, 230)]
    r = one(
        spark,
        spans.suppressed(_arr(nms, ab), 0.6),
        spans.merged(_arr([(0, 10), (15, 20), (26, 30)], "se")),
        spans.merged_pairs(_arr([(0, 30, 0, 30), (40, 70, 41, 71)], ab)),
        spans.merged_pairs(_arr([(0, 30, 0, 30), (40, 70, 40, 70)], ab)),
        *[spans.passes_rule(_arr(x, "se")) for x in ([(0, 12), (20, 32)], [(0, 23)], [(0, 24)])],
        spans.coverage(_arr([(0, 10), (5, 15)], "se"), F.lit(40)),
        spans.marked(F.lit("a<b>c"), _arr([(1, 4)], "se")),
        spans.snippets(F.lit("abcdef"), _arr([(2, 4)], "se"), 1),
    )
    assert [tuple(x) for x in r[0]] == [nms[0], nms[2]]
    assert [tuple(x) for x in r[1]] == [(0, 20), (26, 30)]
    assert [tuple(x) for x in r[2]] == [(0, 30, 0, 30), (40, 70, 41, 71)]
    assert [tuple(x) for x in r[3]] == [(0, 70, 0, 70)]
    assert list(r[4:7]) == [True, False, True]
    assert r[7] == 0.5
    assert r[8] == "<pre>a<mark>&lt;b&gt;</mark>c</pre>"
    assert tuple(r[9][0]) == ("b", "cd", "e", [2, 4])


def _lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


def test_common_blocks_are_a_longest_subsequence():
    r = random.Random(5)
    for _ in range(400):
        a, b = ("".join(r.choice("abc😀") for _ in range(r.randint(0, 14))) for _ in range(2))
        got = common_blocks(a, b)
        assert sum(n for _, _, n in got) == _lcs(a, b)
        assert all(a[p : p + n] == b[q : q + n] for p, q, n in got)
        assert all(x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1] for x, y in zip(got, got[1:]))


def test_tiles_of_nulls(spark):
    df = spark.createDataFrame([(None, "x"), ("", "x"), ("a" * 30, "b" + "a" * 30)], "a string, b string")
    assert [[tuple(p) for p in r[0]] for r in df.select(tiles(F.col("a"), F.col("b"))).collect()] == [[], [], [(0, 30, 1, 31)]]


def test_marks_by_level_and_plain_snippets(spark):
    df = spark.createDataFrame([("ab<cd>ef", [(4, 20), (0, 3), (2, 5)], "high"), ("", [], None), ("x", [], None)], "t string, s array<struct<s:int,e:int>>, l string")
    got = df.select(spans.marked_by_level(F.col("t"), F.col("s"), F.col("l")).alias("m"), spans.snippets(F.col("t"), F.col("s"), 1, merge=False).alias("n")).collect()
    assert got[0].m == '<mark class="lvl-high">ab&lt;</mark><mark class="lvl-high">&lt;cd</mark><mark class="lvl-high">d&gt;ef</mark>' and got[1].m == "" and got[2].m == "x"
    assert [(x.before, x.hit, x.after) for x in got[0].n] == [("c", "d>ef", ""), ("", "ab<", "c"), ("b", "<cd", ">")]


def test_models_are_loaded_once_per_worker(spark):
    from tessera.functions import models

    one = models.PerWorker("once", models.HashedGrams, 16)
    got = spark.createDataFrame([("a b",), ("c",), (None,)], "t string").select(models.embed(F.col("t"), one).alias("e")).collect()
    assert [len(r.e) for r in got] == [16, 16, 16] and not models._LOADED
    assert one.encode(["a b"]).shape == (1, 16) and one._model() is models.PerWorker("again", models.HashedGrams, 16)._model()
    models._LOADED.clear()
