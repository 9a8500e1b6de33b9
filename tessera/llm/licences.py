"""Operator 3, licence scan over a positional index of rare tokens; DataFrame functions only.

Licence notices are templates of words. For each file the method

1. takes the file's words that are in the index and, of each template, the ``RARE`` words with the highest inverse
   document frequency over the corpus that is scanned (the index holds a posting per place of such a word),
2. intersects the postings by relative position: a word at p that is the template's word t votes for the start p - t,
3. keeps starts that all rare words that can be there vote for in full, and verifies the template's mandatory key phrase,
   word by word, at its own place; the notice's share of words that agree is its score.

The base phrases are templates as well, with the whole phrase as their key phrase, so each place where a phrase stands is found.

Nulls and empties: a null text is empty: no words, no labels, null first_word and last_word, score 0. Null identifiers are kept. Repeated rows
give a row each. An empty table gives no rows. Columns other than identifier and text aren't read. Very long texts count whole. Ties: of words
with one document frequency the first in order is the rarer; labels are sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The contract's phrases and labels, fixed values.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices of public licences: (label, words, key phrase).
NOTICES = (
    ("mit-notice", "released under the mit license", "mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("cc-by", "this work is licensed under a creative commons attribution license", "creative commons attribution"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("zlib", "this software is provided as is without any express or implied warranty", "without any express or implied warranty"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution share alike license", "creative commons attribution share alike"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial license", "creative commons attribution noncommercial"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("boost-1.0", "distributed under the boost software license version 1 0", "boost software license version 1 0"),
    ("artistic-2.0", "this program is distributed under the terms of the artistic license 2 0", "artistic license 2 0"),
    ("wtfpl", "do what the fuck you want to public license", "what the fuck you want to public license"),
    ("proprietary", "all rights reserved unauthorized copying of this file via any medium is strictly prohibited", "unauthorized copying of this file"),
)
#: A notice is found if this share of its words stands at its places.
AGREE = 0.7
RARE = 2
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text: A-Z lower-cased, then the runs of what isn't between words."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), lambda w: w != "")


def templates() -> list[dict]:
    """Number, label, words, key phrase and its place, and whether it is a base phrase."""
    rows = [{"label": label, "words": phrase.split(), "key": phrase.split(), "base": True} for phrase, label in BASE.items()]
    rows += [{"label": label, "words": words.split(), "key": key.split(), "base": False} for label, words, key in NOTICES]
    for n, t in enumerate(rows):
        t["n"] = n
        t["at"] = next(k for k in range(len(t["words"])) if t["words"][k : k + len(t["key"])] == t["key"])
    return rows


def _rows(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of literals, without a Python source behind it."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [x.split()[1] for x in schema.split(", ")]
    one = F.array(*[F.struct(*[F.lit(v).cast(k).alias(c) for v, k, c in zip(r, kinds, names, strict=True)]) for r in rows])
    return spark.range(1).select(F.explode(one).alias("r")).select("r.*")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    known = templates()
    vocabulary = sorted({w for t in known for w in t["key"]})
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Inverse document frequencies of the key phrases' words over all files: a row a word.
    held = narrow.select(F.explode(F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, vocabulary)))).alias("w"))
    frequency = {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}  # as many as the vocabulary
    order = lambda w: (frequency.get(w, 0), w)
    # The index: places of each template's rarest key words. A word that repeats in a key phrase has a posting each.
    rare = {t["n"]: sorted(set(t["key"]), key=order)[:RARE] for t in known}
    postings: dict[str, list[tuple[int, int]]] = {}
    for t in known:
        for k, w in enumerate(t["key"]):
            if w in rare[t["n"]]:
                postings.setdefault(w, []).append((t["n"], t["at"] + k))
    needed = {t["n"]: sum(w in rare[t["n"]] for w in t["key"]) for t in known}

    words = words_of(F.col("text"))
    split = narrow.select("doc_id", words.alias("words"))
    # Postings of the file: (template, start) of each of its index words; then starts with all votes.
    index = F.map_from_arrays(F.array(*map(F.lit, postings)), F.array(*[F.array(*[F.struct(F.lit(n).alias("t"), F.lit(p).alias("p")) for n, p in ps]) for ps in postings.values()]))
    placed = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(*postings))
    votes = F.flatten(F.transform(placed, lambda x: F.transform(F.element_at(index, x["w"]), lambda y: y["t"].cast("long") * (1 << 40) + x["i"] - y["p"] + (1 << 20))))
    split = split.withColumn("votes", F.array_sort(votes))
    # In a sorted array a start with n votes is n equal neighbours.
    def full(x, i):
        t = F.shiftright(x, 40)
        want = F.element_at(F.array(*[F.lit(needed[k["n"]]) for k in known]), (t + 1).cast("int"))
        return (F.element_at("votes", F.least(i + want, F.size("votes")).cast("int")) == x) & (i + want <= F.size("votes"))

    starts = F.array_distinct(F.filter("votes", full))
    split = split.withColumn("starts", F.transform(starts, lambda x: F.struct(F.shiftright(x, 40).cast("int").alias("t"), (x.bitwiseAND((1 << 40) - 1) - (1 << 20)).cast("int").alias("s"))))
    keys = F.array(*[F.array(*map(F.lit, t["key"])) for t in known])
    places = F.array(*[F.lit(t["at"]) for t in known])
    every = F.array(*[F.array(*map(F.lit, t["words"])) for t in known])

    def verified(x):
        t = x["t"] + 1
        key, at = F.element_at(keys, t), x["s"] + F.element_at(places, t)
        return (at >= 0) & (F.when(at >= 0, F.slice("words", F.greatest(at, F.lit(0)) + 1, F.size(key))) == key)

    split = split.withColumn("found", F.filter("starts", verified))

    def agreeing(x):
        own = F.element_at(every, x["t"] + 1)
        same = F.size(F.filter(F.transform(own, lambda w, k: F.get("words", F.when(x["s"] + k >= 0, x["s"] + k)) == w), lambda y: F.coalesce(y, F.lit(False))))
        return F.struct(x["t"].alias("t"), x["s"].alias("s"), (same / F.size(own)).alias("share"))

    split = split.withColumn("found", F.transform("found", agreeing))
    labels = F.array(*[F.lit(t["label"]) for t in known])
    n_base = len(BASE)
    base = F.filter("found", lambda x: x["t"] < n_base)
    notices = F.filter("found", lambda x: (x["t"] >= n_base) & (x["share"] >= AGREE))
    named = lambda xs: F.transform(xs, lambda x: F.element_at(labels, x["t"] + 1))
    joined = lambda xs: F.concat_ws(",", F.array_sort(F.array_distinct(xs)))
    best = F.coalesce(F.array_max(F.transform(F.filter("found", lambda x: x["t"] >= n_base), lambda x: x["share"])), F.lit(0.0))
    return split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["s"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["s"])).cast("long").alias("last_word"),
        joined(named(base)).alias("base_labels"),
        joined(F.concat(named(base), named(notices))).alias("labels"),
        F.greatest(best, F.when(F.size(base) > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"),
    )
