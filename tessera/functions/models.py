"""Model plug-ins: an embedder of texts and a scorer of pairs, with deterministic stand-ins that need no model file.

Anything with ``encode(list of texts) -> rows of length 1`` or ``score(list of pairs) -> numbers from 0 to 1`` can take their
place. It is pickled to the tasks; a model that is large, or can't be pickled, goes as ``PerWorker``, which loads it in each worker once."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+")


class Embedder(Protocol):
    name: str

    def encode(self, texts: list[str]) -> np.ndarray: ...


class PairScorer(Protocol):
    name: str

    def score(self, pairs: list[tuple[str, str]]) -> np.ndarray: ...


_LOADED: dict[tuple, Any] = {}


class PerWorker:
    """A plug-in that ``factory(*args)`` builds on first use, once per process; only the factory (a function of a module) and its arguments are pickled."""

    def __init__(self, name: str, factory: Callable, *args):
        self.name, self.factory, self.args = name, factory, args

    def _model(self):
        key = (self.factory.__module__, self.factory.__qualname__, *self.args)
        if key not in _LOADED:
            _LOADED[key] = self.factory(*self.args)
        return _LOADED[key]

    def encode(self, texts: list[str]) -> np.ndarray:
        return self._model().encode(texts)

    def score(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        return self._model().score(pairs)


class HashedGrams:
    """Signed hashed words and character trigrams of a text, scaled to length 1; zero for a blank text."""

    def __init__(self, dim: int = 256):
        self.dim, self.name = dim, f"hashed-grams-{dim}"

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for r, t in enumerate(texts):
            low = t.lower()
            words = _WORD.findall(low)
            parts = words + [f"#{w[i : i + 3]}" for w in (f"^{w}$" for w in words) for i in range(len(w) - 2)]
            for p in parts:
                h = xxhash.xxh3_64_intdigest(p.encode())
                out[r, (h >> 1) % self.dim] += 1 if h & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(norm, 1e-9)


class WordOverlap:
    """Share of common words, as a stand-in for a neural pair scorer."""

    name = "word-overlap"

    def score(self, pairs: list[tuple[str, str]]) -> np.ndarray:
        out = []
        for a, b in pairs:
            x, y = set(_WORD.findall(a.lower())), set(_WORD.findall(b.lower()))
            out.append(2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0)
        return np.array(out)


def embed(text: Column, model: Embedder) -> Column:
    @F.pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(list(model.encode([t or "" for t in s])), dtype=object)

    return encode(text)


def pair_score(a: Column, b: Column, model: PairScorer) -> Column:
    """Filter first, then score, then join back: inside a condition every row would be scored."""

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series(np.asarray(model.score([(p or "", q or "") for p, q in zip(x, y, strict=True)]), float))

    return score(a, b)


def sentence_pairs(a: Column, b: Column, model: Embedder, least: float = 0.78, most: int = 3) -> Column:
    """Best matching sentences of two texts: of each sentence of a the most similar one of b (the first of equals), kept at ``least`` or
    more, the ``most`` best by falling similarity (earlier ones first)."""
    from ..operators.segment import split_sentences
    from .spans import PAIR

    @F.pandas_udf(PAIR)
    def best(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in parts:
            out = []
            for x, y in zip(xs, ys, strict=True):
                p, q = split_sentences(x or ""), split_sentences(y or "")
                if not p or not q:
                    out.append([])
                    continue
                sim = model.encode([" ".join(s.lower().split()) for s, _, _ in p]) @ model.encode([" ".join(s.lower().split()) for s, _, _ in q]).T
                top = sim.argmax(axis=1)
                found = sorted(((-float(sim[i, j]), i, int(j)) for i, j in enumerate(top) if sim[i, j] >= least))[:most]
                out.append([{"a0": p[i][1], "a1": p[i][2], "b0": q[j][1], "b1": q[j][2]} for _, i, j in found])
            yield pd.Series(out, dtype=object)

    return best(a, b)
