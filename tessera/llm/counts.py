"""Operator 6, token counts by dynamic programming over a trie.

Distinct pre-tokens (white-space words with the word mark in front) go into a trie. Each node holds the forward values of its
prefix: the best unigram score and the number of pieces of that segmentation. They follow from the nodes above it, so a shared
prefix is computed once; a pre-token's count is read at its last node. Equal scores go to fewer pieces. The unigram model is
the piece list of a public tokenizer, a piece's log probability -log(rank + 2); a character that is no piece costs one
piece per UTF-8 byte at a score below all others. The trie lives in the worker and is emptied at ``NODE_LIMIT`` nodes.

Nulls and empties: a null or blank text has no pre-tokens and no tokens; null identifiers are kept; repeated rows give a
row each; an empty table gives no rows; other columns aren't read. Very long texts are read whole, and very long words are nodes like others. Ties between
segmentations go to fewer pieces."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
NODE_LIMIT, MEMO_LIMIT = 700_000, 400_000
SPECIAL = ("<unk>", "<s>", "</s>")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def model_pieces(path: str | None = None) -> list[str]:
    """The pieces in order of rank, without special and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or default_path())
    return [p for k in range(sp.get_piece_size()) if not sp.is_byte(k) and (p := sp.id_to_piece(k)) not in SPECIAL]


class Trie:
    """Forward values of prefixes."""

    def __init__(self, pieces: list[str]):
        # Pieces by their characters from the last one on; a node is (children, log probability or None).
        self.back: tuple[dict, list] = ({}, [None])
        for rank, piece in enumerate(pieces):
            node = self.back
            for c in reversed(piece):
                node = node[0].setdefault(c, ({}, [None]))
            if node[1][0] is None:
                node[1][0] = -math.log(rank + 2)
        self.single = {p for p in pieces if len(p) == 1}
        self.other = -math.log(len(pieces) + 2) - 10
        self.memo: dict[str, int] = {}
        self._empty()

    def clear(self) -> None:
        self.memo.clear()
        self._empty()

    def _empty(self) -> None:
        self.next: dict[tuple[int, str], int] = {}
        self.parent, self.char, self.score, self.count = [0], [""], [0.0], [0]

    def _grow(self, node: int, c: str) -> int:
        """The node below ``node`` by c, with the forward values of its prefix."""
        parent, char, score, count = self.parent, self.char, self.score, self.count
        best, pieces = (-math.inf, 0) if c in self.single else (score[node] + self.other, count[node] + len(c.encode("utf-8", "surrogatepass")))
        suffix, start, letter = self.back, node, c
        while (suffix := suffix[0].get(letter)) is not None:
            if (own := suffix[1][0]) is not None:
                value, n = score[start] + own, count[start] + 1
                if value > best or value == best and n < pieces:
                    best, pieces = value, n
            if not start:
                break
            letter, start = char[start], parent[start]
        new = self.next[node, c] = len(parent)
        parent.append(node)
        char.append(c)
        score.append(best)
        count.append(pieces)
        return new

    def pieces_of(self, word: str) -> int:
        """The number of pieces of a pre-token (without the mark)."""
        if (n := self.memo.get(word)) is not None:
            return n
        if len(self.parent) > NODE_LIMIT:
            self._empty()
        if len(self.memo) >= MEMO_LIMIT:
            self.memo.clear()
        node, below = 0, self.next
        for c in MARK + word:
            nxt = below.get((node, c))
            node = self._grow(node, c) if nxt is None else nxt
        n = self.memo[word] = self.count[node]
        return n


_held: dict[str | None, Trie] = {}


def trie(path: str | None = None) -> Trie:
    """The trie of this process."""
    if path not in _held:
        _held[path] = Trie(model_pieces(path))
        common.MEMOS.append(_held[path])
    common.begin(_held[path])
    return _held[path]


def count(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_distinct, n_tokens."""
    common.small_batches(docs.sparkSession)
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_pretokens", "n_distinct", "n_tokens")])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = trie(model)
        for batch in batches:
            for part in common.slices(batch, "text"):
                split = [t.split() for t in common.texts_of(part.column("text"))]
                # Sorted, distinct pre-tokens follow the trie's paths.
                known = {w: tree.pieces_of(w) for w in sorted({w for words in split for w in words})}
                rows = [(len(words), len(set(words)), sum(map(known.__getitem__, words))) for words in split]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tally, "doc_id long, n_pretokens long, n_distinct long, n_tokens long")
