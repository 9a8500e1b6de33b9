"""Token ids of whole texts by a public tokenizer file, with a memo of words.

The tokenizer of ``word_bpe_49k.json`` drops white space and never joins across it, so the ids of a text are the
ids of its white-space words one after another. Every id comes from the tokenizers library; the memo saves encoding
a word again. Texts with characters on which Python and the tokenizer disagree about white space go whole, and so does
every text if the file's stages aren't those (``WORD_WISE``) that this holds for.
"""

from __future__ import annotations

import json
import re
import string
import sys
import zlib
from array import array
from operator import itemgetter

import numpy as np

from . import common

#: Words of one generation of the memo: about 60 MB, so 120 MB for both.
MEMO_LIMIT = 300_000
_ODD = re.compile("[\x1c-\x1f]")
#: Letters that are composed already and that every library lower-cases alike.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-įĲ-ſ]+")


#: The stages of a file whose texts may be cut at white space: what normalises, what cuts, and how the model ends words. Fixed values of the format.
WORD_WISE = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "pattern": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
    "pre_tokenizer": [("Split", "Removed", True), ("ByteLevel", False, False)],
    "model": ("BPE", None, "</w>"),
}


def stages(described: dict) -> dict:
    """A tokenizer file's stages in the form of WORD_WISE."""
    listed = lambda x, key: x.get(key, [x]) if x else []
    cuts = listed(described["pre_tokenizer"], "pretokenizers")
    model = described["model"]
    return {
        "normalizer": [x["type"] for x in listed(described["normalizer"], "normalizers")],
        "pattern": next((x["pattern"].get("Regex") for x in cuts if x["type"] == "Split"), None),
        "pre_tokenizer": [(x["type"], x["behavior"], x["invert"]) if x["type"] == "Split" else (x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in cuts],
        "model": (model["type"], model.get("dropout"), model.get("end_of_word_suffix")),
    }


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The byte-level letters: printable bytes stand for themselves, the others for letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder(dict):
    """White-space word to its packed ids, little-endian unsigned 16-bit or, where the vocabulary needs them, 32-bit. At
    ``MEMO_LIMIT`` words the memo becomes the older generation and begins anew; a word of the older one is taken over when
    it is asked for, so that frequent words stay."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype("<u2" if self.code == "H" else "<u4")
        self.older: dict[str, bytes] = {}
        self.letters = _byte_letters()
        self.word_wise = stages(json.loads(self.tokenizer.to_str())) == WORD_WISE
        if self.word_wise:
            # A word of letters is one pre-token, so the model alone gives its ids; held to the whole tokenizer in tests.
            self.model, self.normal = self.tokenizer.model, self.tokenizer.normalizer.normalize_str

    def _packed(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _new(self, word: str) -> bytes:
        if word.isalpha():
            low = word.lower() if word.isascii() or _LATIN.fullmatch(word) else self.normal(word)
            if low != word and low.isalpha():
                return self[low]
            if low.isascii():
                return self._packed([t.id for t in self.model.tokenize(low)])
            if low.isalpha():
                return self._packed([t.id for t in self.model.tokenize(low.encode().decode("latin-1").translate(self.letters))])
        core = word.rstrip(string.punctuation)
        if core != word and core.isalpha() and (core.isascii() or _LATIN.fullmatch(core) or self.normal(core).isalpha()):  # letters, then one run of signs: two pre-tokens
            return self[core] + self[word[len(core) :]]
        return self._packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def clear(self) -> None:
        super().clear()
        self.older = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO_LIMIT:
            self.older = dict(self)
            super().clear()
        value = self.older.get(word)
        if value is None:
            value = self._new(word)
        self[word] = value
        return value

    def _of(self, words: list[str]) -> bytes:
        """The ids of some words one after another."""
        return b"".join(itemgetter(*words)(self) if 1 < len(words) <= 100_000 else map(self.__getitem__, words))

    def ids(self, texts: list[str]) -> list[bytes]:
        return [self._packed(self.tokenizer.encode(t, add_special_tokens=False).ids) if not self.word_wise or _ODD.search(t) else self._of(t.split()) for t in texts]


_held: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The encoder of this process for that tokenizer file."""
    path = path or default_path()
    if path not in _held:
        _held[path] = Encoder(path)
        common.MEMOS.append(_held[path])
    common.begin(_held[path])
    return _held[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
