"""Token ids of whole texts inside Spark tasks, by a public tokenizer file."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: A single space between two non-blank characters: byte-level pre-tokens never reach across it,
#: as a space only stands first in a pre-token or within a run of blanks.
_GAP = re.compile(r"(?<=\S) (?=\S)")
#: One run of Latin letters and then ASCII marks: two pre-tokens at most.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\[-`{-~]*)")
_AS_IS = "\0"
#: The commonest marks after a letter and before a space: a pre-token of their own, so a word is kept once, not once
#: with each of them. Each pattern starts with plain characters, which are found fast.
_APART = [(re.compile(rf"{re.escape(m)} (?<=[A-Za-zÀ-ÖØ-öø-ɏ]{re.escape(m)} )").sub, f" {_AS_IS}{m} ") for m in (".", ",")]
#: Distinct words whose ids a task keeps at a time.
KEPT_WORDS = 1_000_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Blanks(Exception):
    """Blanks meet a space at a word, so its text must be cut at `_GAP` instead."""


class _Words(dict):
    """Ids of words; those it lacks are learned."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, key: str) -> bytes:
        return self.learn(key)


class Encoder:
    """Ids of texts; each distinct space-separated word goes through the tokenizer once.

    Only for byte-level BPE without added prefix space, where cutting at `_GAP` changes nothing.
    Strings of special tokens in a text are ordinary text. Ids are packed as `dtype`.
    """

    def __init__(self, path: str, kept_words: int = KEPT_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenize = self.tokenizer.model.tokenize
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.code, self.dtype = ("H", np.dtype("<u2")) if self.vocabulary <= 1 << 16 else ("I", np.dtype("<u4"))
        self.letters = str.maketrans(_byte_letters())
        self.space = self.letters[32]
        self.kept_words = kept_words
        self.packs = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.vocabulary)]
        self.known = _Words(self._learn)  # ids of a word after a space, or of `_AS_IS` and a stretch as it stands
        self.older: dict[str, bytes] = {}  # what was known before; words met again move up
        self.newline = self._pre_token("\n")

    def _pre_token(self, text: str) -> bytes:
        # the stand-ins of visible ASCII are the characters themselves
        shown = text.replace(" ", self.space) if text.isascii() and text != "\n" else text.encode().decode("latin-1").translate(self.letters)
        packs = self.packs
        return b"".join([packs[t.id] for t in self.tokenize(shown)])

    def _learn(self, key: str) -> bytes:
        # while a text is packed, `known` may have become `older`
        if (ids := self.known.get(key)) is None and (ids := self.older.get(key)) is None:
            ids = self._ids(key)
        if len(self.known) >= self.kept_words // 2:
            self.older, self.known = self.known, _Words(self._learn)
        self.known[key] = ids
        return ids

    def _ids(self, key: str) -> bytes:
        if key.isascii() and key.isalpha():
            packs = self.packs
            return b"".join([packs[t.id] for t in self.tokenize(self.space + key)])
        as_is = key[:1] == _AS_IS
        if m := _PLAIN.fullmatch(key, as_is):
            bare = (self.known.get(m[1]) or self.older.get(m[1])) if m[2] and not as_is else None
            return (self._pre_token(m[1] if as_is else " " + m[1]) if bare is None else bare) + (self._marks(m[2]) if m[2] else b"")
        if not key or not as_is and (key[0].isspace() or key[-1].isspace()):
            raise _Blanks
        whole = key[1:] if as_is else " " + key
        return array(self.code, self.tokenizer.encode(whole, add_special_tokens=False).ids).tobytes()

    def _marks(self, marks: str) -> bytes:
        return found if (found := self.known.get(key := _AS_IS + marks)) is not None else self.known.setdefault(key, self._pre_token(marks))

    def _packed(self, keys: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, keys))

    def encode(self, text: str) -> bytes:
        """The ids, packed one after another."""
        if not text:
            return b""
        if _AS_IS not in text and (ids := self._by_lines(text)) is not None:
            return ids
        first, *rest = _GAP.split(text)
        return self._packed([_AS_IS + first, *(f"{_AS_IS} {w}" for w in rest)])

    def _by_lines(self, text: str) -> bytes | None:
        """The ids of a text whose lines and words are divided by single newlines and spaces; None: it isn't."""
        for apart, marked in _APART:
            text = apart(marked, text)
        lines = []
        for line in text.split("\n"):  # a newline between non-blanks is a pre-token of its own
            if not line or line[0].isspace() or line[-1].isspace():
                return None
            keys = line.split(" ")
            keys[0] = _AS_IS + keys[0]
            try:
                lines.append(self._packed(keys))
            except _Blanks:
                return None
        return self.newline.join(lines)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
