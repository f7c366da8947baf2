"""Whole texts to token ids with a public tokenizer, inside Python workers.

The vocabulary's splitting pattern never lets a pre-token reach over a space that is
followed by a non-space: such a space always opens a new pre-token. A text may therefore
be cut before these spaces and the pieces be encoded one by one. A line break between two
non-spaces is a pre-token of its own, so texts are cut before it as well. Pieces repeat very
often, so their ids are kept in a bounded cache and only new pieces reach the tokenizer.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np

from filingloom.llm.common import worker_cache

END_ID = 0
DEFAULT_FILE = "byte_bpe_50k.json"
#: entries of a Python worker's caches: pieces behind a space, and all else; a full cache
#: takes no more, until so many lookups have missed it that the text must have changed,
#: and it starts afresh
PIECE_ENTRIES = 400_000
OTHER_ENTRIES = 50_000
STALE_MISSES = 4_000_000
MAX_KEPT_CHARS = 64

_PRE_TOKENS = re.compile(
    r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?[^\s\w]+|\s+(?!\S)|\s+"
).findall
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x7e¡-©«-±´¶-¸»¿-ȳ‐-‧]*").fullmatch
_ODD_SPACE = re.compile(r" (?:\s|\Z)").search
# a line break beside other white space or at the end, where no plain space is followed by one
_ODD_BREAK = re.compile(r"\n(?:\s|\Z|(?<=[^\S ]\n))").search
_MARKS = frozenset(",.;:!?")
_CUT = re.compile(r" (?=\S)").split


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


class _Cache(dict):
    """Ids, as little-endian unsigned 32-bit bytes, of the strings met so far."""

    misses, most = 0, OTHER_ENTRIES

    def keep(self, key: str, ids: bytes) -> bytes:
        if len(self) < self.most:
            self[key] = ids
            return ids
        self.misses += 1
        if self.misses >= STALE_MISSES:
            self.clear()
            self.misses = 0
        return ids


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Words(_Cache):
    """Pre-tokens of the pattern."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model, self.letters = tokenizer, tokenizer.model, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        return self.keep(word, self.merge(word))

    def merge(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


class _Pieces(_Cache):
    """What stands between two cuts: mostly one word, or one with a mark behind it."""

    def __init__(self, words: _Words, lead: str, opening: _Pieces | None = None, most: int | None = None):
        self.words, self.lead, self.opening = words, lead, opening
        if lead:
            self.most = most or PIECE_ENTRIES

    def __missing__(self, piece: str) -> bytes:
        if self.opening is not None and piece[0] == "\n":
            # cut before a line break: what is behind it opens a line and has no lead
            ids = self.words["\n"] + self.opening[piece[1:]]
            return self.keep(piece, ids) if len(piece) <= MAX_KEPT_CHARS else ids
        if piece.isalpha() and len(piece) < MAX_KEPT_CHARS:
            return self.keep(piece, self.words.merge(self.lead + piece))
        head, mark = piece[:-1], piece[-1:]
        if mark in _MARKS and head.isalpha() and len(head) < MAX_KEPT_CHARS:
            return self.keep(piece, self[head] + self.words[mark])
        whole = self.lead + piece
        if len(whole) > MAX_KEPT_CHARS or "_" in whole or not _PLAIN(whole):
            return self.words.encode(whole)
        return self.keep(piece, b"".join([self.words[w] for w in _PRE_TOKENS(whole)]))


def encoder(path: str, entries: int | None = None) -> Callable[[str | None], bytes]:
    """A function from a text to its ids and the end id, 4 bytes each, little-endian.

    A null text counts as empty. Texts holding a special token's string are encoded whole.
    ``entries`` are those of the cache of pieces, each of about 200 bytes.
    """
    kept = worker_cache("tokens")
    if (path, entries) in kept:
        return kept[path, entries]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    words = _Words(tokenizer)
    first = _Pieces(words, "")
    later = _Pieces(words, " ", first, entries)
    end = np.array([END_ID], "<u4").tobytes()

    def encode(text: str | None) -> bytes:
        if not text:
            return end
        if any(s in text for s in special):
            return words.encode(text) + end
        if _ODD_SPACE(text):
            pieces = _CUT(text)
        elif _ODD_BREAK(text):
            pieces = text.split(" ")
        else:
            pieces = text.replace("\n", " \n").split(" ")
        head = first[pieces[0]] if pieces[0] else b""
        return head + b"".join(map(later.__getitem__, pieces[1:])) + end

    kept[path, entries] = encode
    return encode
