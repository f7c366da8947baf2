"""Word shingles of whole texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from filingloom.llm.common import BLANKS, LOWER

_FACTORS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64
)
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANKS)] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: a factor for each place in a word; the first ones are kept
_PLACES = 1 << 12


def _factors(places: np.ndarray) -> np.ndarray:
    return mixed((places.astype(np.uint64) + np.uint64(1)) * _FACTORS[0]) | np.uint64(1)


_KEPT_FACTORS = _factors(np.arange(_PLACES))


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word, A-Z lower-cased, words split at ASCII blanks.

    The sum over its bytes, each times a factor of its place, is spread over all bits; words
    that differ in one byte never agree, others do by chance of 64 bits.
    """
    data = np.frombuffer(raw.translate(LOWER), np.uint8)
    blank = _IS_BLANK[data]
    inside = np.flatnonzero(~blank)
    if not len(inside):
        return np.zeros(0, np.uint64)
    begins = np.append(True, np.diff(inside) != 1)
    starts = np.flatnonzero(begins)
    place = inside - np.repeat(inside[starts], np.diff(np.append(starts, len(inside))))
    longest = int(place.max())
    factors = _KEPT_FACTORS[place] if longest < _PLACES else _factors(place)
    return mixed(np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * factors, starts))


def shingles(raw: bytes, size: int = 5) -> np.ndarray:
    """The set of ``size``-word shingles of a text, A-Z lower-cased, words split at ASCII blanks.

    With fewer words the whole sequence is the one shingle; without words the set is empty.
    """
    hashed = word_hashes(raw)
    if not len(hashed):
        return hashed
    width = min(size, len(hashed))
    n = len(hashed) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total += hashed[k : k + n] * _FACTORS[k % len(_FACTORS)] + np.uint64(k // len(_FACTORS))
        if k >= len(_FACTORS):
            total = mixed(total)
    return np.unique(mixed(total))
