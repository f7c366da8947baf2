"""Interleaved range asymmetric numeral coding of token ids, vectorised over lanes.

States are 64-bit, in [2^31, 2^63), and give out or take in 32-bit words. A block holds
``lanes * steps`` ids at most; id ``k`` belongs to lane ``k % lanes``. Every block can be
decoded alone, and from any of its checkpoints: the states of all lanes and the number of
words read, kept each ``checkpoint`` steps. Several blocks are coded side by side.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

SCALE_BITS = 16
LANES = 256
STEPS = 256
CHECKPOINT = 128
#: ids below are counted and looked up in plain arrays of that length, others by search
DENSE = 1 << 20
LOW = np.uint64(1 << 31)
_SHIFT = np.uint64(SCALE_BITS)
_MASK = np.uint64((1 << SCALE_BITS) - 1)
_WORD = np.uint64(32)
_LIMIT = np.uint64(63 - SCALE_BITS)


class Table:
    """A static frequency table: the symbols met, and shares that add up to 2^SCALE_BITS."""

    def __init__(self, symbols: np.ndarray, shares: np.ndarray):
        self.symbols, self.shares = symbols.astype("<u4"), shares.astype("<u4")
        self.freq = self.shares.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.shares)[:-1]]).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(symbols)), self.shares)
        self.dense: np.ndarray | None = None

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        if len(ids) and int(ids.max()) < DENSE:
            counts = np.bincount(ids)
            symbols = np.flatnonzero(counts)
            counts = counts[symbols]
        else:
            symbols, counts = np.unique(ids, return_counts=True)
        if len(symbols) > 1 << SCALE_BITS:
            raise ValueError("more symbols than the table has slots")
        spare = (1 << SCALE_BITS) - len(symbols)
        exact = counts * (spare / counts.sum())
        shares = 1 + exact.astype(np.int64)
        # what rounding down has left goes to the symbols that lost most by it
        left = (1 << SCALE_BITS) - int(shares.sum())
        shares[np.argsort(exact - np.floor(exact), kind="stable")[::-1][:left]] += 1
        return cls(symbols, shares)

    def places(self, ids: np.ndarray) -> np.ndarray:
        """The place of each id, all of which the table holds."""
        if not len(self.symbols) or int(self.symbols[-1]) >= DENSE:
            return np.searchsorted(self.symbols, ids)
        if self.dense is None:
            self.dense = np.zeros(int(self.symbols[-1]) + 1, np.int32)
            self.dense[self.symbols] = np.arange(len(self.symbols), dtype=np.int32)
        return self.dense[ids]


@dataclass
class Block:
    n: int
    words: np.ndarray
    #: one row per checkpoint, from the first step on
    states: np.ndarray
    #: words in front of each checkpoint
    positions: np.ndarray
    crc: int


def _shape(n: int, lanes: int) -> int:
    return -(-n // lanes)


def checksum(words: np.ndarray, states: np.ndarray, positions: np.ndarray) -> int:
    return zlib.crc32(positions.tobytes(), zlib.crc32(states.tobytes(), zlib.crc32(words.tobytes())))


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, steps: int = STEPS, checkpoint: int = CHECKPOINT) -> list[Block]:
    """The blocks of ``ids``; all but the last are full."""
    size = lanes * steps
    count = -(-len(ids) // size)
    index = table.places(ids)
    padded = np.zeros(count * size, np.int64)
    padded[: len(ids)] = index
    grid = padded.reshape(count, steps, lanes).transpose(1, 0, 2)
    x = np.full((count, lanes), LOW, np.uint64)
    words = np.zeros((steps, count, lanes), "<u4")
    given = np.zeros((steps, count, lanes), bool)
    marks = []
    for step in range(steps - 1, -1, -1):
        symbols = grid[step]
        f = table.freq[symbols]
        out = x >= (f << _LIMIT)
        given[step] = out
        words[step] = x  # the lower 32 bits
        x = np.where(out, x >> _WORD, x)
        q = x // f
        x = (q << _SHIFT) + (x - q * f) + table.start[symbols]
        if step % checkpoint == 0:
            marks.append(x)
    states = np.stack(marks[::-1], axis=1).astype("<u8")
    per_step = given.sum(axis=2)
    before = np.concatenate([np.zeros((1, count), np.int64), np.cumsum(per_step, axis=0)])[:-1:checkpoint]
    blocks = []
    for b in range(count):
        n = min(size, len(ids) - b * size)
        used = -(-_shape(n, lanes) // checkpoint)
        # a short last block keeps the words of its padding too; a few, and decoding is uniform
        stream = words[:, b, :][given[:, b, :]]
        positions = before[:used, b].astype("<u4")
        blocks.append(Block(n, stream, states[b, :used], positions, checksum(stream, states[b, :used], positions)))
    return blocks


def decode(blocks: list[Block], table: Table, lanes: int = LANES, checkpoint: int = CHECKPOINT, first: int = 0) -> list[np.ndarray]:
    """The ids of each block, from its checkpoint ``first`` on."""
    if not blocks:
        return []
    for block in blocks:
        if checksum(block.words, block.states, block.positions) != block.crc:
            raise ValueError("a block does not match its checksum")
    lengths = np.array([max(0, b.n - first * checkpoint * lanes) for b in blocks])
    live = [i for i, n in enumerate(lengths) if n]
    out = [np.zeros(0, "<u4") for _ in blocks]
    if not live:
        return out
    steps = _shape(int(lengths.max()), lanes)
    stream = np.concatenate([blocks[i].words for i in live] + [np.zeros(1, "<u4")]).astype(np.uint64)
    sizes = np.array([len(blocks[i].words) for i in live])
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]]) + [int(blocks[i].positions[first]) for i in live]
    end = np.cumsum(sizes)
    x = np.stack([blocks[i].states[first] for i in live]).astype(np.uint64)
    got = np.zeros((steps, len(live), lanes), "<u4")
    for step in range(steps):
        slot = x & _MASK
        symbols = table.slots[slot.astype(np.int64)]
        got[step] = table.symbols[symbols]
        x = table.freq[symbols] * (x >> _SHIFT) + slot - table.start[symbols]
        need = x < LOW
        rank = np.cumsum(need, axis=1)
        where = np.minimum(at[:, None] + rank - 1, end[:, None] - 1)
        x = np.where(need, (x << _WORD) | stream[np.maximum(where, 0)], x)
        at = at + rank[:, -1]
    for k, i in enumerate(live):
        out[i] = got[:, k, :].reshape(-1)[: lengths[i]]
    return out
