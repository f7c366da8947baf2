"""Periodic runs of words, found with the dictionary of basic factors.

A basic factor is a stretch of ``2^k`` words. All factors of one length get a name, so that
equal factors of a text have equal names; the names of the next length are pairs of names.
Where the next occurrence of a factor lies at most twice its length ahead, the occurrences
of a run form an arithmetic progression whose step is the period: in a run of period ``q``
every factor of the least power of two ``l >= q`` has its successor exactly ``q`` words
ahead (a nearer one would give the run a smaller period). So runs of period ``q`` are the
maximal stretches of neighbouring positions whose successors lie ``q`` ahead, for the one
length with ``l/2 < q <= l``. Proposals are extended word by word and listed once.

Only positions whose factor occurs again can start a longer factor that does, so the work
shrinks from length to length. Many texts are named together in one numpy pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from filingloom.llm.common import Rows, arrow_schema, raw_bytes, tidy

#: a run is at least this long, and holds its period at least this often
MIN_LENGTH, MIN_REPEATS = 6, 4
#: words named together; a longer text is named alone
TOGETHER = 250_000

RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


class _Numbers(dict):
    """Words to numbers, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def _named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stable order of the keys, dense names, and which sorted place equals the next."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    same = np.append(sorted_keys[1:] == sorted_keys[:-1], False) if len(keys) else np.zeros(0, bool)
    names = np.empty(len(keys), np.int64)
    if len(keys):
        names[order] = np.cumsum(np.append(0, ~same[:-1]))
    return order, names, same


def find_runs(
    words: np.ndarray, sizes: np.ndarray, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS
) -> np.ndarray:
    """Rows (place in ``words``, length, period) of all runs, ascending by place and period.

    ``words`` holds the numbers of the words of several texts one after the other, ``sizes``
    the words of each. A run lies in one text; it is a stretch of smallest period ``q`` of
    at least ``max(min_length, min_repeats * q)`` words that cannot be extended.
    """
    if min_repeats < 3:
        raise ValueError("runs are found from three repeats on")
    total = len(words)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    stop = np.repeat(np.cumsum(sizes), sizes)
    longest = int(sizes.max(initial=0))
    at = np.arange(total)
    keys = owner * (int(words.max(initial=0)) + 1) + words
    length, found = 1, []
    full = np.empty(total, np.int64)
    while len(at) and length <= 2 * (longest // min_repeats):
        order, names, same = _named(keys)
        gap = np.zeros(len(at), np.int64)
        gap[order[:-1]] = np.where(same[:-1], at[order[1:]] - at[order[:-1]], 0)
        near = np.flatnonzero((gap > length // 2) & (gap <= length))
        if len(near):
            place, period = at[near], gap[near]
            turn = np.flatnonzero((np.diff(place) != 1) | (np.diff(period) != 0)) + 1
            first, last = np.append(0, turn), np.append(turn, len(near)) - 1
            size = place[last] - place[first] + period[first] + length
            long_enough = size >= np.maximum(min_length, min_repeats * period[first])
            found.append(np.stack([place[first], size, period[first]], axis=1)[long_enough])
        again = np.zeros(len(at), bool)
        again[order] = same | np.append(False, same[:-1])
        at, names = at[again], names[again]
        full[:] = -1
        full[at] = names
        inside = at + 2 * length <= stop[at]
        at, names = at[inside], names[inside]
        partner = full[at + length]
        both = partner >= 0
        at = at[both]
        keys = names[both] * total + partner[both]
        length *= 2
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return np.unique(_extended(runs, words, stop, np.cumsum(sizes) - sizes, owner), axis=0)


def _extended(
    runs: np.ndarray, words: np.ndarray, stop: np.ndarray, begin: np.ndarray, owner: np.ndarray
) -> np.ndarray:
    """The stretches grown to both sides while the period holds."""
    start, end, period = runs[:, 0].copy(), runs[:, 0] + runs[:, 1], runs[:, 2]
    low, high = begin[owner[start]], stop[start]
    while True:
        left = np.flatnonzero(start > low)
        left = left[words[start[left] - 1] == words[start[left] - 1 + period[left]]]
        right = np.flatnonzero(end < high)
        right = right[words[end[right]] == words[end[right] - period[right]]]
        if not len(left) and not len(right):
            return np.stack([start, end - start, period], axis=1)
        start[left] -= 1
        end[right] += 1


def _runs(schema: pa.Schema, min_length: int, min_repeats: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        ids: list[int | None] = []
        texts: list[list[bytes]] = []
        held = 0

        def settle() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(t) for t in texts], np.int64)
            numbers = _Numbers()
            words = np.fromiter((numbers[w] for t in texts for w in t), np.int64, int(sizes.sum()))
            found = find_runs(words, sizes, min_length, min_repeats)
            edges = np.zeros(len(words) + 1, np.int64)
            np.add.at(edges, found[:, 0] + found[:, 2], 1)
            np.add.at(edges, found[:, 0] + found[:, 1], -1)
            kept = np.cumsum(edges[:-1]) == 0
            begin = np.cumsum(sizes) - sizes
            cuts = np.searchsorted(found[:, 0], np.append(begin, len(words)))
            for k, (key, own) in enumerate(zip(ids, texts)):
                mine = found[cuts[k] : cuts[k + 1]]
                runs = [
                    {"start": s - int(begin[k]), "length": n, "period": q} for s, n, q in mine.tolist()
                ]
                if runs:
                    own = [own[i] for i in np.flatnonzero(kept[begin[k] : begin[k] + sizes[k]]).tolist()]
                text = b" ".join(own)
                out.add(key, int(sizes[k]), runs, text.decode(), weight=len(text) + 100 * len(runs))
                if out.full():
                    yield from out.take()
            ids.clear(), texts.clear()

        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1))):
                words = raw.split()
                ids.append(key)
                texts.append(words)
                held += len(words)
                if held >= TOGETHER or len(ids) >= 20_000:
                    yield from settle()
                    held = 0
        yield from settle()
        yield from out.take()

    return run


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_repeats: int = MIN_REPEATS,
) -> DataFrame:
    """One row per input row: id, ``n_words``, ``runs``, ``collapsed``.

    ``runs`` lists every run (``start`` as a word number from 0, ``length``, ``period``) by
    start, then period; ``collapsed`` holds the words, joined by one space, that no run
    contains behind its first period. Words are separated by the six ASCII blanks. A null
    or empty text has no words, no runs and an empty ``collapsed``. Rows are judged one by
    one, so ids may be null or repeat; other columns are not read; an empty table gives an
    empty result. Nothing is shuffled.
    """
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(RUN)),
            T.StructField("collapsed", T.StringType()),
        ]
    )
    return docs.select(id_col, text_col).mapInArrow(_runs(arrow_schema(schema), min_length, min_repeats), schema)
