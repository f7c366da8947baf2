"""Document fingerprints as invertible Bloom lookup sketches, and what two versions differ in.

A text is a set of paragraph digests: its lines, long ones cut behind words that their own
hash picks, so that an edit changes the paragraphs it touches and no others. A paragraph
that occurs again counts with the number of its occurrence.

A sketch has three parts of cells; a digest is added to one cell of each part (xor of
digests, xor of their checks, count). The sketch of one version less that of another holds
only the digests in which they differ. Cells left with one digest give it away; taking it
out of its other cells uncovers further ones. If that peeling ends before the sketch is
empty, both versions are sketched again in four times the cells. The fingerprint of a text
is its sketch of the smallest size, with the number of its paragraphs and a hash of all.

Many pairs are peeled side by side in numpy.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingloom.llm.common import arrow_schema, raw_bytes, staged, tidy, worker_cache
from filingloom.llm.shingles import mixed

#: cells of one of the three parts of a fingerprint; a power of two
CELLS = 4
#: each larger sketch has so many times the cells
GROWTH = 4
#: a word ends a paragraph if these bits of its hash are zero, and if it is the last that fits
CUT_BITS = 3
MOST_WORDS = 8
#: longer words are cut; the pieces but the last are marked by a byte that no text holds
LONGEST_WORD = 64
_CUT_MARK = b"\xff"
#: bytes of text compared in one go, and cells of the pairs peeled side by side
TOGETHER = 2 << 20
CELLS_TOGETHER = 1 << 19
WORDS_KEPT = 150_000
#: characters of a range of documents
CHARS_PER_TASK = 16 << 20

_PARTS = 3
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SALTS = [np.uint64(s) for s in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)]
_CHECK = np.uint64(0x452821E638D01377)


class _Hashes(dict):
    """Hashes of words; the last bit tells whether a line ends with the word."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word) & ~1 | word.endswith(b"\n")
        if len(self) < WORDS_KEPT:
            self[word] = value
        return value


def _words(text: bytes) -> list[bytes]:
    """The text at its single spaces, a line break being the end of the word before it."""
    words = text.replace(b"\n", b"\n ").split(b" ") if text else []
    if max(map(len, words), default=0) <= LONGEST_WORD:
        return words
    out = []
    for w in words:
        out += [w[k : k + LONGEST_WORD] + _CUT_MARK for k in range(0, len(w) - LONGEST_WORD, LONGEST_WORD)]
        out.append(w[(len(w) - 1) // LONGEST_WORD * LONGEST_WORD :] if w else w)
    return out


def paragraphs(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct digests of the paragraphs of all texts, and how many each text has.

    Every byte counts: words are separated by single spaces, and a line break belongs to
    the word before it. An empty text has no paragraph.
    """
    words = [_words(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    hashes = worker_cache("reconcile").setdefault("words", _Hashes())
    hashed = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, total)
    ends = (hashed & np.uint64(1) == 1) | ((hashed >> np.uint64(20)) & np.uint64(CUT_BITS) == 0)
    ends[np.cumsum(sizes)[sizes > 0] - 1] = True
    begin = np.append(0, np.flatnonzero(ends)[:-1] + 1)
    since = np.arange(total) - begin[np.cumsum(np.append(0, ends[:-1]))]
    ends |= since % MOST_WORDS == MOST_WORDS - 1
    begin = np.append(0, np.flatnonzero(ends)[:-1] + 1)
    piece = np.cumsum(np.append(0, ends[:-1]))
    place = (np.arange(total) - begin[piece]).astype(np.uint64)
    digests = mixed(np.add.reduceat(mixed(hashed + (place + np.uint64(1)) * _STEP), begin))
    owner = np.repeat(np.arange(len(texts)), sizes)[begin]
    # the second occurrence of a digest in a text is another element than the first
    order = np.lexsort((digests, owner))
    same = np.append(False, (digests[order][1:] == digests[order][:-1]) & (owner[order][1:] == owner[order][:-1]))
    rank = np.arange(len(order))
    nth = rank - np.maximum.accumulate(np.where(same, 0, rank))
    out = np.empty(len(order), np.uint64)
    out[order] = np.where(same, mixed(digests[order] + nth.astype(np.uint64) * _STEP), digests[order])
    return out, np.bincount(owner, minlength=len(texts))


def _cells(digests: np.ndarray, size: int) -> list[np.ndarray]:
    """The cell of each digest in each part of ``size`` cells."""
    return [
        (part * size + (mixed(digests ^ salt) & np.uint64(size - 1)).astype(np.int64))
        for part, salt in enumerate(_SALTS)
    ]


def _check(digests: np.ndarray) -> np.ndarray:
    return mixed(digests ^ _CHECK) & np.uint64(0xFFFFFFFF)


class Sketches:
    """Sketches of one size, one in each row."""

    def __init__(self, rows: int, size: int):
        self.size = size
        self.digest = np.zeros((rows, _PARTS * size), np.uint64)
        self.check = np.zeros((rows, _PARTS * size), np.uint64)
        self.count = np.zeros((rows, _PARTS * size), np.int64)

    def add(self, row: np.ndarray, digests: np.ndarray, sign: np.ndarray | int = 1) -> None:
        check = _check(digests)
        for cell in _cells(digests, self.size):
            np.bitwise_xor.at(self.digest, (row, cell), digests)
            np.bitwise_xor.at(self.check, (row, cell), check)
            np.add.at(self.count, (row, cell), sign)

    def less(self, mine: np.ndarray, other: np.ndarray) -> "Sketches":
        """Row ``mine[k]`` less row ``other[k]``."""
        out = Sketches(0, self.size)
        out.digest = self.digest[mine] ^ self.digest[other]
        out.check = self.check[mine] ^ self.check[other]
        out.count = self.count[mine] - self.count[other]
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which rows came out empty, and the digests found: row, digest, sign."""
        live = np.arange(len(self.digest))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(live):
            touched = []
            # a digest has one cell in a part, so a part never gives it away twice
            for part in range(_PARTS):
                cells = slice(part * self.size, (part + 1) * self.size)
                at, cell = np.nonzero(np.abs(self.count[live, cells]) == 1)
                row, cell = live[at], cell + cells.start
                digest = self.digest[row, cell]
                alone = self.check[row, cell] == _check(digest)
                row, digest, sign = row[alone], digest[alone], self.count[row, cell][alone]
                if len(row):
                    self.add(row, digest, -sign)
                    found.append((row, digest, sign))
                    touched.append(row)
            if not touched:
                break
            live = np.unique(np.concatenate(touched))
        empty = ~(self.digest.any(axis=1) | self.check.any(axis=1) | self.count.any(axis=1))
        if not found:
            return empty, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return empty, *(np.concatenate(c) for c in zip(*found))


class Versions:
    """The paragraphs of several texts."""

    def __init__(self, texts: Sequence[bytes]):
        self.texts = texts
        self.digests, self.sizes = paragraphs(texts)
        self.stop = np.cumsum(self.sizes)

    def sketches(self, which: np.ndarray, size: int) -> Sketches:
        out = Sketches(len(which), size)
        sizes = self.sizes[which]
        row = np.repeat(np.arange(len(which)), sizes)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out.add(row, self.digests[np.repeat(self.stop[which] - sizes, sizes) + inside])
        return out

    def fingerprints(self, cells: int = CELLS) -> list[str]:
        all_of = self.sketches(np.arange(len(self.texts)), cells)
        digest, check = all_of.digest.astype("<u8"), all_of.check.astype("<u4")
        count = (all_of.count & 0xFFFF).astype("<u2")
        return [
            base64.b64encode(
                struct.pack("<IQ", n, xxhash.xxh3_64_intdigest(t)) + d.tobytes() + c.tobytes() + k.tobytes()
            ).decode()
            for n, t, d, c, k in zip(self.sizes.tolist(), self.texts, digest, check, count)
        ]

    def differences(self, mine: np.ndarray, other: np.ndarray, cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Per pair: digests only in the first, digests only in the second, cells it took."""
        none = np.zeros(0, np.uint64)
        out: list = [(none, none, _PARTS * cells)] * len(mine)
        left = np.flatnonzero(mine != other)
        size = cells
        while len(left):
            again = []
            step = max(1, CELLS_TOGETHER // (_PARTS * size))
            for low in range(0, len(left), step):
                part = left[low : low + step]
                which, place = np.unique(np.concatenate([mine[part], other[part]]), return_inverse=True)
                sketches = self.sketches(which, size)
                empty, row, digest, sign = sketches.less(place[: len(part)], place[len(part) :]).peel()
                order = np.argsort(row, kind="stable")
                row, digest, sign = row[order], digest[order], sign[order]
                cuts = np.searchsorted(row, np.arange(len(part) + 1))
                for k, pair in enumerate(part.tolist()):
                    if empty[k]:
                        own, signs = digest[cuts[k] : cuts[k + 1]], sign[cuts[k] : cuts[k + 1]]
                        out[pair] = (own[signs > 0], own[signs < 0], _PARTS * size)
                again.append(part[~empty])
            left = np.concatenate(again)
            size *= GROWTH
        return out

    def likeness(self, mine: int, other: int, removed: int, added: int) -> float:
        """Paragraphs in both over paragraphs in either; two texts without any are alike."""
        either = int(self.sizes[mine]) + added
        return 1.0 if not either else (int(self.sizes[mine]) - removed) / either


def difference_type(digests: bool) -> T.StructType:
    fields = [
        T.StructField("likeness", T.DoubleType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_added", T.LongType()),
        T.StructField("cells", T.LongType()),
    ]
    if digests:
        fields += [T.StructField(n, T.ArrayType(T.LongType())) for n in ("removed", "added")]
    return T.StructType(fields)


def _slices(columns: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    low, held = 0, 0
    for k, row in enumerate(zip(*columns)):
        held += sum(map(len, row))
        if held >= TOGETHER:
            yield low, k + 1
            low, held = k + 1, 0
    if low < len(columns[0]):
        yield low, len(columns[0])


def _versions(schema: pa.Schema, kept: int, others: int, cells: int, digests: bool):
    kind = schema.field(kept + 2).type

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [raw_bytes(c) for c in batch.columns[kept:]]
            for low, high in _slices(columns):
                place: dict[bytes, int] = {}
                own = [np.array([place.setdefault(t, len(place)) for t in c[low:high]], np.int64) for c in columns]
                versions = Versions(list(place))
                prints = versions.fingerprints(cells)
                arrays = [batch.column(k).slice(low, high - low) for k in range(kept)]
                arrays.append(pa.array([prints[i] for i in own[0].tolist()], pa.string()))
                for other in own[1:]:
                    rows = []
                    for i, j, (gone, new, used) in zip(own[0].tolist(), other.tolist(), versions.differences(own[0], other, cells)):
                        row = {
                            "likeness": versions.likeness(i, j, len(gone), len(new)),
                            "n_removed": len(gone),
                            "n_added": len(new),
                            "cells": used,
                        }
                        if digests:
                            row["removed"] = np.sort(gone.view(np.int64)).tolist()
                            row["added"] = np.sort(new.view(np.int64)).tolist()
                        rows.append(row)
                    arrays.append(pa.array([prints[i] for i in other.tolist()], pa.string()))
                    arrays.append(pa.array(rows, kind))
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def compare_versions(
    rows: DataFrame,
    keep: Sequence[str],
    text_col: str,
    other_cols: Sequence[str],
    cells: int = CELLS,
    digests: bool = True,
) -> DataFrame:
    """The ``keep`` columns, ``fingerprint``, and for each other version its fingerprint and difference.

    Those are called ``{column}_fingerprint`` and ``{column}_difference``: ``likeness`` (0
    to 1, paragraphs shared over paragraphs of either), ``n_removed`` and ``n_added``, the
    ``cells`` of the sketch that could be peeled, and unless ``digests`` is false the
    differing digests themselves, ``removed`` (only in ``text_col``) and ``added``. A null
    text is an empty one. Rows are judged one by one: they may repeat and hold nulls; an
    empty table gives an empty result. Of columns of one name the last counts, so ``keep``
    should not hold the names above.
    """
    if cells < 1 or cells & (cells - 1):
        raise ValueError("the cells of a part must be a power of two")
    fields = [rows.schema[c] for c in keep] + [T.StructField("fingerprint", T.StringType())]
    for c in other_cols:
        fields.append(T.StructField(f"{c}_fingerprint", T.StringType()))
        fields.append(T.StructField(f"{c}_difference", difference_type(digests)))
    schema = T.StructType(fields)
    if not other_cols:
        raise ValueError("there is no other version to compare with")
    return rows.select(*keep, text_col, *other_cols).mapInArrow(
        _versions(arrow_schema(schema), len(keep), len(other_cols), cells, digests), schema
    )


# --- documents and the ones that follow them

_PAIRS = "part int, edge string, id long, text string, next_text string"


def _pairs():
    """Sorted rows (id, text) with the text that follows; the ends of a part are marked."""
    schema = arrow_schema(_PAIRS)

    def table(part: int, edge: str | None, ids: pa.Array, texts: pa.Array, after: pa.Array) -> pa.RecordBatch:
        n = len(ids)
        columns = [pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.string()), ids, texts, after]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.string())
            if not len(ids):
                continue
            if last is None:
                yield table(part, "first", ids.slice(0, 1), texts.slice(0, 1), texts.slice(0, 1))
            else:
                yield table(part, None, *last, texts.slice(0, 1))
            n = len(ids) - 1
            if n:
                yield table(part, None, ids.slice(0, n), texts.slice(0, n), texts.slice(1))
            # a copy, so that the batch itself can go
            last = pa.concat_arrays([ids.slice(n)]), pa.array([texts[n].as_py()], pa.string())
        if last is not None:
            yield table(part, "last", *last, pa.nulls(1, pa.string()))

    return run


def with_following(
    docs: DataFrame,
    work: Callable[[DataFrame], DataFrame],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """What ``work`` makes of rows (``id``, ``text``, ``next_text``), the text of the following id.

    The first row follows the last. Ids are whole numbers, null ids come first; rows that
    repeat an id are ordered by the hash of their text. Null texts come as empty ones.
    ``work`` must keep the columns ``part``, ``edge``, ``edge_text`` and ``id`` and give one
    row for each; the first three are gone in the result. An empty table gives what ``work``
    makes of none.

    Texts are dealt out by range once. Only where a range ends does the following text lie
    elsewhere; these rows, one of each range, are put together in a second step.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    tie = F.xxhash64("text")
    order = [F.col("id").asc_nulls_first(), tie]
    ordered = rows.repartitionByRange(max(1, -(-chars // CHARS_PER_TASK)), *order).sortWithinPartitions(*order)
    pairs = ordered.mapInArrow(_pairs(), _PAIRS)
    kept = F.when(F.col("edge").isNotNull(), F.col("text"))
    done = staged(work(pairs.withColumn("edge_text", kept)), "followed")
    edges = done.where("edge IS NOT NULL").select("part", "edge", "id", "edge_text")
    parts = sorted(r["part"] for r in edges.where("edge = 'first'").select("part").collect())
    after = list(zip(parts, parts[1:] + parts[:1]))
    then = docs.sparkSession.createDataFrame(after, "part int, after int")
    firsts = edges.where("edge = 'first'").select(F.col("part").alias("after"), F.col("edge_text").alias("next_text"))
    last = edges.where("edge = 'last'").drop("edge").withColumnRenamed("edge_text", "text")
    last = last.join(then, "part").join(firsts, "after").drop("after")
    last = last.withColumns({"edge": F.lit(None).cast("string"), "edge_text": F.lit(None).cast("string")})
    ended = work(last.select("part", "edge", "id", "text", "next_text", "edge_text"))
    return done.where("edge IS NULL").unionByName(ended).drop("part", "edge", "edge_text")
