"""Best-fit packing of token pieces after Martello-Toth dominance reduction.

Only the number of pieces of each length matters for the plan, so the driver sees one
count per length, at most ``capacity`` of them, whatever the size of the corpus. The plan
is a short list of runs: pieces number a..b of one length go to sequences s, s+1, ... at
one offset. Pieces are then numbered within their length and looked up in the runs.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingloom.llm.common import Rows, arrow_schema, staged, tidy
from filingloom.llm.tokens import default_path, encoder

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids binary"


@dataclass
class Bins:
    """``count`` equal sequences: the lengths in them and the room left."""

    count: int
    room: int
    lengths: list[int] = field(default_factory=list)


def dominant_set(counts: dict[int, int], lengths: list[int], capacity: int, top: int | None = None) -> tuple[int, ...] | None:
    """A set with the length ``top`` (default: the largest) that some optimal packing is sure to contain.

    ``lengths`` are those with pieces left, ascending. A set dominates another when its
    pieces can take the place of the other's, piece by piece or one for several:

    * a partner that fills the sequence exactly takes the place of any other company;
    * if two further pieces never fit, the largest single partner does;
    * if three never fit, the largest single partner ``a`` does when no fitting pair is
      longer together; and ``a`` with the largest ``b`` beside it does when ``b`` is at
      least as long as the shorter piece of any fitting pair.
    """
    top = lengths[-1] if top is None else top
    room = capacity - top

    def left(length: int, *taken: int) -> int:
        return counts[length] - taken.count(length) - (length == top)

    def largest(limit: int, *taken: int) -> int | None:
        for i in range(bisect.bisect_right(lengths, limit) - 1, -1, -1):
            if left(lengths[i], *taken) > 0:
                return lengths[i]
        return None

    single = largest(room)
    if single is None:
        return (top,)
    if single == room:
        return (top, single)
    smallest: list[int] = []
    for length in lengths:
        smallest += [length] * min(3 - len(smallest), left(length))
        if len(smallest) == 3:
            break
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return (top, single)
    if len(smallest) == 3 and sum(smallest) <= room:
        return None
    # at most two further pieces fit
    longest_pair, best_short = 0, 0
    for short in lengths[: bisect.bisect_right(lengths, room // 2)]:
        if left(short) <= 0:
            continue
        long = largest(room - short, short)
        if long is not None and long >= short:
            longest_pair, best_short = max(longest_pair, short + long), max(best_short, short)
    if single >= longest_pair:
        return (top, single)
    beside = largest(room - single, single)
    if beside is not None and beside >= best_short:
        return (top, single, beside)
    return None


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Bins], dict[int, int]]:
    """Sequences fixed for good, and the counts of what remains.

    Lengths are tried from the longest down, again and again until none has a sure set.
    """
    counts = {k: n for k, n in counts.items() if n}
    lengths = sorted(counts)
    fixed: list[Bins] = []
    tops, before = list(lengths), 0
    while lengths:
        if not tops:
            if len(fixed) == before:
                break
            tops, before = list(lengths), len(fixed)
        top = tops[-1]
        found = dominant_set(counts, lengths, capacity, top) if top in counts else None
        if found is None:
            tops.pop()
            continue
        # the same set dominates while its pieces last: what goes only removes alternatives
        times = min(counts[length] // found.count(length) for length in set(found))
        fixed.append(Bins(times, capacity - sum(found), list(found)))
        for length in found:
            counts[length] -= times
        for length in set(found):
            if not counts[length]:
                del counts[length]
                lengths.remove(length)
    return fixed, counts


def best_fit(counts: dict[int, int], capacity: int) -> list[Bins]:
    """Longest pieces first, each into the fullest sequence that takes it; whole counts at once."""
    by_room: dict[int, list[Bins]] = {}
    rooms: list[int] = []

    def put(bins: Bins) -> None:
        if bins.room not in by_room:
            by_room[bins.room] = []
            bisect.insort(rooms, bins.room)
        by_room[bins.room].append(bins)

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                # every new sequence takes as many as fit: its room is then the fullest that does
                each = min(capacity // length, todo)
                times = todo // each
                put(Bins(times, capacity - each * length, [length] * each))
                todo -= times * each
                continue
            room = rooms[at]
            bins = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
            each = min(room // length, todo)
            times = min(bins.count, todo // each)
            if times < bins.count:
                put(Bins(bins.count - times, room, bins.lengths))
            put(Bins(times, room - each * length, bins.lengths + [length] * each))
            todo -= times * each
    return [bins for group in by_room.values() for bins in group]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Runs (length, first number, first sequence, offset), ascending within a length.

    Pieces of a length are numbered from 0. A run goes on to the next run of its length.
    """
    fixed, rest = reduce_by_dominance(counts, capacity)
    used: dict[int, int] = {}
    runs, sequence = [], 0
    for bins in fixed + best_fit(rest, capacity):
        offset = 0
        for length in bins.lengths:
            first = used.get(length, 0)
            runs.append((length, first, sequence, offset))
            used[length] = first + bins.count
            offset += length
        sequence += bins.count
    return sorted(runs)


def _cut(tokenizer: str, capacity: int):
    schema = arrow_schema(PIECES)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out = encoder(tokenizer), Rows(schema)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py())
                n, start, piece = len(ids) // 4, 0, 0
                while start < n:
                    length = (n - start) % capacity or capacity
                    out.add(key, piece, start, length, ids[4 * start : 4 * (start + length)], weight=4 * length)
                    start, piece = start + length, piece + 1
                if out.full():
                    yield from out.take()
        yield from out.take()

    return run


def _place(runs, schema: pa.Schema):
    """Looks up sequence and offset of pieces numbered within their length."""
    lengths = np.array([r[0] for r in runs], np.int64)
    firsts, sequences, offsets = (np.array([r[i] for r in runs], np.int64) for i in (1, 2, 3))
    bounds = {int(x): (int(np.searchsorted(lengths, x)), int(np.searchsorted(lengths, x, "right"))) for x in np.unique(lengths)}

    @tidy
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(3).to_numpy(zero_copy_only=False)
            number = batch.column(5).to_numpy(zero_copy_only=False)
            at = np.zeros(len(length), np.int64)
            for value in np.unique(length).tolist():
                low, high = bounds[value]
                mine = length == value
                at[mine] = low + np.searchsorted(firsts[low:high], number[mine], "right") - 1
            columns = list(batch.columns)[:5]
            columns += [pa.array(sequences[at] + number - firsts[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return place


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str | None, capacity: int) -> DataFrame:
    """``doc_id, piece, start, length, ids``: documents cut so that only first pieces are short."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("content"))
    return rows.mapInArrow(_cut(tokenizer or default_path(), capacity), PIECES)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and the end id; a null text counts as empty, so every row gives
    at least one piece. Only documents longer than ``capacity`` are cut, into pieces of
    that length but for the first. Rows that repeat an id are packed like others. An
    empty table gives an empty result. Columns other than the two named are not read.
    """
    pieces = token_pieces(docs, id_col, text_col, tokenizer, capacity)
    pieces = staged(
        pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces"
    )
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan(counts, capacity)

    # numbers within a length: blocks of rows by a hash, numbered inside, after the blocks before
    block = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(_blocks(counts)))
    blocked = pieces.withColumn("block", block)
    sizes = blocked.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("length").alias("s_length"),
        F.col("block").alias("s_block"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
    )
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    numbered = blocked.withColumn("inside", F.row_number().over(inside) - 1)
    numbered = numbered.join(
        starts, (F.col("length") == F.col("s_length")) & (F.col("block") == F.col("s_block"))
    ).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("inside")).alias("number"))
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.mapInArrow(_place(runs, arrow_schema(fields)), fields)


#: pieces of one length that are numbered by one task
BLOCK_ROWS = 20_000


def _blocks(counts: dict[int, int]) -> int:
    return max(1, -(-max(counts.values(), default=0) // BLOCK_ROWS))
