"""Token files: documents in ascending id order, range-coded, in shards of bounded size.

A shard is one binary file::

    magic, header length | header (JSON) | symbols, shares | document ids, null marks,
    lengths | block index | blocks: words, checkpoint states, checkpoint positions

All blocks of a shard share its frequency table. A task reads one range of ids in order
and closes a shard after ``shard_tokens`` ids, so its memory does not follow the range.
Files appear under their final name only when complete, and a task that runs again writes
the same bytes; the manifest returned by the writer lists the shards that count.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filingloom.llm import rans
from filingloom.llm.common import Rows, arrow_schema, staged, tidy
from filingloom.llm.tokens import default_path, encoder

MAGIC = b"TOKRANS1"
SHARD_TOKENS = 4_000_000
#: blocks decoded side by side
GROUP = 16
#: characters per shard when ranges are laid out; only their number depends on it
CHARS_PER_TASK = 16_000_000
#: pieces that a writing worker remembers; most rare words come once more in the texts of a worker
PIECES = 1_000_000
#: bytes of files that a task decodes, about; a shard is read by one task
READ_BYTES = 4 << 20

MANIFEST = "part long, seq long, path string, n_docs long, n_tokens long, n_blocks long, n_bytes long"
TOKENS = "doc_id long, start long, n_tokens long, ids binary"
INDEX = np.dtype([("offset", "<u8"), ("n", "<u4"), ("words", "<u4"), ("marks", "<u4"), ("crc", "<u4")])


def _join(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def shard_bytes(keys: list[int | None], lengths: list[int], ids: np.ndarray) -> tuple[bytes, int]:
    """One shard and its number of blocks."""
    table = rans.Table.of(ids)
    index, bodies, at = [], [], 0
    step = rans.LANES * rans.STEPS * GROUP
    for low in range(0, len(ids), step):
        for block in rans.encode(ids[low : low + step], table):
            body = block.words.tobytes() + block.states.tobytes() + block.positions.tobytes()
            index.append((at, block.n, len(block.words), len(block.positions), block.crc))
            bodies.append(body)
            at += len(body)
    header = {
        "docs": len(keys),
        "tokens": len(ids),
        "symbols": len(table.symbols),
        "blocks": len(index),
        "lanes": rans.LANES,
        "steps": rans.STEPS,
        "checkpoint": rans.CHECKPOINT,
        "scale_bits": rans.SCALE_BITS,
    }
    text = json.dumps(header).encode()
    parts = [
        MAGIC,
        struct.pack("<I", len(text)),
        text,
        table.symbols.tobytes(),
        table.shares.tobytes(),
        np.array([k or 0 for k in keys], "<i8").tobytes(),
        np.array([k is None for k in keys], "u1").tobytes(),
        np.array(lengths, "<u8").tobytes(),
        np.array(index, INDEX).tobytes(),
        *bodies,
    ]
    return b"".join(parts), len(index)


@dataclass
class Shard:
    keys: list[int | None]
    lengths: np.ndarray
    table: rans.Table
    index: np.ndarray
    body: memoryview
    lanes: int
    checkpoint: int

    @classmethod
    def parse(cls, data: bytes) -> Shard:
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        (size,) = struct.unpack_from("<I", data, 8)
        head, at = json.loads(data[12 : 12 + size]), 12 + size

        def take(kind, n):
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got

        symbols, shares = take("<u4", head["symbols"]), take("<u4", head["symbols"])
        keys, nulls = take("<i8", head["docs"]).tolist(), take("u1", head["docs"]).tolist()
        lengths, index = take("<u8", head["docs"]).astype(np.int64), take(INDEX, head["blocks"])
        if head["scale_bits"] != rans.SCALE_BITS:
            raise ValueError("another scale")
        named = [None if null else key for key, null in zip(keys, nulls)]
        return cls(named, lengths, rans.Table(symbols, shares), index, memoryview(data)[at:], head["lanes"], head["checkpoint"])

    def block(self, i: int) -> rans.Block:
        row = self.index[i]
        at, words, marks = int(row["offset"]), int(row["words"]), int(row["marks"])
        stream = np.frombuffer(self.body, "<u4", words, at)
        states = np.frombuffer(self.body, "<u8", marks * self.lanes, at + 4 * words).reshape(marks, self.lanes)
        positions = np.frombuffer(self.body, "<u4", marks, at + 4 * words + 8 * marks * self.lanes)
        return rans.Block(int(row["n"]), stream, states, positions, int(row["crc"]))

    def ids(self) -> np.ndarray:
        out = []
        for low in range(0, len(self.index), GROUP):
            blocks = [self.block(i) for i in range(low, min(low + GROUP, len(self.index)))]
            out += rans.decode(blocks, self.table, self.lanes, self.checkpoint)
        return np.concatenate(out) if out else np.zeros(0, "<u4")


def _place(store: fs.FileSystem, partial: str, final: str, size: int) -> None:
    """Gives a complete file its name.

    An earlier attempt of the task may have left the same bytes there; not every store
    moves a file over another.
    """
    found = store.get_file_info(final)
    if found.type != fs.FileType.NotFound:
        if found.size == size:
            store.delete_file(partial)
            return
        store.delete_file(final)
    store.move(partial, final)


def _writer(root: str, tokenizer: str, shard_tokens: int):
    schema = arrow_schema(MANIFEST)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        encode = encoder(tokenizer, PIECES)
        store, folder = fs.FileSystem.from_uri(root)
        out = Rows(schema)
        keys: list[int | None] = []
        lengths: list[int] = []
        held: list[bytes] = []
        size = 0

        def close() -> None:
            nonlocal seq, size
            data, blocks = shard_bytes(keys, lengths, np.frombuffer(b"".join(held), "<u4"))
            name = f"part-{part:07d}-{seq:05d}.tok"
            partial = _join(folder, f"_partial-{uuid.uuid4().hex}")
            with store.open_output_stream(partial) as sink:
                sink.write(data)
            _place(store, partial, _join(folder, name), len(data))
            out.add(part, seq, _join(root, name), len(keys), size, blocks, len(data))
            seq, size = seq + 1, 0
            for kept in (keys, lengths, held):
                kept.clear()

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py())
                keys.append(key)
                lengths.append(len(ids) // 4)
                held.append(ids)
                size += len(ids) // 4
                if size >= shard_tokens:
                    close()
        if keys:
            close()
        yield from out.take()

    return run


def write_tokens(
    docs: DataFrame,
    root: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Writes token files of all rows below ``root`` and returns their manifest.

    Ids must be integers; null ids come first. A null text counts as empty; every document
    ends with the end id. Rows that repeat an id, or have none, are written in the order of
    a hash of their text, so the files do not depend on how the rows are dealt out. An empty
    table gives no file and an empty manifest. ``root`` is a folder that all
    executors share, in any store that pyarrow can open.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("content"))
    chars = rows.agg(F.sum(F.length("content"))).first()[0] or 0
    tasks = max(1, -(-chars // CHARS_PER_TASK))
    store, folder = fs.FileSystem.from_uri(root)
    store.create_dir(folder, recursive=True)
    # the text itself is only compared where ids and hashes are equal
    order = [F.col("id").asc_nulls_first(), F.xxhash64("content"), F.col("content").asc_nulls_first()]
    ordered = rows.repartitionByRange(tasks, *order[:2]).sortWithinPartitions(*order)
    path = tokenizer or default_path()
    return staged(ordered.mapInArrow(_writer(root, path, shard_tokens), MANIFEST), "token-manifest")


def _reader():
    schema = arrow_schema(TOKENS)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name) as source:
                    shard = Shard.parse(source.read())
                data, at = shard.ids().tobytes(), 0
                for key, n in zip(shard.keys, shard.lengths.tolist()):
                    out.add(key, start, n, data[4 * at : 4 * (at + n)], weight=4 * n)
                    at, start = at + n, start + n
                    if out.full():
                        yield from out.take()
        yield from out.take()

    return run


def read_tokens(manifest: DataFrame) -> DataFrame:
    """All documents of the shards: ``doc_id``, ``start``, ``n_tokens``, ``ids``.

    ``start`` counts the ids of all documents before, in file order; ``ids`` are unsigned
    32-bit, little-endian. A damaged block raises an error. Files are dealt to tasks by
    their bytes and decoded side by side.
    """
    size = manifest.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = max(1, -(-size // READ_BYTES))
    per_part = manifest.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = per_part.select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    shards = shards.join(parts, "part").select("path", (F.col("part_start") + F.col("inside")).alias("start"))
    return shards.repartitionByRange(tasks, "start").mapInArrow(_reader(), TOKENS)


def token_files(spark: SparkSession, docs: DataFrame, root: str, **options) -> DataFrame:
    """Writes and reads back."""
    return read_tokens(write_tokens(docs, root, **options))
