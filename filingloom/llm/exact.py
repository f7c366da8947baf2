"""Exact deduplication by grace hashing.

Every task first folds the equal texts it has read into one record, so a group of copies
reaches the exchange with one record per task, however large it is. The records are
partitioned by content hash into spill files in the shared folder, and the buckets whose
distinct content would not fit a table are partitioned again by the next digit of the
hash, until all fit. An open-addressing table that compares complete content then settles
each bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingloom.llm.common import LOWER, Rows, arrow_schema, raw_bytes, staged, tidy

BUCKET_BYTES = 32 << 20
FOLD_BYTES = 32 << 20
FANOUT = 16
#: what an entry costs beside its content
ENTRY_BYTES = 128


class ContentTable:
    """Open addressing with linear probing; equal means equal in every byte."""

    def __init__(self):
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.bytes = 0

    def find(self, digest: int, text: bytes) -> tuple[int, bool]:
        """The entry of ``text``, and whether it is new."""
        mask = len(self.slots) - 1
        at = digest & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == digest and self.texts[entry] == text:
                return entry, False
            at = (at + 1) & mask
        entry = self.slots[at] = len(self.texts)
        self.hashes.append(digest)
        self.texts.append(text)
        self.bytes += len(text) + ENTRY_BYTES
        if 3 * len(self.texts) > 2 * len(self.slots):
            self._grow()
        return entry, True

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for entry, digest in enumerate(self.hashes):
            at = digest & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def _larger(a, b):
    return b if a is None or (b is not None and b > a) else a


def _fold(schema: pa.Schema, limit: int):
    """Rows to members (id, record) and records (content, its largest id, its rows)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        table, largest, rows = ContentTable(), [], []

        def records() -> Iterator[pa.RecordBatch]:
            out = Rows(schema)
            for i, text in enumerate(table.texts):
                signed = table.hashes[i] - (1 << 63)
                out.add(None, first + i, signed, text, largest[i], rows[i], weight=len(text))
                if out.full():
                    yield from out.take()
            yield from out.take()

        members = Rows(schema)
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1))):
                text = raw.translate(LOWER)
                entry, new = table.find(xxhash.xxh3_64_intdigest(text), text)
                if new:
                    largest.append(None)
                    rows.append(0)
                largest[entry] = _larger(largest[entry], key)
                rows[entry] += 1
                members.add(key, first + entry, None, None, None, None)
                if table.bytes > limit:
                    yield from records()
                    first += len(table.texts)
                    table, largest, rows = ContentTable(), [], []
            yield from members.take()
        yield from records()

    return run


def _settle(schema: pa.Schema):
    """Records sorted by bucket to (record, id that stays, rows of the group, digest)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        bucket, table, groups = None, ContentTable(), []

        def close() -> Iterator[pa.RecordBatch]:
            for text, (keep, rows, records) in zip(table.texts, groups):
                digest = hashlib.sha256(text).hexdigest()
                for record in records:
                    out.add(record, keep, rows, digest)
                if out.full():
                    yield from out.take()

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for at, record, digest, text, keep, rows in zip(*columns):
                if at != bucket:
                    yield from close()
                    bucket, table, groups = at, ContentTable(), []
                entry, new = table.find(digest + (1 << 63), text)
                if new:
                    groups.append([None, 0, []])
                group = groups[entry]
                group[0] = _larger(group[0], keep)
                group[1] += rows
                group[2].append(record)
        yield from close()
        yield from out.take()

    return run


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    fold_bytes: int = FOLD_BYTES,
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one, so
    all null and empty texts form one group. Of equal texts the row with the largest id
    stays; a null id is smaller than any other. Rows that repeat an id share its verdict.
    Columns other than the two named are not read. An empty table gives an empty result.

    ``bucket_bytes`` bounds the distinct content of a table, ``fold_bytes`` that of the
    fold in front of the exchange; neither changes the result.
    """
    kind = docs.schema[id_col].dataType
    fields = [
        T.StructField("id", kind),
        T.StructField("record", T.LongType()),
        T.StructField("hash", T.LongType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("largest", kind),
        T.StructField("rows", T.LongType()),
    ]
    folded = staged(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("content")).mapInArrow(
            _fold(arrow_schema(T.StructType(fields)), fold_bytes), T.StructType(fields)
        ),
        "grace-folded",
    )
    members = folded.where("content IS NULL").select("id", "record")
    records = folded.where("content IS NOT NULL").drop("id")

    weight = (F.length("content") + ENTRY_BYTES).alias("weight")
    total = records.agg(F.sum(weight)).first()[0] or 0
    buckets = max(1, -(-2 * total // bucket_bytes))
    open_ = records.withColumn("bucket", F.pmod("hash", F.lit(buckets)).cast("string"))
    settled, level = [], 0
    while True:
        distinct = open_.groupBy("bucket", "hash").agg(F.max(weight).alias("weight"))
        sizes = distinct.groupBy("bucket").agg(F.sum("weight").alias("size"), F.count("*").alias("hashes"))
        over = sizes.where((F.col("size") > bucket_bytes) & (F.col("hashes") > 1)).select("bucket")
        over = staged(over, "grace-over")
        if over.isEmpty():
            settled.append(open_)
            break
        level += 1
        digit = F.pmod(F.xxhash64("hash", F.lit(level)), F.lit(FANOUT)).cast("string")
        settled.append(open_.join(over, "bucket", "left_anti"))
        open_ = staged(
            open_.join(over, "bucket", "left_semi")
            .withColumn("bucket", F.concat_ws("/", "bucket", digit))
            .repartition("bucket"),
            "grace-spill",
        )

    out = T.StructType(
        [
            T.StructField("record", T.LongType()),
            T.StructField("keep_id", kind),
            T.StructField("group_size", T.LongType()),
            T.StructField("text_sha256", T.StringType()),
        ]
    )
    verdicts = None
    for part in settled:
        # a text longer than a bucket shares a task with other buckets one after the other
        done = (
            part.select("bucket", "record", "hash", "content", "largest", "rows")
            .repartition("bucket")
            .sortWithinPartitions("bucket")
            .mapInArrow(_settle(arrow_schema(out)), out)
        )
        verdicts = done if verdicts is None else verdicts.unionAll(done)
    return members.join(verdicts, "record").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
