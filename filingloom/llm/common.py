"""What several operators share: Arrow plumbing, written intermediate tables, scratch removal."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from filingloom.session import cut_lineage, scratch_dir

#: ASCII letters to lower case, all other bytes as they are; safe on UTF-8
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
UPPER_LETTERS, LOWER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: the six white-space characters that the contracts name
BLANKS = b" \t\n\x0b\x0c\r"


_held: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What a Python worker keeps for one operator from task to task.

    Workers outlive stages, so what another operator has kept goes first.
    """
    if owner not in _held:
        _held.clear()
        trim()
        _held[owner] = {}
    return _held[owner]


def trim() -> None:
    """Gives memory that is free, but still held by allocators, back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run):
    """A task over Arrow batches that leaves no unused memory behind in its worker."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def raw_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def arrow_schema(schema: str | T.StructType) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


class Rows:
    """Collects columns and hands them out as record batches of bounded size."""

    def __init__(self, schema: pa.Schema, rows: int = 20_000, size: int = 16 << 20):
        self.schema, self.rows, self.size = schema, rows, size
        self.clear()

    def clear(self) -> None:
        self.columns: list[list] = [[] for _ in self.schema]
        self.held = 0

    def add(self, *values, weight: int = 0) -> None:
        for column, value in zip(self.columns, values):
            column.append(value)
        self.held += weight

    def full(self) -> bool:
        return len(self.columns[0]) >= self.rows or self.held >= self.size

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(self.columns, self.schema)], schema=self.schema
            )
            self.clear()


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read back."""
    return cut_lineage(df, label)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder that this package wrote."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_scratch(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Like ``staged``, and the folder, for tables that end before the job does."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many marks as it takes to differ from those taken."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def lowered(column) -> "F.Column":
    """A-Z to a-z and nothing else."""
    return F.translate(column, UPPER_LETTERS, LOWER_LETTERS)


def batches_of(items: Iterable, n: int) -> Iterator[list]:
    got: list = []
    for x in items:
        got.append(x)
        if len(got) == n:
            yield got
            got = []
    if got:
        yield got
