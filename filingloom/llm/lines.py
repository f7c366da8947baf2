"""Line deduplication over levelled sorted runs of line hashes.

The store is a set of runs, each a table of line hashes with the number of documents that
hold them, cut into buckets by hash and sorted in each. A batch of documents is dealt into
the same buckets once; the hashes that a run already knows to be frequent are taken out by
a merge anti-join, for which the runs stay where they are, and the rest becomes a new run
of the lowest level. When a level holds ``fanout`` runs they are merged into one run of
the next level, which adds up their counts. The store lasts as long as its folder.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingloom.llm.common import BLANKS, LOWER, Rows, arrow_schema, fresh, raw_bytes, remove, staged, tidy
from filingloom.session import scratch_dir

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 4
FANOUT = 4


def line_keys(raw: bytes, min_chars: int) -> list[bytes | None]:
    """For each line its 16-byte hash, or None where the line is too short to count."""
    out: list[bytes | None] = []
    for line in raw.translate(LOWER).split(b"\n"):
        key = line.strip(BLANKS)
        long_enough = len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long_enough else None)
    return out


def _hashes(schema: pa.Schema, min_chars: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1))):
                for digest in set(line_keys(raw, min_chars)) - {None}:
                    out.add(key, digest)
                if out.full():
                    yield from out.take()
        yield from out.take()

    return run


class LineRuns:
    """The levels of runs, kept as bucketed tables below ``root``.

    A store that is there is opened, with the buckets it has; else one is made, with
    ``buckets`` or as many as the session shuffles into. What a batch changes counts once
    its list of runs is written, so a batch that was interrupted is added anew. One writer
    at a time. ``close`` drops a store that was made without a ``root``.
    """

    def __init__(
        self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT, root: str | None = None, buckets: int | None = None
    ):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.passing = root is None
        self.root = (root or scratch_dir(spark, "line-runs")).rstrip("/")
        session = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets, self.batches = buckets or session, 0
        self.levels: dict[int, list[tuple[str, str]]] = defaultdict(list)
        for level, path in self._listed():
            self.levels[level].append((self._registered(path), path))

    # the list of runs: one small file for each batch, of which the last counts

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _store(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self) -> list[tuple[int, str]]:
        store, folder = self._store(), self._path("lists")
        if not store.exists(folder):
            return []
        last = max(s.getPath().getName() for s in store.listStatus(folder))
        told = json.loads(self.spark.read.option("wholetext", True).text(f"{self.root}/lists/{last}").first()[0])
        self.buckets, self.batches = told["buckets"], told["batches"]
        return [tuple(run) for run in told["runs"]]

    def _list(self) -> None:
        self.batches += 1
        runs = [[level, path] for level, found in sorted(self.levels.items()) for _, path in found]
        told = json.dumps({"buckets": self.buckets, "batches": self.batches, "runs": runs})
        store, draft = self._store(), self._path(f"draft-{uuid.uuid4().hex}")
        out = store.create(draft, False)
        out.write(bytearray(told, "utf-8"))
        out.close()
        store.mkdirs(self._path("lists"))
        store.rename(draft, self._path(f"lists/{self.batches:09d}"))

    def _registered(self, path: str) -> str:
        """A name for a run's files, which tells Spark their buckets and order."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} (hash BINARY, n_docs BIGINT) USING parquet "
            f"CLUSTERED BY (hash) SORTED BY (hash) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for found in self.levels.values() for name, _ in found]

    def unknown(self, hashes: DataFrame) -> DataFrame:
        """``hash, n_docs`` of a batch, without the lines that a run knows to be frequent."""
        counts = hashes.groupBy("hash").agg(F.count("*").alias("n_docs"))
        if self.buckets != int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            counts = counts.repartition(self.buckets, "hash")
        for run in self.runs():
            counts = counts.join(run.where(F.col("n_docs") >= self.min_docs).hint("merge"), "hash", "left_anti")
        return counts

    def add(self, hashes: DataFrame) -> None:
        """Adds a batch: ``hash``, one row per document and distinct line."""
        self._write(self.unknown(hashes), 0)
        level, gone = 0, []
        while len(self.levels[level]) >= self.fanout:
            old = self.levels.pop(level)
            self._write(self._merged([path for _, path in old]), level + 1)
            gone += old
            level += 1
        self._list()
        self._drop(gone)

    def _write(self, counts: DataFrame, level: int) -> None:
        path = f"{self.root}/runs/{uuid.uuid4().hex}"
        name = f"line_run_{uuid.uuid4().hex}"
        # dealt out as the buckets are, so each is one sorted file
        dealt = counts.repartition(self.buckets, "hash")
        dealt.write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", path).format("parquet").saveAsTable(name)
        self.levels[level].append((name, path))

    def _merged(self, paths: list[str]) -> DataFrame:
        # read as plain files: Spark 4.1 takes a union of bucketed tables for bucketed itself and
        # then adds up within its parts only
        every = self.spark.read.schema("hash binary, n_docs long").parquet(*paths)
        return every.groupBy("hash").agg(F.sum("n_docs").alias("n_docs"))

    def frequent(self) -> DataFrame:
        """The hashes that at least ``min_docs`` documents of all batches hold."""
        paths = [path for found in self.levels.values() for _, path in found]
        if not paths:
            return self.spark.createDataFrame([], "hash binary")
        return self._merged(paths).where(F.col("n_docs") >= self.min_docs).select("hash")

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, path)

    def close(self) -> None:
        """Forgets the names of the runs; the files of a store without a given ``root`` go too."""
        for found in self.levels.values():
            for name, _ in found:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels.clear()
        if self.passing:
            remove(self.spark, self.root)


def _kept(raw: bytes, drop: list[bytes] | None, min_chars: int) -> tuple[int, bytes]:
    """Lines dropped, and the text without them."""
    if not drop:
        return 0, raw
    gone, parts = set(drop), raw.split(b"\n")
    kept = [x for x, k in zip(parts, line_keys(raw, min_chars)) if k not in gone]
    return len(parts) - len(kept), b"\n".join(kept)


def _drop(schema: pa.Schema, min_chars: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            ids, drops = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for key, raw, drop in zip(ids, raw_bytes(batch.column(1)), drops):
                dropped, kept = _kept(raw, drop, min_chars)
                out.add(key, raw.count(b"\n") + 1, dropped, kept.decode(), weight=len(kept))
                if out.full():
                    yield from out.take()
        yield from out.take()

    return run


def _drops(
    docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int, batches: int, fanout: int
) -> DataFrame:
    """``drop_id, drop``: the frequent lines of the documents that hold any."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("content"))
    schema = T.StructType([T.StructField("id", kind), T.StructField("hash", T.BinaryType())])
    hashes = staged(
        rows.mapInArrow(_hashes(arrow_schema(schema), min_chars), schema).withColumn(
            "batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")
        ),
        "line-hashes",
    )
    store = LineRuns(docs.sparkSession, min_docs, fanout)
    for batch in range(batches):
        store.add(hashes.where(F.col("batch") == batch).select("hash"))
    frequent = staged(store.frequent(), "line-frequent")
    store.close()
    # an id that repeats gets the frequent lines of all its rows; those go everywhere anyway
    return hashes.join(frequent, "hash").groupBy(F.col("id").alias("drop_id")).agg(F.collect_set("hash").alias("drop"))


def drop_frequent_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """One row per input row: id, ``n_lines``, ``n_dropped``, ``kept_text``.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased.
    Keys of at least ``min_chars`` code points that at least ``min_docs`` rows hold lose
    all their lines in every document; the other lines stay as they are, joined by
    newlines. A null or empty text is one empty line, which stays. A text whose lines all
    go becomes empty. Rows that repeat an id count as documents of their own. Other
    columns are not read. An empty table gives an empty result.

    The table is added in ``batches`` batches (by a hash of the id); their number and
    ``fanout`` do not change the result.
    """
    drops = _drops(docs, id_col, text_col, min_docs, min_chars, batches, fanout)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("content"))
    out = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_dropped", T.LongType()),
            T.StructField("kept_text", T.StringType()),
        ]
    )
    joined = rows.join(drops, rows["id"].eqNullSafe(drops["drop_id"]), "left")
    return joined.select("id", "content", "drop").mapInArrow(_drop(arrow_schema(out), min_chars), out)


def without_frequent_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    chars_col: str | None = None,
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """``docs`` with all its columns, the frequent lines taken out of the text.

    Texts without such lines stay as they are, null included. ``chars_col`` names a column
    that holds the text's length and follows it.
    """
    drops = _drops(docs, id_col, text_col, min_docs, min_chars, BATCHES, FANOUT)
    key, drop = fresh(docs.columns, "drop_id", "drop")
    drops = drops.withColumnsRenamed({"drop_id": key, "drop": drop})
    joined = docs.join(drops, docs[id_col].eqNullSafe(drops[key]), "left")
    joined = joined.select(*[docs[c] for c in docs.columns], drop)
    at, schema = docs.columns.index(text_col), docs.schema

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drops = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            for i, drop in enumerate(drops):
                if drop:
                    texts[i] = _kept(texts[i].encode(), drop, min_chars)[1].decode()
            columns = list(batch.columns)[:-1]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    out = joined.mapInArrow(run, schema)
    if chars_col:
        changed = F.when(F.col(text_col).isNotNull(), F.length(text_col)).otherwise(F.col(chars_col))
        out = out.withColumn(chars_col, changed.cast(schema[chars_col].dataType))
    return out
