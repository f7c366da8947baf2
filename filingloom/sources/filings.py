"""Company registers, filing histories, manifests and the files behind them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.functions import text as tx
from filingloom.operators.ranking import newest_per_group
from filingloom.session import ship_package

ARCHIVE = "https://www.sec.gov/Archives/edgar/data"
REGISTER_SCHEMA = "map<string, struct<cik_str: bigint, ticker: string, title: string>>"
HISTORY_FIELDS = ("filing_date", "report_date", "form", "primary_document")


def normalize_cik(raw: Column) -> Column:
    """Digits only, zero-padded to ten; longer numbers keep all digits, none gives null."""
    digits = F.regexp_replace(raw.cast("string"), r"\P{Nd}", "")
    return (
        F.when(digits == "", F.lit(None).cast("string"))
        .when(F.length(digits) < 10, F.lpad(digits, 10, "0"))
        .otherwise(digits)
    )


def require_cik(raw: Column) -> Column:
    """As :func:`normalize_cik`, but a value without digits raises."""
    return F.coalesce(
        normalize_cik(raw),
        F.raise_error(F.concat(F.lit("Invalid CIK: "), tx.text_or_empty(raw.cast("string")))).cast(
            "string"
        ),
    )


def company_register(objects: DataFrame, column: str) -> DataFrame:
    """Rows (position, ticker, cik, title) from JSON objects that map an index to a record.

    ``position`` is the place of the record in its object.
    """
    records = objects.select(
        F.posexplode(F.map_values(F.from_json(column, REGISTER_SCHEMA))).alias("position", "r")
    )
    return records.select(
        F.col("position").cast("long").alias("position"),
        F.upper("r.ticker").alias("ticker"),
        normalize_cik(F.col("r.cik_str")).alias("cik"),
        F.col("r.title").alias("title"),
    )


def ticker_list(raw: Column) -> Column:
    """Comma-separated tickers: trimmed, upper-cased, each once in first-seen order."""
    parts = F.transform(F.split(raw, ","), lambda p: F.upper(tx.strip(p)))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def resolve_tickers(wanted: DataFrame, register: DataFrame, column: str = "ticker") -> DataFrame:
    """Requested tickers with their CIK; ``known`` is false where there is none.

    Of several records of a ticker the first by ``position`` counts; without that column
    the one with the least CIK.
    """
    asked = wanted.select(F.upper(tx.strip(F.col(column))).alias("ticker")).distinct()
    place = F.struct(*[c for c in ("position", "cik") if c in register.columns])
    first = register.groupBy("ticker").agg(F.min_by("cik", place).alias("cik"))
    return asked.join(first, "ticker", "left").withColumn(
        "known", F.col("cik").isNotNull()
    )


def filing_history(
    df: DataFrame, keys: Sequence[str], accessions: str, fields: Sequence[str] = HISTORY_FIELDS
) -> DataFrame:
    """Parallel arrays to rows, by position of the accession; short arrays give ''.

    The arrays are zipped inside the row and then exploded, so they are not
    copied once per output row.
    """
    zipped = F.slice(
        F.arrays_zip(F.col(accessions).alias("accession_number"), *[F.col(f) for f in fields]),
        1,
        F.size(accessions),
    )
    names = [accessions, *fields]
    return df.select(*keys, F.posexplode(zipped).alias("pos", "f")).select(
        *keys,
        F.col("pos").cast("long").alias("pos"),
        *[tx.text_or_empty(F.col("f")[n]).alias(n) for n in names],
    )


def filing_year(date: Column) -> Column:
    """Year from the first four characters if they are digits, else null."""
    head = F.substring(date, 1, 4)
    return F.when(F.regexp_like(head, F.lit("^[0-9]+$")), head.try_cast("int"))


def filter_filings(
    df: DataFrame,
    forms: Sequence[str] | None = None,
    start_year: int | None = None,
    end_year: int | None = None,
) -> DataFrame:
    """Form (any case) and year bounds; rows without a year leave only if a bound is given."""
    if forms:
        df = df.where(F.upper("form").isin(*[f.upper() for f in forms]))
    year = filing_year(F.col("filing_date"))
    if start_year is not None:
        df = df.where(year >= start_year)
    if end_year is not None:
        df = df.where(year <= end_year)
    return df


def newest_filings(df: DataFrame, limit: int, tie: str, company: str = "cik") -> DataFrame:
    """The ``limit`` newest filings of each company; equal dates keep ``tie`` order."""
    return newest_per_group(df, [company], [F.col("filing_date").desc(), F.col(tie)], limit)


def with_filing_urls(df: DataFrame, base: str = ARCHIVE) -> DataFrame:
    """Adds the accession without dashes and the index and document addresses."""
    bare = F.replace(F.col("accession_number"), F.lit("-"), F.lit(""))
    short_cik = F.regexp_replace("cik", "^0+(?=.)", "")
    folder = F.concat_ws("/", F.lit(base), short_cik, bare)
    return df.withColumns(
        {
            "accession_number_no_dashes": bare,
            "filing_url": F.concat(folder, F.lit("/"), F.col("accession_number"), F.lit("-index.htm")),
            "document_url": F.concat(folder, F.lit("/"), F.col("primary_document")),
        }
    )


def storage_path(
    ticker: Column, cik: Column, form: Column, date: Column, accession: Column
) -> Column:
    """``company/form/year/accession.html`` below the output folder."""
    return F.concat_ws(
        "/",
        tx.first_filled(ticker, cik),
        F.replace(F.coalesce(form, F.lit("UNKNOWN")), F.lit("/"), F.lit("-")),
        F.coalesce(
            F.nullif(F.substring(F.coalesce(date, F.lit("0000")), 1, 4), F.lit("")), F.lit("0000")
        ),
        F.concat(accession, F.lit(".html")),
    )


def download_manifest(
    requested: DataFrame,
    filings: DataFrame,
    fetched: DataFrame,
    limit_per_company: int,
    tie: str = "accession_number",
) -> DataFrame:
    """Manifest rows of the requested companies' newest filings.

    ``requested`` has (ticker, cik); ``fetched`` lists the accession numbers whose
    document arrived. Rows without one get an empty path and ``downloaded`` false.
    """
    wanted = requested.where(F.col("cik").isNotNull()).select("ticker", "cik")
    chosen = newest_filings(
        filings.drop("ticker").join(wanted.select("cik").distinct(), "cik", "left_semi"),
        limit_per_company,
        tie,
    )
    rows = with_filing_urls(chosen.join(wanted, "cik"))
    arrived = fetched.select("accession_number").distinct().withColumn("downloaded", F.lit(True))
    rows = rows.join(arrived, "accession_number", "left")
    done = F.coalesce(F.col("downloaded"), F.lit(False))
    path = storage_path(
        F.col("ticker"),
        F.col("cik"),
        F.col("form"),
        F.col("filing_date"),
        F.col("accession_number_no_dashes"),
    )
    return rows.withColumns(
        {"raw_path": F.when(done, path).otherwise(F.lit("")), "downloaded": done}
    )


def not_yet_stored(rows: DataFrame, stored: DataFrame, key: str = "accession_number") -> DataFrame:
    """Rows whose key is not in the existing manifest."""
    return rows.join(stored.select(key).distinct(), key, "left_anti")


def _file_writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        target, files = f"{root.rstrip('/')}/part-{TaskContext.get().partitionId():07d}", 0
        store.create_dir(target, recursive=True)
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for name, lines in groupby(rows, itemgetter(0)):
            draft, final = f"{target}/_{uuid.uuid4().hex}", f"{target}/{name}"
            with store.open_output_stream(draft) as sink:
                for _, line in lines:
                    sink.write((line or b"") + b"\n")
            # a file that is there is whole, from an earlier attempt of the task
            if store.get_file_info(final).type == fs.FileType.NotFound:
                store.move(draft, final)
            else:
                store.delete_file(draft)
            files += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    return run


def write_files(rows: DataFrame, folder: str, name: str, text: str) -> int:
    """Writes texts to files below ``folder``, and tells how many files.

    Each task writes into a folder of its own; its rows of one name are the lines of one file.
    The tasks write through pyarrow's file systems, a whole file at a time: Spark's writer by
    partition values costs a folder, a commit and, on local disks, several processes per file.
    """
    ship_package(rows.sparkSession)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    named = rows.select(F.col(name).alias("name"), F.col(text).cast("binary").alias("text"))
    written = named.sortWithinPartitions("name").mapInArrow(_file_writer(folder), "files long")
    return written.agg(F.sum("files")).first()[0] or 0


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """The files below a folder: raw_path, size and modification time. No content is read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(F.col("path").alias("raw_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_whole_files(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Every file as one row (raw_path, size, content); undecodable bytes are dropped.

    Files are dealt to tasks by their size in bytes. With ``max_bytes`` larger files are not
    opened: they keep their row, with a null content.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if max_bytes is None:
        read = raw
    else:
        # the source skips the content of files that its length filter leaves out
        read = raw.where(F.col("length") <= max_bytes)
    decoded = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    out = read.select(F.col("path").alias("raw_path"), F.col("length").alias("size"), decoded.alias("content"))
    if max_bytes is None:
        return out
    skipped = raw.where(F.col("length") > max_bytes).select(
        F.col("path").alias("raw_path"), F.col("length").alias("size"), F.lit(None).cast("string").alias("content")
    )
    return out.unionByName(skipped)


def below(path: Column, folder: str) -> Column:
    """A file's path from a folder's on, whatever the store is called in front of it."""
    tail = folder.rstrip("/").split("://", 1)[-1]
    return F.substring_index(path, tail + "/", -1)


def attach_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows whose file exists, with its content."""
    return manifest.where(F.coalesce(F.col("raw_path"), F.lit("")) != "").join(files, "raw_path")


def missing_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows that have no path or whose path has no file."""
    known = files.select("raw_path").distinct().withColumn("_there", F.lit(True))
    return (
        manifest.join(known, "raw_path", "left")
        .where(F.col("_there").isNull() | (F.coalesce(F.col("raw_path"), F.lit("")) == ""))
        .drop("_there")
    )


def path_identifiers(
    path: Column,
    ticker: Column | None = None,
    cik: Column | None = None,
    form: Column | None = None,
    filing_date: Column | None = None,
    accession: Column | None = None,
) -> Column:
    """Struct (ticker_or_cik, form, year, accession), from metadata, else from the path."""
    none = F.lit(None).cast("string")
    ticker, cik, form, filing_date, accession = (
        none if c is None else c for c in (ticker, cik, form, filing_date, accession)
    )

    def read(parts: Column) -> Column:
        def part(k: int) -> Column:
            return F.try_element_at(parts, F.lit(-k))

        stem = F.regexp_replace(part(1), r"^(.+)\.[^.]+$", "$1")
        head = F.substring(tx.text_or_empty(filing_date), 1, 4)
        year = F.when(F.regexp_like(head, F.lit("^[0-9]+$")), head).otherwise(
            F.coalesce(F.nullif(part(2), F.lit("")), F.lit("0000"))
        )
        form_part = F.coalesce(tx.first_filled(form, part(3)), F.lit("UNKNOWN"))
        return F.struct(
            F.coalesce(tx.first_filled(ticker, cik, part(4)), F.lit("UNKNOWN")).alias(
                "ticker_or_cik"
            ),
            F.replace(form_part, F.lit("/"), F.lit("-")).alias("form"),
            year.alias("year"),
            tx.text_or_empty(tx.first_filled(accession, stem)).alias("accession"),
        )

    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    rooted = F.when(path.startswith("/"), F.concat(F.array(F.lit("/")), parts)).otherwise(parts)
    return tx.let(rooted, read)


def artifact_inventory(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected artifacts (name, path) with availability and a warning where it lacks."""
    there = present.select("path").distinct().withColumn("_there", F.lit(True))
    available = F.coalesce(F.col("_there"), F.lit(False))
    return expected.join(there, "path", "left").select(
        "name",
        "path",
        available.alias("available"),
        F.when(
            ~available, F.concat(F.col("name"), F.lit(": not available ("), F.col("path"), F.lit(")"))
        ).alias("warning"),
    )
