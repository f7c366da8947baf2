"""JSON Lines: reading under three policies, line numbers, split output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingloom.functions import text as tx
from filingloom.session import cut_lineage


def line_kind(line: Column) -> Column:
    """``blank``, ``bad`` (not JSON), ``other`` (JSON but no object) or ``object``."""
    doc = F.try_parse_json(line)
    return (
        F.when(tx.is_blank(line), "blank")
        .when(doc.isNull(), "bad")
        .when(F.schema_of_variant(doc).startswith("OBJECT"), "object")
        .otherwise("other")
    )


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with ``file`` and 1-based ``line_no``; blank lines count.

    Files are split between tasks, so the number is the position inside the
    input block plus the lines of earlier blocks of the file. Only the block
    table (one row per block) is summed. It is written out first, so its size is
    known and it is broadcast while small: lines are not shuffled to number them.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )
    blocks = raw.groupBy("file", "block").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = blocks.select(
        "file", "block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    return raw.join(cut_lineage(starts, "blocks"), ["file", "block"]).select(
        "file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), "line"
    )


def read_objects(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Lenient policy: malformed lines and JSON that is no object are skipped.

    A field whose value does not fit the schema is null; its row stays.
    """
    lines = spark.read.text(path).where(line_kind(F.col("value")) == "object")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_strict(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Fail-fast policy: the first bad line read raises ``file:line``."""
    numbered = number_lines(spark, path).where(~tx.is_blank(F.col("line")))
    message = F.concat(
        F.col("file"), F.lit(":"), F.col("line_no").cast("string"), F.lit(": invalid JSON")
    )
    checked = F.when(F.try_parse_json("line").isNull(), F.raise_error(message).cast("string")).otherwise(
        F.col("line")
    )
    return numbered.select(F.from_json(checked, schema).alias("r")).select("r.*")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit policy: every non-blank line with its file, number and kind."""
    return (
        number_lines(spark, path)
        .withColumn("kind", line_kind(F.col("line")))
        .where(F.col("kind") != "blank")
    )


def json_object(text: Column, schema: str) -> Column:
    """The object in ``text``, or null if it is missing, malformed or no object."""
    return F.when(line_kind(text) == "object", F.from_json(text, schema))


def object_warning(name: Column, text: Column) -> Column:
    """Why an optional object is not available; null if it is."""
    kind = line_kind(text)
    return (
        F.when(text.isNull(), F.concat(name, F.lit(": missing")))
        .when(kind.isin("bad", "blank"), F.concat(name, F.lit(": unreadable")))
        .when(kind == "other", F.concat(name, F.lit(": not an object")))
    )


def write_splits(examples: DataFrame, path: str, fmt: str = "parquet") -> str:
    """One folder per split; ``fmt='json'`` gives JSON Lines."""
    writer = examples.write.partitionBy("split").mode("errorifexists")
    if fmt == "json":
        writer = writer.option("ignoreNullFields", "false")
    writer.format(fmt).save(path)
    return path


def read_splits(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def dataset_manifest(examples: DataFrame) -> DataFrame:
    """Id, split, task, section, company and source of every example."""
    meta = F.col("metadata")
    return examples.select(
        "id",
        "split",
        "task_type",
        tx.text_or_empty(meta["section"]).alias("section"),
        tx.text_or_empty(meta["ticker"]).alias("ticker"),
        tx.text_or_empty(F.col("source")).alias("source"),
    )
