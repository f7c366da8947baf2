"""Rule checks over example datasets."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom import constants as C
from filingloom.functions import prompts as pr
from filingloom.functions import text as tx
from filingloom.functions.numbers import is_finite

REQUIRED = ("id", "instruction", "input", "output", "task_type", "metadata")
TRAINING_REQUIRED = ("instruction", "input", "output", "task_type")


def _collect(*checks: Column) -> Column:
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def example_errors(line: Column) -> Column:
    """Error texts of one raw JSON line, empty if the example is valid.

    The line is parsed as a VARIANT: a typed schema could not tell a missing
    field from a null one.
    """

    def rules(doc: Column) -> Column:
        def field(name: str) -> Column:
            return F.try_variant_get(doc, f"$.{name}", "variant")

        def as_text(name: str) -> Column:
            return F.when(
                F.schema_of_variant(field(name)) == "STRING",
                F.try_variant_get(doc, f"$.{name}", "string"),
            ).otherwise(F.to_json(field(name)))

        def present(name: str) -> Column:
            return field(name).isNotNull() & ~F.is_variant_null(field(name))

        def absent(name: str) -> Column:
            return F.when(field(name).isNull(), F.lit(f"missing field '{name}'")).when(
                F.is_variant_null(field(name)), F.lit(f"null field '{name}'")
            )

        def blank(name: str, value: Column) -> Column:
            return F.when(field(name).isNull() | (value == ""), F.lit(f"empty {name}"))

        def outside(name: str, allowed: Sequence[str]) -> Column:
            return F.when(
                present(name) & ~F.coalesce(as_text(name).isin(*allowed), F.lit(False)),
                F.concat(F.lit(f"invalid {name} '"), as_text(name), F.lit("'")),
            )

        meta_kind = F.schema_of_variant(field("metadata"))
        return _collect(
            *[absent(name) for name in REQUIRED],
            blank("id", tx.strip(as_text("id"))),
            blank("instruction", tx.strip(as_text("instruction"))),
            blank("input", as_text("input")),
            blank("output", as_text("output")),
            outside("task_type", C.TASK_TYPES),
            F.when(
                field("metadata").isNotNull() & ~meta_kind.startswith("OBJECT"),
                F.lit("metadata is not an object"),
            ),
            outside("split", C.SPLITS),
        )

    def checked(doc: Column) -> Column:
        return (
            F.when(doc.isNull(), F.array(F.lit("JSON parse error")))
            .when(
                ~F.schema_of_variant(doc).startswith("OBJECT"),
                F.array(F.lit("example is not an object")),
            )
            .otherwise(rules(doc))
        )

    # bound once: the rules name the document dozens of times
    return tx.let(F.try_parse_json(line), checked)


def validate_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Adds ``errors``; blank lines are not examples and leave."""
    return df.where(~tx.is_blank(F.col(line))).withColumn("errors", example_errors(F.col(line)))


def file_report(
    validated: DataFrame, expected: DataFrame | None = None, strict: bool = False
) -> DataFrame:
    """Total, valid and invalid examples per file.

    A file in ``expected`` that has no rows is reported as missing. It passes, as
    it has no invalid example, unless ``strict`` is set.
    """
    report = validated.groupBy("file").agg(
        F.count(F.lit(1)).alias("total_examples"),
        F.count_if(F.size("errors") == 0).alias("valid_examples"),
        F.count_if(F.size("errors") > 0).alias("invalid_examples"),
    )
    found = F.lit(True)
    if expected is not None:
        report = expected.select("file").distinct().join(
            report.withColumn("_found", F.lit(True)), "file", "left"
        )
        found = F.coalesce(F.col("_found"), F.lit(False))
    zero = F.lit(0).cast("long")
    invalid = F.coalesce("invalid_examples", zero)
    ok = (invalid == 0) & (found if strict else F.lit(True))
    return report.select(
        "file",
        F.coalesce("total_examples", zero).alias("total_examples"),
        F.coalesce("valid_examples", zero).alias("valid_examples"),
        invalid.alias("invalid_examples"),
        found.alias("found"),
        ok.alias("passed"),
    )


def duplicate_ids(examples: DataFrame, id_col: str = "id") -> DataFrame:
    return (
        examples.groupBy(F.col(id_col).alias("id"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )


def expected_names(like: DataFrame, names: Sequence[str], column: str) -> DataFrame:
    """A short fixed list as a table."""
    return like.sparkSession.createDataFrame([(n,) for n in names], f"{column} string")


def task_coverage(
    examples: DataFrame, expected: Sequence[str] = C.TASK_TYPES, column: str = "task_type"
) -> DataFrame:
    """Each expected or seen task type with its presence flags."""
    seen = examples.groupBy(column).agg(F.count(F.lit(1)).alias("examples")).where(
        F.coalesce(F.col(column), F.lit("")) != ""
    )
    names = expected_names(examples, expected, column).withColumn("expected", F.lit(True))
    return names.join(seen, column, "full").select(
        column,
        F.coalesce("expected", F.lit(False)).alias("expected"),
        F.col("examples").isNotNull().alias("present"),
        F.coalesce("examples", F.lit(0)).alias("examples"),
    )


def dataset_gate(
    report: DataFrame, duplicates: DataFrame, leakage: DataFrame, unplaced: DataFrame | None = None
) -> DataFrame:
    """One row: passed when all files are valid, ids are unique and train and test are apart.

    ``unplaced`` are rows of no known split; with any of them leakage cannot be judged and
    the gate fails.
    """
    files = report.agg(
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("files_valid"),
        F.coalesce(F.sum("invalid_examples"), F.lit(0)).alias("invalid_examples"),
    )
    copies = duplicates.agg(F.count(F.lit(1)).alias("duplicate_ids"))
    apart = leakage.select("train_test_overlap")
    tables = [files, copies, apart]
    if unplaced is not None:
        tables.append(unplaced.agg(F.count(F.lit(1)).alias("unplaced")))
    # one row each
    parts = [d.withColumn("_one", F.lit(1)) for d in tables]
    joined = reduce(lambda a, b: a.join(b, "_one"), parts).drop("_one")
    passed = F.col("files_valid") & (F.col("duplicate_ids") == 0) & (F.col("train_test_overlap") == 0)
    if unplaced is not None:
        passed = passed & (F.col("unplaced") == 0)
    return joined.withColumn("passed", passed)


def length_filter(df: DataFrame, min_input: int = 100, min_output: int = 10) -> DataFrame:
    return df.where((F.length("input") >= min_input) & (F.length("output") >= min_output))


def training_errors(df: DataFrame) -> DataFrame:
    """Adds ``errors``: training fields that are missing as columns, null or blank."""
    checks = [
        F.when(tx.is_blank(F.col(name).cast("string")), F.lit(f"empty field '{name}'"))
        if name in df.columns
        else F.lit(f"missing field '{name}'")
        for name in TRAINING_REQUIRED
    ]
    return df.withColumn("errors", _collect(*checks))


def with_training_text(df: DataFrame, assistant: str = "FilingAssistant") -> DataFrame:
    parts = [F.col(c) for c in ("task_type", "instruction", "input", "output")]
    return df.withColumn("text", pr.sft_text(*parts, assistant=assistant))


def training_token_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows and mean words of the training text (0 if there are none)."""
    return df.agg(
        F.count(F.lit(1)).alias("examples"),
        F.coalesce(F.avg(tx.word_count(F.col(text))), F.lit(0.0)).alias("mean_tokens"),
    )


def dry_run_errors(df: DataFrame, split: str = "split", position: str = "position") -> DataFrame:
    """One row per broken rule: split, 0-based position and ``split[position]: rule``."""
    broken = training_errors(df).select(split, position, F.explode("errors").alias("error"))
    place = F.concat(F.col(split), F.lit("["), F.col(position).cast("string"), F.lit("]: "))
    return broken.select(split, position, F.concat(place, "error").alias("message"))


def dry_run_summary(df: DataFrame, split: str = "split") -> DataFrame:
    """Errors, examples of both splits and mean words of the training texts (0 without any)."""
    checked = training_errors(with_training_text(df))
    in_train = F.col(split) == "train"
    words = F.when(in_train, tx.word_count(F.col("text")))
    return checked.agg(
        F.coalesce(F.sum(F.size("errors")), F.lit(0)).cast("long").alias("errors"),
        F.count_if(in_train).alias("train_examples"),
        F.count_if(F.col(split) == "validation").alias("validation_examples"),
        F.coalesce(F.avg(words), F.lit(0.0)).alias("mean_tokens"),
    )


def loss_history(
    logs: DataFrame, run: str = "run", step: str = "step", train: str = "loss", evaluation: str = "eval_loss"
) -> DataFrame:
    """Last seen training and evaluation loss per run, and the first non-finite step."""

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col(step)))

    broken = F.col(train).isNotNull() & ~is_finite(F.col(train))
    return logs.groupBy(run).agg(
        last(train).alias("final_train_loss"),
        last(evaluation).alias("final_eval_loss"),
        F.min(F.when(broken, F.col(step))).alias("first_bad_step"),
        F.coalesce(F.bool_or(broken), F.lit(False)).alias("has_bad_loss"),
    )
