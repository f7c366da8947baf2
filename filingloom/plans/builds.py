"""End-to-end jobs: pages to sections, sections to a split dataset, runs to a comparison."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.functions import html as ht
from filingloom.operators import audit, compare, examples, scoring, sections, splits
from filingloom.session import cut_lineage
from filingloom.sources import filings as fl
from filingloom.sources import jsonl

SECTION_COLUMNS = (
    "raw_path", "section", "text", "text_chars", "text_words", "cik", "ticker", "form",
    "filing_date", "report_date", "accession_number", "source_url",
)


def extract_filings(
    manifest: DataFrame, files: DataFrame, min_section_words: int
) -> DataFrame:
    """Raw manifest and page contents to processed section rows.

    One join on the path; cleaning, sectioning and filtering are narrow.
    """
    pages = fl.attach_files(manifest, files)
    ids = fl.path_identifiers(
        F.col("raw_path"),
        F.col("ticker"),
        F.col("cik"),
        F.col("form"),
        F.col("filing_date"),
        F.col("accession_number_no_dashes"),
    )
    pages = pages.withColumn("_ids", ids).withColumns(
        {
            "form": F.coalesce("form", F.col("_ids.form")),
            "accession_number": F.coalesce("accession_number", F.col("_ids.accession")),
            "source_url": F.coalesce("document_url", F.lit("")),
            "clean": ht.html_to_text(F.col("content")),
        }
    )
    keys = [
        "raw_path", "cik", "ticker", "form", "filing_date", "report_date", "accession_number",
        "source_url",
    ]
    spans = sections.section_spans(pages, keys, "clean")
    return sections.section_manifest(spans, "text", min_section_words).select(*SECTION_COLUMNS)


@dataclass
class Dataset:
    """A built dataset and the tables that describe it."""

    path: str
    examples: DataFrame
    stats: DataFrame
    profile: DataFrame
    manifest: DataFrame
    leakage: DataFrame


def split_dataset(
    section_rows: DataFrame,
    strategy: str = "company_holdout",
    chunking: dict[str, int] | None = None,
    allow: Sequence[str] | None = None,
    **split_options,
) -> DataFrame:
    """Chunks and labels the sections and gives every example its split."""
    built = examples.build_examples(section_rows, allow=allow, **(chunking or {}))
    usable = examples.usable_sections(examples.filing_metadata(section_rows), allow)
    meta = F.col("metadata")
    if strategy == "company_holdout":
        key = splits.company_key(meta["ticker"], meta["cik"])
    else:
        key = splits.year_key(meta["year"])
    return splits.split_examples(built, key, strategy, groups=usable.select(key), **split_options)


def describe_dataset(written: DataFrame) -> dict[str, DataFrame]:
    """``stats``, ``profile``, ``manifest`` and ``leakage`` of split examples."""
    flat = written.withColumns(
        {
            "section": F.col("metadata.section"),
            "company": splits.company_key(F.col("metadata.ticker"), F.col("metadata.cik")),
            "cik": F.col("metadata.cik"),
            "year": F.col("metadata.year"),
        }
    )
    return {
        "stats": splits.dataset_stats(flat),
        "profile": splits.split_profile(flat),
        "manifest": jsonl.dataset_manifest(written),
        "leakage": splits.leakage_check(flat, F.col("company")),
    }


def build_dataset(
    section_rows: DataFrame,
    path: str,
    strategy: str = "company_holdout",
    fmt: str = "parquet",
    chunking: dict[str, int] | None = None,
    allow: Sequence[str] | None = None,
    **split_options,
) -> Dataset:
    """Chunks, labels, splits and writes the examples, then describes what was written.

    The examples are computed once, by the write; every later table reads the
    written files, of which it needs only a few columns.
    """
    rows = split_dataset(section_rows, strategy, chunking, allow, **split_options)
    jsonl.write_splits(rows, path, fmt)
    written = jsonl.read_splits(rows.sparkSession, path, rows.schema, fmt)
    return Dataset(path=path, examples=written, **describe_dataset(written))


def split_of_path(path: Column) -> Column:
    """The split a file belongs to, null if its path does not say.

    From a ``split=`` folder, else the name of the file up to its first mark, else the
    folder it lies in.
    """
    names = "(train|validation|test)"
    said = [
        F.regexp_extract(path, f"(?:^|/)split={names}(?:/|$)", 1),
        F.regexp_extract(path, f"(?:^|/){names}(?:[^A-Za-z/][^/]*)?$", 1),
        F.regexp_extract(path, f"(?:^|/){names}/[^/]*$", 1),
    ]
    return F.coalesce(*[F.nullif(s, F.lit("")) for s in said])


def audit_dataset(lines: DataFrame, id_path: str = "$.id") -> DataFrame:
    """Gate over raw example lines (file, line): valid rows, unique ids, no shared company."""
    checked = audit.validate_lines(lines)
    parsed = checked.where(F.try_parse_json("line").isNotNull()).select(
        F.get_json_object("line", id_path).alias("id"),
        split_of_path(F.col("file")).alias("split"),
        splits.company_key(
            F.get_json_object("line", "$.metadata.ticker"),
            F.get_json_object("line", "$.metadata.cik"),
        ).alias("company"),
    )
    return audit.dataset_gate(
        audit.file_report(checked),
        audit.duplicate_ids(parsed),
        splits.leakage_check(parsed, F.col("company")),
        unplaced=parsed.where(F.col("split").isNull()),
    )


@dataclass
class Evaluation:
    rows: DataFrame
    metrics: DataFrame
    counts: DataFrame
    metadata: DataFrame | None = None


def scored_rows(
    test_rows: DataFrame,
    order: str,
    extended: bool = False,
    scorer: Callable[[Column, Column], Column] | None = None,
    predictions: DataFrame | None = None,
) -> DataFrame:
    """The examples with a prediction and its metrics.

    Without ``predictions`` (id, prediction) the extractive baseline answers.
    """
    if predictions is None:
        answered = scoring.with_baseline_prediction(test_rows, extended)
    else:
        answered = test_rows.join(predictions, "id")
    return scoring.eval_rows(scoring.score_examples(answered, scorer=scorer), order)


def evaluate(
    test_rows: DataFrame,
    order: str,
    extended: bool = False,
    scorer: Callable[[Column, Column], Column] | None = None,
    predictions: DataFrame | None = None,
    backend: str = "extractive",
) -> Evaluation:
    """Scores one run; ``backend`` names what produced it."""
    # written once: roll-ups and comparison all read the scored rows
    rows = cut_lineage(scored_rows(test_rows, order, extended, scorer, predictions), "scored-rows")
    return Evaluation(
        rows=rows,
        metrics=compare.aggregate_metrics(scoring.metrics_long(rows, ["task_type"])),
        counts=compare.task_counts(rows),
        metadata=compare.run_metadata(rows.withColumn("backend", F.lit(backend))),
    )


@dataclass
class Comparison:
    overall: DataFrame
    by_task: DataFrame
    summary: DataFrame
    pairs: DataFrame


def compare_runs(
    baseline: Evaluation, finetuned: Evaluation, order: str, max_examples: int | None = None
) -> Comparison:
    """Overall and per-task comparison of two runs with the joined prediction rows."""

    def scope(run: Evaluation, name: str) -> DataFrame:
        return run.metrics.where(F.col("scope") == name)

    overall = compare.compare_metrics(scope(baseline, "overall"), scope(finetuned, "overall"))
    by_task = compare.compare_metrics(
        scope(baseline, "task"), scope(finetuned, "task"), ("task_type", "metric")
    )
    return Comparison(
        overall=overall,
        by_task=by_task,
        summary=compare.comparison_summary(overall, baseline.metadata, finetuned.metadata),
        pairs=compare.prediction_join(baseline.rows, finetuned.rows, order, max_examples),
    )
