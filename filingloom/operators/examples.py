"""Instruction examples: routing, ids, labels and rewritten targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom import constants as C
from filingloom.functions import labels as lb
from filingloom.functions import prompts as pr
from filingloom.functions import text as tx
from filingloom.operators.chunks import chunk_windows

METADATA_FIELDS = (
    "ticker", "cik", "form", "section", "filing_date", "report_date", "year",
    "accession_number", "accession_number_no_dashes", "source_url",
)


def tasks_for_section(section: Column, allow: Sequence[str] | None = None) -> Column:
    """Task types of a section in fixed order; unknown sections have none.

    The mapping has 27 rows, so it is an expression rather than a join.
    """
    out = F.array().cast("array<string>")
    for name, tasks in C.SECTION_TASKS.items():
        kept = [t for t in tasks if allow is None or t in set(allow)]
        values = F.array(*[F.lit(t) for t in kept]) if kept else F.array().cast("array<string>")
        out = F.when(section == name, values).otherwise(out)
    return out


def route_tasks(df: DataFrame, allow: Sequence[str] | None = None) -> DataFrame:
    """One row per (row, applicable task), with the task's position in the routing order."""
    return df.select(
        "*", F.posexplode(tasks_for_section(F.col("section"), allow)).alias("task_pos", "task_type")
    ).withColumn("task_pos", F.col("task_pos").cast("long"))


def is_task_type(task: Column, known: Sequence[str] = C.TASK_TYPES) -> Column:
    return F.coalesce(task.isin(*known), F.lit(False))


def check_task_type(task: Column, known: Sequence[str] = C.TASK_TYPES) -> Column:
    """The task type itself; an unknown one raises."""
    return F.when(is_task_type(task, known), task).otherwise(
        F.raise_error(F.concat(F.lit("Unknown task_type "), F.coalesce(task, F.lit("null"))))
    )


def company_of(ticker: Column, cik: Column) -> Column:
    return F.coalesce(tx.first_filled(ticker, cik), F.lit("UNK"))


def _year_part(year: Column, filing_date: Column) -> Column:
    return F.coalesce(
        tx.first_filled(year, F.substring(tx.text_or_empty(filing_date), 1, 4)), F.lit("XXXX")
    )


def example_id(meta: Column, chunk_id: Column, task: Column) -> Column:
    """Hyphen-joined id; empty parts are left out."""
    form = F.replace(F.coalesce(meta["form"], F.lit("NA")), F.lit("/"), F.lit("-"))
    accession = F.right(tx.text_or_empty(meta["accession_number_no_dashes"]), F.lit(6))
    parts = (
        F.upper(company_of(meta["ticker"], meta["cik"])),
        _year_part(meta["year"], meta["filing_date"]),
        form,
        accession,
        F.coalesce(meta["section"], F.lit("sec")),
        chunk_id.cast("string"),
        task,
    )
    return F.concat_ws("-", *[F.nullif(p, F.lit("")) for p in parts])


def source_label(meta: Column) -> Column:
    """Space-joined company, year, form and section; empty parts are left out."""
    parts = (
        company_of(meta["ticker"], meta["cik"]),
        _year_part(meta["year"], meta["filing_date"]),
        F.coalesce(meta["form"], F.lit("NA")),
        meta["section"],
    )
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def filing_metadata(df: DataFrame) -> DataFrame:
    """Collects the manifest columns of a section row into ``metadata``."""
    date = tx.text_or_empty(F.col("filing_date"))
    head = F.substring(date, 1, 4)
    values = {
        "year": F.when(F.regexp_like(head, F.lit("^[0-9]+$")), head).otherwise(F.lit("")),
        "filing_date": date,
        "accession_number_no_dashes": F.replace(
            tx.text_or_empty(F.col("accession_number")), F.lit("-"), F.lit("")
        ),
    }
    return df.withColumn(
        "metadata",
        F.struct(
            *[
                values[n].alias(n) if n in values else tx.text_or_empty(F.col(n)).alias(n)
                for n in METADATA_FIELDS
                if n in values or n in df.columns
            ]
        ),
    )


def usable_sections(sections: DataFrame, allow: Sequence[str] | None = None) -> DataFrame:
    """Sections that give at least one example, with their tasks in ``_tasks``."""
    return sections.withColumn("_tasks", tasks_for_section(F.col("section"), allow)).where(
        (F.size("_tasks") > 0) & ~tx.is_blank(F.col("text"))
    )


def build_examples(
    sections: DataFrame,
    keys: Sequence[str] = (),
    allow: Sequence[str] | None = None,
    max_tokens: int = 512,
    overlap: int = 64,
    min_tokens: int = 80,
    **banks: Sequence[str],
) -> DataFrame:
    """Examples for every (chunk, task) of the section rows.

    Blank texts and sections without tasks leave before chunking. Sentences are
    split once per chunk, then the tasks fan out. The whole build is narrow: no
    shuffle before the sink.
    """
    wanted = usable_sections(filing_metadata(sections), allow)
    chunks = chunk_windows(
        wanted, "text", [*keys, "metadata", "_tasks"], max_tokens, overlap, min_tokens
    )
    chunks = chunks.withColumn("_sents", tx.sentences(F.col("text")))
    chunks = chunks.withColumn("_drawn", lb.claim_is_drawn(F.col("chunk_id"), F.col("_sents")))
    fanned = chunks.select("*", F.posexplode("_tasks").alias("task_pos", "task_type"))
    return _render(fanned, keys, banks)


def _render(fanned: DataFrame, keys: Sequence[str], banks: dict) -> DataFrame:
    task, text, sents, drawn = (F.col(c) for c in ("task_type", "text", "_sents", "_drawn"))
    meta = F.col("metadata")
    fields = [meta[n].alias(n) for n in fanned.schema["metadata"].dataType.names]
    return fanned.select(
        *keys,
        F.col("chunk_id"),
        F.col("task_pos").cast("long").alias("task_pos"),
        example_id(meta, F.col("chunk_id"), task).alias("id"),
        lb.instruction_for(task).alias("instruction"),
        F.when(
            task == "hallucination_detection", lb.claim_input(text, drawn, sents)
        ).otherwise(text).alias("input"),
        lb.answer_for(task, text, sents, drawn, **banks).alias("output"),
        task.alias("task_type"),
        source_label(meta).alias("source"),
        F.struct(
            *fields,
            F.col("chunk_id").alias("chunk_id"),
            F.col("token_count").alias("token_count"),
            F.lit("template_extractive").alias("generation_method"),
            F.lit(True).alias("weak_supervision"),
        ).alias("metadata"),
    )


def cap_examples(df: DataFrame, order: Sequence[str], n: int | None) -> DataFrame:
    """First ``n`` examples in a stable order; all of them when ``n`` is None."""
    return df if n is None else df.orderBy(*order).limit(n)


def rewrite_targets(df: DataFrame, model: str = "mock") -> DataFrame:
    """Replace each output by the offline rewrite and mark the example."""
    meta = (
        F.col("metadata")
        .withField("generation_method", F.lit("llm_assisted_mock"))
        .withField("enhanced", F.lit(True))
        .withField("weak_supervision", F.lit(False))
        .withField("enhancement_model", F.lit(model))
    )
    return df.withColumns(
        {"output": lb.offline_rewrite(F.col("input"), F.col("output")), "metadata": meta}
    )


def with_rewrite_prompt(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "rewrite_prompt",
        pr.rewrite_user_text(
            F.col("task_type"), F.col("instruction"), F.col("input"), F.col("output")
        ),
    )
