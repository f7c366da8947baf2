"""Weak labels: one deterministic answer per task type.

Each function takes the excerpt and its sentence list, which callers compute
once per excerpt and share between tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingloom import constants as C
from filingloom.functions import text as tx


def _bulleted_or(items: Column, fallback: str) -> Column:
    return tx.let(
        items, lambda i: F.when(F.size(i) > 0, tx.bullets(i)).otherwise(F.lit(fallback))
    )


def summary_label(text: Column, sents: Column, k: int = 4) -> Column:
    return tx.summary_from(sents, text, k)


def metric_label(text: Column) -> Column:
    return _bulleted_or(tx.metric_mentions(text), C.NO_METRIC)


def keyword_label(sents: Column, terms: Sequence[str], fallback: str) -> Column:
    return _bulleted_or(tx.keyword_sentences(sents, terms), fallback)


def analyst_label(text: Column, sents: Column) -> Column:
    summary = tx.summary_from(sents, text, 3)
    key_point = F.when(F.size(sents) > 0, F.get(sents, F.lit(0))).otherwise(summary)
    evidence = F.substring(tx.strip(text), 1, 200)
    return F.concat(
        F.lit("Analyst Summary: "), summary,
        F.lit("\nKey Point: "), key_point,
        F.lit("\nEvidence: "), evidence,
    )


def outlook_label(
    text: Column,
    positive: Sequence[str] = C.POSITIVE_TERMS,
    negative: Sequence[str] = C.NEGATIVE_TERMS,
) -> Column:
    """The larger of two term counts decides; equal counts are neutral."""

    def render(n: Column) -> Column:
        label = (
            F.when(n["pos"] > n["neg"], "positive")
            .when(n["neg"] > n["pos"], "negative")
            .otherwise("neutral")
        )
        return F.concat(
            F.lit('{"label": "'), label,
            F.lit('", "reason": "Found '), n["pos"].cast("string"),
            F.lit(" positive and "), n["neg"].cast("string"),
            F.lit(" negative outlook term(s) in the excerpt (template keyword scoring).\"}"),
        )

    return tx.let(
        F.lower(text),
        lambda low: tx.let(
            F.struct(
                tx.term_count(low, positive).alias("pos"),
                tx.term_count(low, negative).alias("neg"),
            ),
            render,
        ),
    )


def claim_is_drawn(chunk_id: Column, sents: Column) -> Column:
    """Whether the proposed claim comes from the excerpt.

    Even chunk numbers do; identifiers that are not integers count as even.
    """
    number = F.when(
        F.regexp_like(chunk_id.cast("string"), F.lit(r"^-*[0-9]+$")),
        chunk_id.cast("string").try_cast("bigint"),
    )
    even = F.coalesce(number % 2 == 0, F.lit(True))
    return even & (F.size(sents) > 0)


def claim_input(text: Column, drawn: Column, sents: Column) -> Column:
    claim = F.when(drawn, F.get(sents, F.lit(0))).otherwise(F.lit(C.FALSE_CLAIM))
    return F.concat(text, F.lit("\n\nProposed answer: "), claim)


def claim_label(drawn: Column) -> Column:
    return F.when(
        drawn, F.lit('{"supported": true, "reason": "' + C.REASON_TRUE + '"}')
    ).otherwise(F.lit('{"supported": false, "reason": "' + C.REASON_FALSE + '"}'))


def answer_for(
    task: Column,
    text: Column,
    sents: Column,
    drawn: Column,
    yoy_terms: Sequence[str] = C.YOY_TERMS,
    risk_terms: Sequence[str] = C.RISK_TERMS,
    revenue_terms: Sequence[str] = C.REVENUE_TERMS,
    positive: Sequence[str] = C.POSITIVE_TERMS,
    negative: Sequence[str] = C.NEGATIVE_TERMS,
) -> Column:
    """The answer of the task named in ``task``; CASE evaluates only the matching branch."""
    return (
        F.when(task.isin("risk_summary", "mda_explanation"), summary_label(text, sents, 4))
        .when(task == "metric_extraction", metric_label(text))
        .when(task == "yoy_comparison", keyword_label(sents, yoy_terms, C.NO_YOY))
        .when(
            task == "business_risk_identification",
            keyword_label(sents, risk_terms, C.NO_RISK),
        )
        .when(
            task == "revenue_driver_explanation",
            keyword_label(sents, revenue_terms, C.NO_DRIVER),
        )
        .when(task == "filing_qa", summary_label(text, sents, 3))
        .when(task == "analyst_summary", analyst_label(text, sents))
        .when(task == "outlook_classification", outlook_label(text, positive, negative))
        .when(task == "hallucination_detection", claim_label(drawn))
    )


def instruction_for(task: Column) -> Column:
    out = F.lit(None).cast("string")
    for name in reversed(C.TASK_TYPES):
        out = F.when(task == name, F.lit(C.INSTRUCTIONS[name])).otherwise(out)
    return out


def baseline_answer(task: Column, text: Column, extended: bool = False) -> Column:
    """Deterministic extractive answer used where no model output exists."""
    raw = tx.text_or_empty(text)
    stripped = tx.strip(raw)
    figures = F.array_distinct(tx.find_all(raw, C.ANY_FIGURE, ignore_case=True))
    metrics = tx.let(
        figures,
        lambda f: F.when(
            F.size(f) > 0,
            F.concat(
                F.lit("Reported metrics: "), tx.join_first(f, 8 if extended else 5, ", "), F.lit(".")
            ),
        ).otherwise(F.lit(C.NO_METRIC)),
    )
    low = F.lower(raw)
    supported = F.contains(low, F.lit("proposed answer:")) & ~F.contains(
        low, F.lit("guarantees future investment returns")
    )
    lead = tx.let(
        tx.sentences(stripped, min_words=1),
        lambda s: F.when(F.size(s) > 0, tx.join_first(s, 3 if extended else 2)).otherwise(
            F.lit(C.BASELINE_EMPTY)
        ),
    )
    answer = (
        F.when(task == "metric_extraction", metrics)
        .when(task == "outlook_classification", F.lit(C.BASELINE_OUTLOOK))
        .when(
            task == "hallucination_detection",
            F.when(supported, F.lit(C.BASELINE_SUPPORTED)).otherwise(
                F.lit(C.BASELINE_UNSUPPORTED)
            ),
        )
        .otherwise(lead)
    )
    return clean_prediction(answer)


def clean_prediction(text: Column) -> Column:
    """Drop chat markers and an advisor sentence, then tidy the lines."""
    out = F.regexp_replace(tx.text_or_empty(text), "(?i)" + C.CHAT_TOKENS, " ")
    out = F.regexp_replace(out, "(?iU)" + C.ADVISOR_SENTENCE, " ")
    return tx.trim_lines(out)


def offline_rewrite(text: Column, old_answer: Column) -> Column:
    """First three sentences of three words or more, else 300 characters, else the old answer."""
    body = tx.strip(tx.text_or_empty(text))
    return tx.let(
        tx.sentences(body, 3),
        lambda s: F.when(F.size(s) > 0, tx.join_first(s, 3)).otherwise(
            F.coalesce(
                F.nullif(F.substring(body, 1, 300), F.lit("")),
                tx.strip(tx.text_or_empty(old_answer)),
            )
        ),
    )
