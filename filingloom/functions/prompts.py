"""Prompt and training texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingloom import constants as C
from filingloom.functions.text import strip, text_or_empty


def eval_user_text(task: Column, instruction: Column, excerpt: Column) -> Column:
    return F.concat(
        F.lit("Task type: "), F.coalesce(task, F.lit("general")),
        F.lit("\nInstruction: "), strip(text_or_empty(instruction)),
        F.lit("\n\nFiling excerpt:\n"), strip(text_or_empty(excerpt)),
        F.lit("\n\n" + C.EVAL_CLOSING),
    )


def eval_prompt(
    task: Column, instruction: Column, excerpt: Column, system: str = C.EVAL_SYSTEM
) -> Column:
    return F.concat(F.lit(system + "\n\n"), eval_user_text(task, instruction, excerpt))


def messages(system: str, user: Column) -> Column:
    """Two chat messages, system first."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", F.lit(system)), message("user", user))


def serving_user_text(question: Column, excerpt: Column, task: Column | None = None) -> Column:
    """Question and excerpt as sent to a model server; the task line is optional."""
    line = F.lit("")
    if task is not None:
        known = task.isin(*C.TASK_TYPES) | task.isNull()
        line = F.when(
            ~known, F.raise_error(F.concat(F.lit("Unsupported task_type "), task)).cast("string")
        ).otherwise(
            F.coalesce(F.concat(F.lit("Task Type: "), task, F.lit("\n")), F.lit(""))
        )
    return F.concat(
        line, F.lit("Question: "), question, F.lit("\nFiling Excerpt:\n"), excerpt
    )


def rewrite_user_text(
    task: Column, instruction: Column, excerpt: Column, draft: Column
) -> Column:
    return F.concat(
        F.lit("Task type: "), F.coalesce(task, F.lit("general")),
        F.lit("\nInstruction: "), strip(text_or_empty(instruction)),
        F.lit("\n\nFiling excerpt:\n"), strip(text_or_empty(excerpt)),
        F.lit("\n\nWeak draft answer to improve:\n"), strip(text_or_empty(draft)),
        F.lit("\n\n" + C.REWRITE_CLOSING),
    )


def sft_text(
    task: Column,
    instruction: Column,
    excerpt: Column,
    answer: Column,
    assistant: str = "FilingAssistant",
) -> Column:
    """Five-part training text with trimmed parts."""
    return F.concat(
        F.lit(f"<s>[INST] You are {assistant}, a financial filing analysis assistant.\n"),
        F.lit("Answer using only the provided filing excerpt. "),
        F.lit("Do not provide investment advice.\n\n"),
        F.lit("Task Type:\n"), strip(text_or_empty(task)),
        F.lit("\n\nInstruction:\n"), strip(text_or_empty(instruction)),
        F.lit("\n\nFiling Excerpt:\n"), strip(text_or_empty(excerpt)),
        F.lit("\n[/INST]\n"), strip(text_or_empty(answer)), F.lit("</s>"),
    )


def sft_text_plain(instruction: Column, excerpt: Column, answer: Column) -> Column:
    """Plain training text; the parts are used as they are."""
    return F.concat(
        F.lit("<s>[INST] "), text_or_empty(instruction),
        F.lit("\n\n"), text_or_empty(excerpt),
        F.lit(" [/INST] "), text_or_empty(answer), F.lit("</s>"),
    )
