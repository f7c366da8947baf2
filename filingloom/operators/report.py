"""Tables behind an evaluation report. Nothing is rendered here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingloom import constants as C
from filingloom.functions import text as tx
from filingloom.functions.numbers import exact_mean, format_fixed, format_signed, is_finite
from filingloom.operators.ranking import rank_values
from filingloom.session import cut_lineage

# result markers, categories and takeaways (fixed values)
IMPROVED, REGRESSED, UNCHANGED = "▲ improved", "▼ regressed", "— no change"
CATEGORY_LABELS = {
    "improvement": "Improvement",
    "regression": "Regression / failure case",
    "average": "Average case",
    "faithfulness": "Faithfulness / hallucination case",
    "additional": "Additional example",
}
TAKEAWAY_REGRESSED = (
    "Fine-tuning regressed on lexical-overlap metrics here, often because the "
    "fine-tuned answer adds correct detail not present in the short reference."
)
TAKEAWAY_FAITHFUL = "Fine-tuning improved grounding/faithfulness relative to the base model."
TAKEAWAY_BETTER = "Fine-tuned answer is more specific and better grounded in the excerpt."
TAKEAWAY_EQUAL = "Base and fine-tuned answers are comparable on this example."


def _spaced(col: str) -> Column:
    return F.replace(F.col(col), F.lit("_"), F.lit(" "))


def result_marker(delta: Column) -> Column:
    return (
        F.when(~is_finite(delta), "N/A")
        .when(delta > 0, IMPROVED)
        .when(delta < 0, REGRESSED)
        .otherwise(UNCHANGED)
    )


def overall_table(comparison: DataFrame) -> DataFrame:
    return comparison.select(
        _spaced("metric").alias("metric"),
        format_fixed(F.col("baseline")).alias("base"),
        format_fixed(F.col("finetuned")).alias("fine_tuned"),
        format_signed(F.col("absolute_delta")).alias("delta_abs"),
        format_signed(F.col("relative_delta_pct"), 1).alias("delta_pct"),
        result_marker(F.col("absolute_delta")).alias("result"),
    )


def task_table(comparison: DataFrame) -> DataFrame:
    return comparison.orderBy("task_type", "metric").select(
        _spaced("task_type").alias("task"),
        _spaced("metric").alias("metric"),
        format_fixed(F.col("baseline")).alias("base"),
        format_fixed(F.col("finetuned")).alias("fine_tuned"),
        format_signed(F.col("absolute_delta")).alias("delta_abs"),
        result_marker(F.col("absolute_delta")).alias("result"),
    )


def stats_rows(stats: DataFrame) -> DataFrame:
    """Key/value rows of dataset statistics: totals, splits, then tasks by name."""
    count = F.col("examples").cast("string")

    def row(position: int, label: Column, value: Column) -> Column:
        return F.struct(
            F.lit(position).cast("long").alias("position"),
            label.alias("statistic"),
            value.alias("value"),
        )

    total = F.array(
        row(1, F.lit("Total examples"), count),
        row(2, F.lit("Avg. input length (chars)"), format_fixed(F.col("average_input_length"), 1)),
        row(3, F.lit("Avg. output length (chars)"), format_fixed(F.col("average_output_length"), 1)),
    )
    rows = (
        F.when(F.col("scope") == "total", total)
        .when(F.col("scope") == "split", F.array(row(4, F.concat(F.lit("Split · "), "name"), count)))
        .when(
            F.col("scope") == "task_type",
            F.array(row(5, F.concat(F.lit("Task · "), _spaced("name")), count)),
        )
    )
    return stats.select(F.inline(rows)).orderBy("position", "statistic")


def _label_rows(one_row: DataFrame, keys: Sequence[str], fields: Sequence[tuple]) -> DataFrame:
    """One row of named figures to (position, label, value); null shows as N/A."""
    rows = []
    for position, (label, value) in enumerate(fields, start=1):
        rows.append(
            F.struct(
                F.lit(position).cast("long").alias("position"),
                F.lit(label).alias("label"),
                F.coalesce(value, F.lit("N/A")).alias("value"),
            )
        )
    return one_row.select(*keys, F.inline(F.array(*rows)))


def latency_rows(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    def plain(name: str) -> Column:
        return F.col(name).cast("string") if name in summary.columns else F.lit(None).cast("string")

    def number(name: str, decimals: int = 3) -> Column:
        return format_fixed(F.col(name), decimals) if name in summary.columns else F.lit("N/A")

    fields = (
        ("Endpoint", plain("endpoint")),
        ("Model", plain("model")),
        ("Requests", plain("num_requests")),
        ("Concurrency", plain("concurrency")),
        ("Successful", plain("successful_requests")),
        ("Failed", plain("failed_requests")),
        ("p50 latency (s)", number("p50_latency_s")),
        ("p95 latency (s)", number("p95_latency_s")),
        ("p99 latency (s)", number("p99_latency_s")),
        ("Avg latency (s)", number("avg_latency_s")),
        ("Approx tokens/s", number("approx_tokens_per_second", 1)),
    )
    return _label_rows(summary, keys, fields)


def training_rows(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    names = (
        ("model_id", "Base model"),
        ("num_train_examples", "Train examples"),
        ("num_eval_examples", "Eval examples"),
        ("lora_r", "LoRA rank (r)"),
        ("lora_alpha", "LoRA alpha"),
        ("learning_rate", "Learning rate"),
        ("epochs", "Epochs"),
        ("max_seq_length", "Max sequence length"),
        ("packing", "Sequence packing"),
        ("final_train_loss", "Final train loss"),
        ("final_eval_loss", "Final eval loss"),
    )
    fields = [
        (label, F.col(n).cast("string") if n in summary.columns else F.lit(None).cast("string"))
        for n, label in names
    ]
    return _label_rows(summary, keys, fields)


def _deltas(summary: Column) -> Column:
    return F.map_values(F.coalesce(summary, F.create_map().cast("map<string,double>")))


def mean_improvement(summary: Column) -> Column:
    return tx.let(
        _deltas(summary),
        lambda v: F.when(
            F.size(v) > 0,
            F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(v), F.lit(1)),
        ).otherwise(F.lit(0.0)),
    )


def min_improvement(summary: Column) -> Column:
    return F.coalesce(F.array_min(_deltas(summary)), F.lit(0.0))


def is_faithfulness_case(task: Column, summary: Column) -> Column:
    names = F.map_keys(F.coalesce(summary, F.create_map().cast("map<string,double>")))
    named = F.exists(
        names, lambda k: F.contains(k, F.lit("faithful")) | F.contains(k, F.lit("hallucin"))
    )
    return F.coalesce(task == "hallucination_detection", F.lit(False)) | named


def qualitative_pick(pairs: DataFrame, order: str, max_examples: int = 5) -> DataFrame:
    """A few telling rows: best, worst, average, faithfulness, then the next best.

    Candidates are top-k reads of the full table; the average case is found by
    exact rank selection, so nothing is sorted globally. Only the union of these few
    rows is put in final order. ``order`` is a unique numeric position.
    """
    summary = F.col("improvement_summary")
    # the narrow score table is read several times, the texts only for the final rows
    scored = cut_lineage(
        pairs.select(
            order,
            mean_improvement(summary).alias("mean_delta"),
            min_improvement(summary).alias("min_delta"),
            is_faithfulness_case(F.col("task_type"), summary).alias("_faithful"),
        ),
        "scored",
    )
    by_mean = [F.col("mean_delta").desc(), F.col(order)]

    def wanted(rows: DataFrame, category: str, slot: int) -> DataFrame:
        return rows.select(
            "*", F.lit(category).alias("category"), F.lit(slot).alias("_slot")
        )

    best = scored.orderBy(*by_mean).limit(2).where("mean_delta > 0")
    worst = scored.orderBy("min_delta", *by_mean).limit(1).where("min_delta < 0")
    faithful = scored.where("_faithful").orderBy(*by_mean).limit(max_examples + 1)
    backfill = scored.orderBy(*by_mean).limit(max_examples + 1)
    candidates = (
        wanted(best, "improvement", 1)
        .unionByName(wanted(worst, "regression", 2))
        .unionByName(wanted(_middle_row(scored, order), "average", 3))
        .unionByName(wanted(faithful, "faithfulness", 4))
        .unionByName(wanted(backfill, "additional", 5))
    )
    # at most 2 * max_examples + 6 rows from here on
    first = Window.partitionBy(order).orderBy("_slot")
    unique = candidates.withColumn("_first", F.row_number().over(first)).where("_first = 1")
    per_slot = Window.partitionBy("_slot").orderBy(*by_mean)
    unique = unique.withColumn("_pos", F.row_number().over(per_slot))
    # one faithfulness case only; the others compete for the remaining places
    slot = F.when((F.col("_slot") == 4) & (F.col("_pos") > 1), 5).otherwise(F.col("_slot"))
    category = F.when(slot == 5, "additional").otherwise(F.col("category"))
    final = unique.withColumns({"_slot": slot, "category": category})
    chosen = final.orderBy("_slot", *by_mean).limit(max_examples)
    chosen = cut_lineage(chosen.drop("_first", "_pos", "_faithful"), "picked")
    return pairs.join(chosen, order).orderBy("_slot", *by_mean).drop("_slot")


def _middle_row(scored: DataFrame, order: str) -> DataFrame:
    """The row at 0-based place n // 2 by mean descending, then by ``order``."""
    one = scored.select(
        F.lit(1).alias("_all"),
        (-F.col("mean_delta")).alias("_down"),
        F.col(order).alias("_order"),
    )
    n = one.groupBy("_all").agg(
        (F.floor(F.count(F.lit(1)) / 2) + 1).cast("long").alias("rank")
    )
    value = rank_values(one, ["_all"], "_down", n)
    # rows with that same mean compete by their order
    target = value.select(
        (-F.col("value")).alias("_mean"), (F.col("rank") - F.col("below")).alias("rank")
    ).withColumn("_all", F.lit(1))
    tied = one.join(
        target.select("_all", (-F.col("_mean")).alias("_down")), ["_all", "_down"], "left_semi"
    )
    place = rank_values(tied, ["_all"], "_order", target.select("_all", "rank"))
    return scored.join(
        cut_lineage(place.select(F.col("value").alias("_place")), "middle"),
        F.col(order) == F.col("_place"),
        "left_semi",
    )


def takeaway(category: Column, mean: Column) -> Column:
    return (
        F.when((category == "regression") | (mean < 0), TAKEAWAY_REGRESSED)
        .when(category == "faithfulness", TAKEAWAY_FAITHFUL)
        .when(mean > 0, TAKEAWAY_BETTER)
        .otherwise(TAKEAWAY_EQUAL)
    )


def category_label(category: Column) -> Column:
    out = category
    for name, label in CATEGORY_LABELS.items():
        out = F.when(category == name, label).otherwise(out)
    return out


def task_mean_delta(by_task: DataFrame) -> DataFrame:
    """Mean of the finite deltas of each task."""
    finite = by_task.where(is_finite(F.col("absolute_delta")))
    return finite.groupBy("task_type").agg(
        exact_mean(F.col("absolute_delta")).alias("mean_delta")
    ).select(_spaced("task_type").alias("task"), "mean_delta")


def task_distribution(examples: DataFrame, column: str = "task_type") -> DataFrame:
    counts = examples.groupBy(column).agg(F.count(F.lit(1)).alias("examples"))
    return counts.orderBy(F.col("examples").desc(), column).select(
        _spaced(column).alias("task"), "examples"
    )


def faithfulness_subset(
    comparison: DataFrame, names: Sequence[str] = C.FAITHFULNESS_METRICS
) -> DataFrame:
    """The named metrics with a usable value on one side at least."""
    b, f = F.col("baseline"), F.col("finetuned")
    return comparison.where(F.col("metric").isin(*names) & (is_finite(b) | is_finite(f))).select(
        "metric",
        F.when(is_finite(b), b).otherwise(F.lit(0.0)).alias("baseline"),
        F.when(is_finite(f), f).otherwise(F.lit(0.0)).alias("finetuned"),
    )


def sample_data_flag(
    runs: DataFrame, keys: Sequence[str], backend: str = "backend", compared: str = "has_comparison"
) -> DataFrame:
    """True where a backend only gives sample answers or no comparison exists."""
    sample = F.lower(tx.text_or_empty(F.col(backend))).isin(*C.SAMPLE_BACKENDS)
    return runs.groupBy(*keys).agg(
        (F.coalesce(F.bool_or(sample), F.lit(False)) | ~F.coalesce(F.bool_or(compared), F.lit(False))).alias(
            "is_sample"
        )
    )
