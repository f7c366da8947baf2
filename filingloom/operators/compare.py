"""Metric roll-ups and the comparison of two scored runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.functions.numbers import exact_mean, finite_or_zero, round_half_even


DELTA_COLUMNS = ("baseline", "finetuned", "absolute_delta", "relative_delta_pct", "improved")


def aggregate_metrics(long: DataFrame) -> DataFrame:
    """Mean of each metric overall and per task, over the rows that have it.

    ``long`` has (task_type, metric, value). One pass with grouping sets.
    """
    sets = [[F.col("task_type"), F.col("metric")], [F.col("metric")]]
    return (
        long.groupingSets(sets, "task_type", "metric")
        .agg(
            F.grouping("task_type").alias("_all"),
            F.coalesce(round_half_even(exact_mean(F.col("value")), 4), F.lit(0.0)).alias("mean"),
            F.count("value").alias("n"),
        )
        .select(
            F.when(F.col("_all") == 1, "overall").otherwise("task").alias("scope"),
            F.when(F.col("_all") == 0, F.col("task_type")).alias("task_type"),
            "metric",
            "mean",
            "n",
        )
    )


def task_counts(rows: DataFrame) -> DataFrame:
    """Rows per task and overall, with mean preview and prediction length."""
    sets = [[F.col("task_type")], []]
    return rows.groupingSets(sets, "task_type").agg(
        F.grouping("task_type").cast("long").alias("is_total"),
        F.count(F.lit(1)).alias("examples"),
        F.coalesce(
            round_half_even(F.avg(F.length(F.coalesce("input_preview", F.lit("")))), 4), F.lit(0.0)
        ).alias("average_input_length"),
        F.coalesce(
            round_half_even(F.avg(F.length(F.coalesce("prediction", F.lit("")))), 4), F.lit(0.0)
        ).alias("average_prediction_length"),
    )


def with_metric_delta(df: DataFrame, baseline: Column, finetuned: Column) -> DataFrame:
    """Adds the delta columns of two values; unusable values count as zero.

    Built in steps, so that no step repeats the expressions of the one before.
    """
    b, f, delta = F.col("_b"), F.col("_f"), F.col("absolute_delta")
    relative = F.when(b != 0.0, delta / F.abs(F.nullif(b, F.lit(0.0))) * 100.0).otherwise(
        F.when(delta != 0.0, 100.0).otherwise(0.0)
    )
    return (
        df.withColumns({"_b": finite_or_zero(baseline), "_f": finite_or_zero(finetuned)})
        .withColumn("absolute_delta", round_half_even(f - b, 4))
        .withColumns(
            {
                "baseline": round_half_even(b, 4),
                "finetuned": round_half_even(f, 4),
                "relative_delta_pct": round_half_even(relative, 2),
                "improved": delta > 0.0,
            }
        )
        .drop("_b", "_f")
    )


def compare_metrics(
    baseline: DataFrame, finetuned: DataFrame, keys: Sequence[str] = ("metric",)
) -> DataFrame:
    """Full outer comparison of two (keys, mean) tables.

    A metric missing on one side counts 0.0 there and carries a warning. With a
    task key, ``keys=("task_type", "metric")`` compares per task.
    """
    keys = list(keys)
    b = baseline.select(*keys, F.col("mean").alias("_base"), F.lit(True).alias("_in_b"))
    f = finetuned.select(*keys, F.col("mean").alias("_fine"), F.lit(True).alias("_in_f"))
    scope = F.col("task_type") if "task_type" in keys else F.lit("overall")

    def missing(side: str) -> Column:
        return F.concat(
            F.lit("["), scope, F.lit("] metric '"), F.col("metric"), F.lit(f"' missing in {side}")
        )

    both = with_metric_delta(b.join(f, keys, "full"), F.col("_base"), F.col("_fine"))
    return both.select(
        *keys,
        *DELTA_COLUMNS,
        F.when(F.col("_in_b").isNull(), missing("baseline"))
        .when(F.col("_in_f").isNull(), missing("finetuned"))
        .alias("warning"),
    )


def improvements(comparison: DataFrame) -> DataFrame:
    return comparison.where("absolute_delta > 0").orderBy(F.col("absolute_delta").desc(), "metric")


def regressions(comparison: DataFrame) -> DataFrame:
    return comparison.where("absolute_delta < 0").orderBy("absolute_delta", "metric")


def run_metadata(rows: DataFrame, keys: Sequence[str] = (), backend: str = "backend") -> DataFrame:
    """``backend`` and ``num_examples`` of a run, or of each run that ``keys`` name.

    ``rows`` are the examples of the run. Of several backends the first in order is named;
    without examples the backend is null and the number 0.
    """
    return rows.groupBy(*keys).agg(F.min(backend).alias("backend"), F.count(F.lit(1)).alias("num_examples"))


def comparison_summary(
    comparison: DataFrame, baseline: DataFrame | None = None, finetuned: DataFrame | None = None
) -> DataFrame:
    """Counts and the signed mean of the deltas; backends and sizes of both runs.

    ``baseline`` and ``finetuned`` are one row each of :func:`run_metadata`. A run without
    one has nulls.
    """
    mean = F.coalesce(exact_mean(F.col("absolute_delta")), F.lit(0.0))
    counts = comparison.agg(
        F.count(F.lit(1)).alias("metrics_compared"),
        F.count_if(F.col("absolute_delta") > 0).alias("metrics_improved"),
        F.count_if(F.col("absolute_delta") < 0).alias("metrics_regressed"),
        round_half_even(mean, 4).alias("mean_absolute_delta"),
    )
    # one row on every side: an aggregate without keys never has more
    for side, run in (("baseline", baseline), ("finetuned", finetuned)):
        names = f"{side}_backend", f"num_examples_{side}"
        if run is None:
            counts = counts.withColumns({names[0]: F.lit(None).cast("string"), names[1]: F.lit(None).cast("long")})
        else:
            one = run.agg(F.min("backend").alias(names[0]), F.sum("num_examples").alias(names[1]))
            counts = counts.join(one, F.lit(True))
    return counts.select(
        "metrics_compared", "metrics_improved", "metrics_regressed", "mean_absolute_delta",
        "baseline_backend", "finetuned_backend", "num_examples_baseline", "num_examples_finetuned",
    )


def row_improvement(baseline: Column, finetuned: Column) -> Column:
    """Per metric of either map: difference to 4 decimals, a missing side counting zero."""
    return F.map_zip_with(
        baseline,
        finetuned,
        lambda _, b, f: round_half_even(finite_or_zero(f) - finite_or_zero(b), 4),
    )


def prediction_join(
    baseline: DataFrame, finetuned: DataFrame, order: str, max_examples: int | None = None
) -> DataFrame:
    """Pairs of prediction rows with equal ids, in the order of the baseline rows.

    Both sides have (id, ``order``, prediction, metrics). Of several fine-tuned rows
    with one id the last counts, found by an aggregate that combines map-side; null
    ids match null ids. Further baseline columns are carried along.
    """
    last = finetuned.groupBy(F.col("id").alias("_fid")).agg(
        F.max_by(
            F.struct(F.col("prediction").alias("p"), F.col("metrics").alias("m")), order
        ).alias("_f")
    )
    joined = baseline.join(last, F.col("id").eqNullSafe(F.col("_fid")))
    out = joined.select(
        *[c for c in baseline.columns if c not in ("prediction", "metrics")],
        F.col("prediction").alias("baseline_prediction"),
        F.col("_f.p").alias("finetuned_prediction"),
        F.col("metrics").alias("baseline_metrics"),
        F.col("_f.m").alias("finetuned_metrics"),
        row_improvement(F.col("metrics"), F.col("_f.m")).alias("improvement_summary"),
    )
    return out if max_examples is None else out.orderBy(order).limit(max_examples)


def _by_metric(pairs: DataFrame, metric: str) -> DataFrame:
    scored = pairs.withColumn("delta", F.try_element_at("improvement_summary", F.lit(metric)))
    return scored.where(F.col("delta").isNotNull())


def best_improvements(pairs: DataFrame, order: str, metric: str = "token_f1", limit: int = 5) -> DataFrame:
    """Rows with the largest delta of a metric; equal deltas keep their order."""
    return _by_metric(pairs, metric).orderBy(F.col("delta").desc(), order).limit(limit)


def worst_regressions(pairs: DataFrame, order: str, metric: str = "token_f1", limit: int = 5) -> DataFrame:
    """The ``limit`` smallest deltas, of which only negative ones are kept."""
    return _by_metric(pairs, metric).orderBy("delta", order).limit(limit).where("delta < 0")
