"""Evaluation rows: predictions, per-row metrics and the long metric table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingloom import constants as C
from filingloom.functions import labels as lb
from filingloom.functions import scores as sc
from filingloom.functions import text as tx
from filingloom.session import ship_package

PREVIEW_CHARS = 200


def with_baseline_prediction(df: DataFrame, extended: bool = False) -> DataFrame:
    return df.withColumn(
        "prediction", lb.baseline_answer(F.col("task_type"), F.col("input"), extended)
    )


def predict_batches(
    df: DataFrame, predictor: Callable[[pd.DataFrame], Sequence[str]], columns: Sequence[str]
) -> DataFrame:
    """Predictions by a caller's batch predictor over Arrow batches, then cleaned.

    ``predictor`` gets a frame with ``columns`` and returns one text per row.
    """
    ship_package(df.sparkSession)
    kept = df.columns
    wanted = list(columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(_raw=list(predictor(frame[wanted])))

    schema = T.StructType([*df.schema.fields, T.StructField("_raw", T.StringType())])
    out = df.mapInPandas(run, schema)
    return out.select(*kept, lb.clean_prediction(F.col("_raw")).alias("prediction"))


def task_metric_names(
    task: Column,
    mapping: Mapping[str, Sequence[str]] = C.TASK_METRICS,
    default: Sequence[str] = C.DEFAULT_METRICS,
) -> Column:
    """Metric names of a task; the table has one entry per task type."""
    out = F.array(*[F.lit(m) for m in default])
    for name, metrics in mapping.items():
        out = F.when(task == name, F.array(*[F.lit(m) for m in metrics])).otherwise(out)
    return out


def score_examples(
    df: DataFrame,
    mapping: Mapping[str, Sequence[str]] = C.TASK_METRICS,
    default: Sequence[str] = C.DEFAULT_METRICS,
    scorer: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Adds ``metrics``, a map with the metrics of the row's task.

    Needs task_type, input, output (the reference) and prediction. A metric that
    cannot be computed counts 0.0. Each branch runs only for the rows whose task
    asks for it; texts reach a Python worker only for ROUGE-L.
    """
    names = task_metric_names(F.coalesce("task_type", F.lit("")), mapping, default)
    df = df.withColumn("_names", names)
    pred, ref, src = (tx.text_or_empty(F.col(c)) for c in ("prediction", "output", "input"))

    def asked(name: str) -> Column:
        return F.array_contains("_names", name)

    def entry(name: str, value: Column) -> Column:
        return F.struct(
            F.lit(name).alias("key"), F.coalesce(value, F.lit(0.0)).alias("value")
        )

    def one(name: str, value: Column) -> Column:
        return F.when(asked(name), F.array(entry(name, value)))

    staged = df.withColumns(
        {
            "_rouge": sc.rouge_l(pred, ref, needed=asked("rouge_l")),
            "_numeric": F.when(asked("numeric_match"), sc.numeric_match(pred, ref)),
        }
    )
    numeric = F.when(
        asked("numeric_match"),
        F.array(
            *[
                entry(n, F.col("_numeric")[n])
                for n in ("numeric_exact_match", "numeric_precision", "numeric_recall")
            ]
        ),
    )
    if scorer is None:
        faithful = one("lexical_faithfulness", sc.lexical_faithfulness(pred, src))
    else:
        value = sc.scored_faithfulness(pred, src, scorer)
        faithful = F.when(
            asked("lexical_faithfulness"), F.array(entry("nli_faithfulness", value))
        )
    groups = F.array(
        one("exact_match", sc.exact_match(pred, ref)),
        one("token_f1", sc.token_f1(pred, ref)),
        one("rouge_l", F.col("_rouge")),
        numeric,
        one("classification_accuracy", sc.classification_accuracy(pred, ref)),
        faithful,
    )
    entries = F.flatten(F.filter(groups, lambda g: g.isNotNull()))
    return staged.withColumn("metrics", F.map_from_entries(entries)).select(*df.columns, "metrics").drop(
        "_names"
    )


def eval_rows(df: DataFrame, order: str) -> DataFrame:
    """Result rows: preview, defaults for missing ids and tasks.

    A missing id is numbered from ``order``, a 1-based position column: numbers that
    followed the layout of the data would pair wrong rows when two runs are joined.
    """
    number = F.col(order)
    return df.withColumns(
        {
            "id": F.coalesce("id", F.concat(F.lit("example-"), number.cast("string"))),
            "task_type": F.coalesce("task_type", F.lit("unknown")),
            "input_preview": F.substring(tx.text_or_empty(F.col("input")), 1, PREVIEW_CHARS),
            "reference": tx.text_or_empty(F.col("output")),
        }
    )


def metrics_long(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (row, metric).

    Spark puts a filter on the size of an exploded map below the projection that makes it,
    which would score every row twice; the outer form has none, and its rows of empty maps
    are dropped behind it.
    """
    return rows.select(*keys, F.explode_outer("metrics").alias("metric", "value")).where(F.col("metric").isNotNull())
