"""Leakage-safe splits and the profile of a split dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.functions import text as tx
from filingloom.functions.numbers import round_half_even
from filingloom.operators.examples import company_of
from filingloom.operators.ranking import ordered_index, with_ordered_buckets
from filingloom.session import cut_lineage, join_null_safe

PAIRS = (("train", "test"), ("train", "validation"), ("validation", "test"))


def company_key(ticker: Column, cik: Column) -> Column:
    return F.upper(company_of(ticker, cik))


def year_key(year: Column) -> Column:
    return tx.text_or_empty(year.cast("string"))


def allocation(
    n: Column, validation_ratio: float, test_ratio: float, keep_train: bool = False
) -> tuple[Column, Column]:
    """Number of test and validation groups among ``n`` groups.

    Each gets its rounded share, one at least; validation shrinks before test so
    that one group is left for train. Two groups leave train empty unless
    ``keep_train`` is set; a single group goes to train.
    """
    one = F.lit(1).cast("long")
    test = F.greatest(one, F.rint(n * F.lit(test_ratio)).cast("long"))
    validation = F.greatest(one, F.rint(n * F.lit(validation_ratio)).cast("long"))
    validation = F.greatest(one, F.least(validation, n - 1 - test))
    test = F.greatest(one, F.least(test, n - 1 - validation))
    none = F.lit(0).cast("long")
    if keep_train:
        validation = F.when(n == 2, none).otherwise(validation)
    return F.when(n <= 1, none).otherwise(test), F.when(n <= 1, none).otherwise(validation)


def assign_groups(
    keys: DataFrame,
    key: str,
    strategy: str = "company_holdout",
    seed: int = 42,
    validation_ratio: float = 0.10,
    test_ratio: float = 0.05,
    keep_train: bool = False,
) -> DataFrame:
    """Split of every distinct group key.

    ``company_holdout`` orders the keys by a seeded hash, ``time_holdout`` newest
    first; the leading keys become test, the next validation.
    """
    distinct = keys.select(key).distinct()
    if strategy == "company_holdout":
        hashed = F.md5(F.concat(F.coalesce(F.col(key), F.lit("")), F.lit(f"|{seed}")))
        distinct = distinct.withColumn("_order", hashed)
        # hash order is uniform, so its leading digits are even, ordered buckets
        bucket = F.conv(F.substring("_order", 1, 3), 16, 10).cast("int")
        order = [F.col("_order"), F.col(key)]
    elif strategy == "time_holdout":
        # any key may be one of time: ranges of it are ordered buckets, newest first
        order = [F.col(key).desc()]
        distinct = with_ordered_buckets(distinct, order, "_range")
        bucket = F.col("_range")
    else:
        raise ValueError(f"no such split strategy: {strategy}")
    ranked = ordered_index(distinct, [], order, bucket, "_rn", total="_groups")
    n_test, n_val = allocation(F.col("_groups"), validation_ratio, test_ratio, keep_train)
    return ranked.select(
        key,
        F.when(F.col("_rn") <= n_test, "test")
        .when(F.col("_rn") <= n_test + n_val, "validation")
        .otherwise("train")
        .alias("split"),
    )


def split_examples(
    examples: DataFrame,
    key: Column,
    strategy: str = "company_holdout",
    groups: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Adds ``split``; all rows with one key get the same one.

    Only distinct keys are ranked. ``groups`` may give the keys (its one column)
    where they can be had without building the examples twice. Their assignment is written to the shared
    folder first: the planner then knows its true size and broadcasts it when it
    is below the session's threshold, so example texts are normally not shuffled.
    """
    keyed = examples.withColumn("_key", key)
    keys = keyed if groups is None else groups.toDF("_key")
    assigned = cut_lineage(assign_groups(keys, "_key", strategy, **options), "split-keys")
    return join_null_safe(keyed, assigned.withColumnRenamed(assigned.columns[0], "_key"), ["_key"]).drop("_key")


def leakage_overlaps(examples: DataFrame, key: Column) -> DataFrame:
    """One row per split pair and group key found on both sides."""
    held = (
        examples.groupBy(key.alias("group_key"))
        .agg(*[F.max((F.col("split") == s).cast("int")).alias(s) for s in ("train", "validation", "test")])
    )
    shared = F.filter(
        F.array(
            *[
                F.when((F.col(a) == 1) & (F.col(b) == 1), F.lit(f"{a}_{b}"))
                for a, b in PAIRS
            ]
        ),
        lambda p: p.isNotNull(),
    )
    return held.select(F.explode(shared).alias("pair"), "group_key")


def leakage_check(examples: DataFrame, key: Column) -> DataFrame:
    """Overlap counts per pair; passed when train and test share no key."""
    counted = leakage_overlaps(examples, key).agg(
        *[
            F.count_if(F.col("pair") == f"{a}_{b}").alias(f"{a}_{b}_overlap")
            for a, b in PAIRS
        ]
    )
    return counted.withColumn("passed", F.col("train_test_overlap") == 0)


def dataset_stats(examples: DataFrame) -> DataFrame:
    """Counts and length figures overall, per split, per task and per section."""
    lengths = examples.select(
        "split",
        "task_type",
        "section",
        F.length("input").alias("n_in"),
        F.length("output").alias("n_out"),
    )
    sets = [[F.col("split")], [F.col("task_type")], [F.col("section")], []]
    grouped = lengths.groupingSets(sets, "split", "task_type", "section").agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("examples"),
        F.avg("n_in").alias("mean_in"),
        F.avg("n_out").alias("mean_out"),
        F.min("n_in").cast("long").alias("min_input_length"),
        F.max("n_in").cast("long").alias("max_input_length"),
    )
    gid = F.col("gid")
    scope = (
        F.when(gid == 3, "split").when(gid == 5, "task_type").when(gid == 6, "section").otherwise("total")
    )
    name = F.when(gid == 3, F.col("split")).when(gid == 5, F.col("task_type")).when(
        gid == 6, F.col("section")
    ).otherwise("all")
    zero = F.lit(0)
    figures = grouped.select(
        scope.alias("scope"),
        name.alias("name"),
        "examples",
        F.coalesce(round_half_even(F.col("mean_in"), 2), zero).alias("average_input_length"),
        F.coalesce(round_half_even(F.col("mean_out"), 2), zero).alias("average_output_length"),
        F.coalesce("min_input_length", zero).alias("min_input_length"),
        F.coalesce("max_input_length", zero).alias("max_input_length"),
    )
    # an empty dataset still has a total: a zero row that loses against a real one
    values = [c for c in figures.columns if c not in ("scope", "name")]
    nothing = examples.sparkSession.range(1).select(
        F.lit("total").alias("scope"), F.lit("all").alias("name"), *[F.lit(0).alias(c) for c in values]
    )
    return figures.unionByName(nothing).groupBy("scope", "name").agg(
        *[F.max(c).alias(c) for c in values]
    )


def split_members(examples: DataFrame, kinds: Sequence[str] = ("company", "cik", "year")) -> DataFrame:
    """Distinct non-empty companies, CIKs and years per split, one row each.

    The lists can be as long as the company register, so they stay rows.
    """
    values = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds])
    return (
        examples.select("split", *kinds)
        .distinct()
        .select("split", F.explode(values).alias("v"))
        .select("split", "v.*")
        .where(F.col("value") != "")
        .distinct()
    )


def split_profile(examples: DataFrame) -> DataFrame:
    """Per split: rows, distinct companies and CIKs, first and last year."""
    year = F.nullif(F.col("year"), F.lit(""))
    # one row per (split, company, cik) first: hot companies collapse map-side
    combos = examples.groupBy("split", "company", "cik").agg(
        F.count(F.lit(1)).alias("n"), F.min(year).alias("lo"), F.max(year).alias("hi")
    )
    return combos.groupBy("split").agg(
        F.sum("n").alias("examples"),
        F.count_distinct("company").alias("unique_tickers"),
        F.count_distinct(F.nullif(F.col("cik"), F.lit(""))).alias("unique_ciks"),
        F.min("lo").alias("first_year"),
        F.max("hi").alias("last_year"),
    )
