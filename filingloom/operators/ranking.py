"""Ranks and order statistics that never sort a whole group in one task.

One key may own a third of all rows, so a plain ``row_number`` over that key,
or over no key at all, would send those rows to a single task. The helpers
below cut each group into ordered buckets, count the buckets (a partial
aggregate), and rank inside buckets only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingloom.session import cut_lineage, join_null_safe


def ordered_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    name: str = "rn",
    total: str | None = None,
) -> DataFrame:
    """Exact 1-based row number within ``keys`` by ``order``; ``total`` adds the group size.

    ``bucket`` must follow the order (a row in a lower bucket comes before every
    row in a higher one) and have a bounded number of values per key; the window
    over bucket counts is then small whatever the data size. Null keys are a group
    of their own, a null bucket comes first.
    """
    keys = list(keys)
    marked = df.withColumn("_bucket", bucket)
    counts = marked.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias(total or "_total"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = marked.withColumn("_pos", F.row_number().over(inside))
    return (
        join_null_safe(ranked, offsets, [*keys, "_bucket"])
        .withColumn(name, (F.col("_offset") + F.col("_pos")).cast("long"))
        .select(*df.columns, name, *([total] if total else []))
    )


def with_ordered_buckets(df: DataFrame, order: Sequence[Column], name: str, buckets: int | None = None) -> DataFrame:
    """Adds an ascending bucket number for any order, for :func:`ordered_index`.

    Ranges are sampled by Spark's range partitioning, ``buckets`` of them or as many as the
    session shuffles into. The rows are written to the shared folder, so that the numbers
    stay what they are however often the result is read.
    """
    ranged = df.repartitionByRange(*([buckets] if buckets else []), *order)
    return cut_lineage(ranged.withColumn(name, F.spark_partition_id()), "buckets")


# beyond this Spark does not limit groups before the shuffle
GROUP_LIMIT_SETTING = "spark.sql.optimizer.windowGroupLimitThreshold"


def newest_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salts: int = 64
) -> DataFrame:
    """First ``n`` rows of each group.

    Filtering ``row_number() <= n`` lets Spark keep only ``n`` rows per group in
    each map task before the shuffle (WindowGroupLimit), so a hot group costs
    ``n`` rows per task, not all of its rows. For large ``n``, where Spark does
    not do that, each group is first cut down within ``salts`` random-like parts.
    """

    def leading(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        numbered = rows.withColumn("_rn", F.row_number().over(w))
        return numbered.where(F.col("_rn") <= n).drop("_rn")

    if n > int(df.sparkSession.conf.get(GROUP_LIMIT_SETTING, "1000")):
        plain = [f.name for f in df.schema.fields if f.dataType.typeName() != "map"]
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)))
        df = leading(salted, [*keys, "_salt"]).drop("_salt")
    return leading(df, keys)


def rank_values(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: DataFrame,
    rank: str = "rank",
    small: int = 100_000,
    cells: int = 4096,
    weight: str | None = None,
) -> DataFrame:
    """Value at given 1-based ranks of the ascending order, exactly.

    With ``weight`` a row stands for that many equal values.

    ``ranks`` has one row per wanted (keys, rank) and any further columns; the
    result adds ``value`` and ``below`` (rows smaller than that value). While a
    range that holds a rank has more than ``small`` rows, it is cut into ``cells``
    equal cells, the cells are counted, and the one with the rank is kept, narrowed
    to the values found in it. The last step counts equal values inside the final
    ranges. Ties and hot keys only change counts. Values keep their type: whole numbers
    are told apart beyond 2^53. Null keys are a group of their own.

    The table of open ranks is written out between levels. Its real size is then
    known to the planner, which broadcasts it below the session's threshold (so
    the data is scanned, not shuffled) and shuffles otherwise.
    """
    keys = list(keys)
    times = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    base = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), times.alias("_w"))
    whole = not isinstance(base.schema["_v"].dataType, (T.DoubleType, T.FloatType))
    cell_of = _whole_cell if whole else _cell
    span = base.groupBy(*keys).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_w").alias("_size")
    )
    todo = join_null_safe(ranks.withColumn("_id", F.col(rank)), span, keys)
    todo = cut_lineage(todo.withColumn("_below", F.lit(0).cast("long")), "ranks")
    apart = F.col("_lo") < F.col("_hi") if whole else _clip(F.col("_lo")) < _clip(F.col("_hi"))
    open_range = (F.col("_size") > small) & apart
    while not todo.where(open_range).isEmpty():
        cell = cell_of(F.col("_v"), F.col("_lo"), F.col("_hi"), cells)
        todo = cut_lineage(_containing_step(base, todo, keys, rank, cell), "ranks")
    hit = _containing_step(base, todo, keys, rank, F.col("_v"))
    return hit.select(
        *ranks.columns, F.col("_lo").alias("value"), F.col("_below").alias("below")
    )


_LARGEST = 1.7976931348623157e308


def _clip(v: Column) -> Column:
    """Infinities and NaN (which Spark orders last) as the largest finite values."""
    return F.greatest(F.least(v, F.lit(_LARGEST)), F.lit(-_LARGEST))


def _cell(v: Column, lo: Column, hi: Column, cells: int) -> Column:
    v, lo, hi = _clip(v), _clip(lo), _clip(hi)
    # the width of a range of huge values may overflow; halves of huge values are exact
    share = F.when(hi - lo <= _LARGEST, (v - lo) / (hi - lo)).otherwise(
        (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    )
    return F.when(
        hi > lo, F.least(F.floor(share * cells).cast("int"), F.lit(cells - 1))
    ).otherwise(F.lit(0))


def _whole_cell(v: Column, lo: Column, hi: Column, cells: int) -> Column:
    """Cells of whole numbers by exact differences; both ends of a range fall into different cells."""
    v, lo, hi = (c.cast("decimal(20,0)") for c in (v, lo, hi))
    share = (v - lo).cast("double") / (hi - lo).cast("double")
    return F.when(
        hi > lo, F.least(F.floor(share * cells).cast("int"), F.lit(cells - 1))
    ).otherwise(F.lit(0))


def _containing_step(
    base: DataFrame, todo: DataFrame, keys: Sequence[str], rank: str, step: Column
) -> DataFrame:
    """Count rows per ``step`` inside the open range and keep the step holding the rank."""
    ids = [*keys, "_id"]
    counts = (
        join_null_safe(base, todo.select(*ids, "_lo", "_hi"), keys)
        .where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        .withColumn("_step", step)
        .groupBy(*ids, "_step")
        .agg(
            F.sum("_w").alias("_n"),
            F.min("_v").alias("_step_lo"),
            F.max("_v").alias("_step_hi"),
        )
    )
    upto = Window.partitionBy(*ids).orderBy("_step")
    running = counts.withColumn("_upto", F.sum("_n").over(upto))
    kept = [c for c in todo.columns if c not in ("_lo", "_hi", "_size", "_below")]
    last = F.col("_below") + F.col("_upto")
    return (
        join_null_safe(running, todo.drop("_lo", "_hi", "_size"), ids)
        .where((last >= F.col(rank)) & (last - F.col("_n") < F.col(rank)))
        .select(
            *kept,
            F.col("_step_lo").alias("_lo"),
            F.col("_step_hi").alias("_hi"),
            F.col("_n").alias("_size"),
            (last - F.col("_n")).alias("_below"),
        )
    )
