"""Exact decimal rounding and number formatting.

Decimal rounding here is half-to-even on the exact binary value of the double
(0.125 -> 0.12, 2.675 -> 2.67), the IEEE meaning of "round to n decimals". Spark's own
``round`` and ``bround`` look at the shortest decimal text of the double
instead and give 2.68. The exact product with a power of ten is obtained by
splitting the double in two halves, so no Python worker is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filingloom.functions.text import let

_SPLITTER = 134217729.0  # 2**27 + 1


def round_half_even(x: Column, digits: int) -> Column:
    doubled = float(2 * 10**digits)

    def rounded(v: Column) -> Column:
        # v = hi + (v - hi), two halves whose products with a small integer are exact
        scaled = v * F.lit(_SPLITTER)
        hi = scaled - (scaled - v)
        product = v * F.lit(doubled)
        error = (hi * F.lit(doubled) - product) + (v - hi) * F.lit(doubled)
        lower = F.floor(product / 2.0).cast("double")
        above_middle = (product - (lower * 2.0 + 1.0)) + error
        up = (above_middle > 0.0) | ((above_middle == 0.0) & ((lower % 2.0) != 0.0))
        near = F.when(up, lower + 1.0).otherwise(lower) / F.lit(doubled / 2.0)
        # larger values, NaN and infinities have no decimals to round
        return F.when(F.abs(v) < 2.0**51 / doubled, near).otherwise(v)

    return let(x.cast("double"), rounded)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def finite_or_zero(x: Column) -> Column:
    """Null, text, NaN and infinities become 0.0."""
    return let(x.try_cast("double"), lambda v: F.when(is_finite(v), v).otherwise(F.lit(0.0)))


def exact_mean(x: Column) -> Column:
    """Mean that does not depend on how rows are spread over tasks.

    Summing doubles in a different order changes the last bits; summing fixed
    12-decimal numbers does not. Values beyond their range (1e14, infinities, NaN)
    fall back to the plain mean.
    """
    fixed = x.try_cast("decimal(26,12)")
    return F.when(
        F.count(fixed) == F.count(x), F.sum(fixed).cast("double") / F.count(x)
    ).otherwise(F.avg(x))


def format_fixed(x: Column, decimals: int = 3) -> Column:
    """Fixed decimals, or ``N/A`` for null and non-finite values."""
    rounded = round_half_even(x, decimals)
    minus = F.when((x < 0) & (rounded == 0), F.lit("-")).otherwise(F.lit(""))
    return F.when(
        is_finite(x), F.concat(minus, F.format_string(f"%.{decimals}f", rounded))
    ).otherwise(F.lit("N/A"))


def format_signed(x: Column, decimals: int = 3) -> Column:
    """As :func:`format_fixed`, with a plus sign for values that are not negative."""
    sign = F.when(x >= 0, F.lit("+")).otherwise(F.lit(""))
    return F.when(is_finite(x), F.concat(sign, format_fixed(x, decimals))).otherwise(F.lit("N/A"))
