"""Overlapping word windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.functions import text as tx


def check_window(max_tokens: int, overlap: int, min_tokens: int) -> None:
    if max_tokens <= 0:
        raise ValueError(f"max_tokens must be above 0, not {max_tokens}")
    if not 0 <= overlap < max_tokens:
        raise ValueError(f"overlap must lie in [0, {max_tokens}), not {overlap}")
    if min_tokens < 0:
        raise ValueError(f"min_tokens must not be below 0, but is {min_tokens}")


def chunk_array(
    text: Column, max_tokens: int = 512, overlap: int = 64, min_tokens: int = 80
) -> Column:
    """Kept windows of one text as an array of structs.

    Only the last window can be shorter than ``max_tokens``, so the number of
    kept windows has a closed form and nothing is generated to be thrown away.
    """
    check_window(max_tokens, overlap, min_tokens)
    stride = max_tokens - overlap

    def windows(t: Column) -> Column:
        n = F.size(t)
        steps = F.ceil((n - max_tokens) / F.lit(stride)).cast("int")
        count = F.when(n <= max_tokens, F.lit(1)).otherwise(steps + 1)
        last_size = n - (count - 1) * stride
        if max_tokens < min_tokens:
            kept = F.lit(1)
        else:
            kept = F.when((count > 1) & (last_size < min_tokens), count - 1).otherwise(count)

        def window(i: Column) -> Column:
            start = i * stride
            end = F.least(start + max_tokens, n)
            return F.struct(
                i.cast("long").alias("chunk_id"),
                F.array_join(F.slice(t, start + 1, end - start), " ").alias("text"),
                (end - start).cast("long").alias("token_count"),
                start.cast("long").alias("start_token"),
                end.cast("long").alias("end_token"),
            )

        # an empty text has no window; greatest() keeps the sequence ascending for it
        some = F.transform(F.sequence(F.lit(0), F.greatest(kept, F.lit(1)) - 1), window)
        return F.when(n > 0, some).otherwise(F.slice(some, 1, 0))

    return tx.let(tx.words(tx.text_or_empty(text)), windows)


def chunk_windows(
    df: DataFrame,
    text: str = "text",
    keep: Sequence[str] | None = None,
    max_tokens: int = 512,
    overlap: int = 64,
    min_tokens: int = 80,
) -> DataFrame:
    """One row per kept window; ``keep`` names the columns carried along.

    Windows are cut inside the row before the explode, so the word list of a
    long text is never copied once per window.
    """
    carried = [c for c in (keep if keep is not None else df.columns) if c != text]
    chunks = chunk_array(F.col(text), max_tokens, overlap, min_tokens)
    return df.select(*carried, F.inline(chunks))
