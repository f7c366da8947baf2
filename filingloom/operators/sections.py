"""Headings, sections and section manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom import constants as C
from filingloom.functions import text as tx

#: segments whose lengths are summed one by one; whole groups of them are summed first
_GROUP = 256


def heading_segments(text: Column, pattern: str = C.ITEM_HEADING) -> Column:
    """Text cut in front of every heading; the part before the first one stays first.

    The cut is a lookahead, so no character is reserved. A space goes in front, as a text
    that opens with a heading would else have no part before it.
    """
    guarded = F.concat(F.lit(" "), tx.text_or_empty(text))
    parts = F.split(guarded, f"(?iU)(?={pattern})")
    return F.transform(parts, lambda s, i: F.when(i == 0, F.substring(s, 2, 1 << 30)).otherwise(s))


def heading_id(segment: Column, pattern: str = C.ITEM_HEADING) -> Column:
    """Lower-case id of the heading a segment starts with, e.g. ``1a``."""
    number = F.regexp_extract(segment, f"(?iU)^{pattern}", 1)
    letter = F.regexp_extract(segment, f"(?iU)^{pattern}", 2)
    return F.concat(number, F.lower(letter))


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: acc + x)


def heading_anchors(
    df: DataFrame, keys: Sequence[str], text: str, pattern: str = C.ITEM_HEADING
) -> DataFrame:
    """One row per heading: position in the document, id and character offset.

    An offset is the sum of the lengths before it: those of whole groups of segments, then
    the rest one by one.
    """
    cut = df.select(*keys, heading_segments(F.col(text), pattern).alias("_segments"))
    sized = cut.withColumn("_sizes", F.transform("_segments", lambda s: F.length(s).cast("long")))
    groups = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_sizes") - 1) / _GROUP).cast("int")),
        lambda g: _sum(F.slice(F.col("_sizes"), g * _GROUP + 1, F.lit(_GROUP))),
    )
    placed = sized.withColumn("_groups", groups).select(
        *keys,
        F.posexplode("_segments").alias("_at", "_segment"),
        "_sizes",
        "_groups",
    )
    group = F.floor(F.col("_at") / _GROUP).cast("int")
    offset = _sum(F.slice(F.col("_groups"), F.lit(1), group)) + _sum(
        F.slice(F.col("_sizes"), group * _GROUP + 1, F.col("_at") % _GROUP)
    )
    return placed.where("_at > 0").select(
        *keys,
        (F.col("_at") - 1).cast("long").alias("pos"),
        heading_id(F.col("_segment"), pattern).alias("item_id"),
        offset.alias("offset"),
    )


def _with_runs(df: DataFrame, keys: Sequence[str], text: str, pattern: str) -> DataFrame:
    """``_runs``: consecutive segments with the same heading id, joined: array of (id, body).

    A run starts where the id differs from its neighbour's; its body is one slice.
    """
    cut = df.select(*keys, heading_segments(F.col(text), pattern).alias("_segments"))
    named = cut.withColumn(
        "_ids", F.transform("_segments", lambda s, i: F.when(i > 0, heading_id(s, pattern)).otherwise(""))
    )
    places = F.transform("_ids", lambda _, i: i)
    starts = F.filter(
        places,
        lambda i: (i > 0) & ((i == 1) | (F.get(F.col("_ids"), i) != F.get(F.col("_ids"), F.greatest(i - 1, F.lit(0))))),
    )
    begun = named.withColumn("_starts", starts)

    def run(start: Column, i: Column) -> Column:
        after = F.coalesce(F.get(F.col("_starts"), i + 1), F.size("_segments"))
        body = F.array_join(F.slice(F.col("_segments"), start + 1, after - start), "")
        return F.struct(F.get(F.col("_ids"), start).alias("id"), body.alias("body"))

    return begun.select(*keys, F.transform("_starts", run).alias("_runs"))


def section_spans(
    df: DataFrame,
    keys: Sequence[str],
    text: str,
    items: Mapping[str, str] = C.SECTION_ITEMS,
    pattern: str = C.ITEM_HEADING,
) -> DataFrame:
    """All target sections in one pass: the longest body of each item, first on a tie.

    A body runs from its heading to the next heading with another id. Nested
    starts inside a run of equal ids are suffixes of the first, so only whole
    runs compete. Everything happens inside the row: no shuffle.
    """
    staged = _with_runs(df, keys, text, pattern)
    stripped = F.transform(
        F.col("_runs"),
        lambda r, i: F.struct(
            r["id"].alias("id"), tx.strip(r["body"]).alias("body"), (-i).alias("earlier")
        ),
    )
    staged = staged.select(*keys, stripped.alias("_runs"))

    def best(section: str, item: str) -> Column:
        ranked = F.transform(
            F.filter(F.col("_runs"), lambda r: r["id"] == item),
            lambda r: F.struct(
                F.length(r["body"]).alias("n"), r["earlier"].alias("e"), r["body"].alias("b")
            ),
        )
        return F.struct(
            F.lit(section).alias("section"),
            F.lit(item).alias("item"),
            F.array_max(ranked)["b"].alias("text"),
        )

    found = F.array(*[best(name, item) for name, item in items.items()])
    return (
        staged.select(*keys, F.explode(found).alias("s"))
        .select(*keys, "s.*")
        .where(F.col("text") != "")
    )


def section_manifest(
    df: DataFrame, text: str = "text", min_section_words: int = 0
) -> DataFrame:
    """Adds character and word counts; short sections are dropped."""
    out = df.withColumns(
        {"text_chars": F.length(text).cast("long"), "text_words": tx.word_count(F.col(text))}
    )
    return out.where(F.col("text_words") >= min_section_words) if min_section_words else out


def extraction_summary(
    manifest: DataFrame, targets: Sequence[str] = tuple(C.SECTION_ITEMS)
) -> DataFrame:
    """Filings, sections, section types found and missing, total words."""
    # per (filing, section) first: a second count-distinct would expand every row
    per_filing = manifest.groupBy("raw_path", "section").agg(
        F.count(F.lit(1)).alias("n"), F.sum("text_words").alias("words")
    )
    per_path = per_filing.groupBy("raw_path").agg(
        F.sum("n").alias("n"), F.sum("words").alias("words"), F.collect_set("section").alias("sections")
    )
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set("sections"))))
    total = per_path.agg(
        F.count(F.lit(1)).alias("filings"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("sections"),
        F.coalesce(F.sum("words"), F.lit(0)).alias("total_words"),
        names.alias("_names"),
    )
    return total.select(
        "filings",
        "sections",
        "total_words",
        F.size("_names").cast("long").alias("distinct_sections"),
        F.array_join("_names", ",").alias("found_sections"),
        (F.lit(len(targets)) - F.size("_names")).cast("long").alias("missing_section_types"),
    )
