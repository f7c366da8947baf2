"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.llm.common import remove, write_scratch


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every end of the edges ``a, b``; the component is its least node.

    Minima are combined before each exchange and no neighbourhood is ever gathered, so a
    hub may have any number of neighbours. Every round is written to the shared folder.
    Nulls are not nodes; loops give no row.
    """
    spark = edges.sparkSession
    ends = edges.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    now, path = write_scratch(ends.distinct(), "components")
    mark = _mark(now)
    while True:
        both = now.selectExpr("hi AS u", "lo AS v").unionAll(now.selectExpr("lo AS u", "hi AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").selectExpr("v AS hi", "m AS lo").distinct()
        parent = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(parent, "hi").where("lo != m").selectExpr("lo AS hi", "m AS lo")
        after, new_path = write_scratch(
            small.unionAll(parent.selectExpr("hi", "m AS lo")).distinct(), "components"
        )
        remove(spark, path)
        now, path, before, mark = after, new_path, mark, _mark(after)
        if mark == before:
            break
    roots = now.selectExpr("lo AS node", "lo AS component").distinct()
    return now.selectExpr("hi AS node", "lo AS component").unionAll(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first())
