"""The corpus pipeline: five stages over documents, each on what its predecessor kept.

Language identification drops what has no language, line deduplication drops lines that
many documents share, the shingle join keeps one document of each group, mixing draws the
sources to their weights, packing lays the rest out in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.llm import language, lines, mixing, ngram_join, packing
from filingloom.llm.common import fresh, staged
from filingloom.llm.queries import DOMAIN_WEIGHTS, domain_of
from filingloom.session import load

#: share of the tokens that the mix keeps; None: as many as let the weights of the domains hold
MIX_SHARE = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; the others go."""
    return language.keep_identified(docs, language.learn(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share."""
    return lines.without_frequent_lines(docs, chars_col="n_chars")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group; documents without words stay.

    Of several rows with that id one stays, that with the greatest text.
    """
    found = ngram_join.similar_documents(docs)
    own, rows, row = fresh(docs.columns, "first", "rows", "row")
    first = found.groupBy(F.col("doc_id").alias(own)).agg(
        F.min("component_id").alias("component"), F.count("*").alias(rows)
    )
    first = first.where(F.col(own).eqNullSafe(F.col("component")) | F.col("component").isNull())
    first = staged(first.select(own, rows), "near-first")
    same = docs["doc_id"].eqNullSafe(first[own])
    repeated = F.col(own).isNotNull() & (F.col(rows) > 1)
    kept = docs.join(first.where(~repeated), same, "left_semi")
    if first.where(repeated).isEmpty():
        return kept
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    again = docs.join(first.where(repeated), same, "left_semi").groupBy("doc_id")
    one = again.agg(F.max(F.struct("text", *others)).alias(row)).select("doc_id", f"{row}.*")
    return kept.unionByName(one.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's share of the budget, at most once through its documents.

    The budget is the largest at which the weights of the domains hold, so it follows from
    weights and supply; ``MIX_SHARE`` sets another.
    """
    domain = domain_of(F.col("source"))
    leaves = mixing.plan(docs, DOMAIN_WEIGHTS, domain, share=MIX_SHARE)
    epoch, = fresh(docs.columns, "mix_epoch")
    return mixing.select(docs, leaves, domain, epoch_col=epoch).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: a learned model and an order of hashes over budgets are not for SQL; see tests/llm
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
