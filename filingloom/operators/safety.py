"""Corpus safety scans: secrets, paths, required and forbidden markers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom import constants as C
from filingloom.functions import text as tx


def looks_like_secret(value: Column) -> Column:
    """Whether an assigned value is a literal credential.

    Short values, placeholders, code or environment references and all-caps
    tokens are not; the rest must mix letters and digits or be long.
    """

    def decide(v: Column) -> Column:
        low = F.lower(v)
        token = (F.upper(v) == v) & F.contains(v, F.lit("_")) & ~F.regexp_like(v, F.lit(r"\p{Nd}"))
        reference = (
            F.contains(v, F.lit("."))
            | F.contains(low, F.lit("env"))
            | F.contains(low, F.lit("process"))
            | v.startswith("$")
            | token
        )
        mixed = F.regexp_like(v, F.lit(r"\p{L}")) & F.regexp_like(v, F.lit(r"\p{Nd}"))
        return (
            (F.length(v) >= 8)
            & ~tx.contains_any(low, C.PLACEHOLDER_HINTS)
            & ~reference
            & (mixed | (F.length(v) >= 24))
        )

    bare = tx.strip(F.trim(tx.strip(value), F.lit("\"'")))
    return tx.let(bare, decide)


def secret_scan(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """One row per suspected secret: (keys, position, key name). Values are not kept."""
    pattern = "(?U)" + C.SECRET_ASSIGNMENT
    # the name test is a plain substring search; the pattern runs on hits only
    candidates = df.where(tx.contains_any(F.col(text), C.SECRET_KEYS))
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("name"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("value"),
    )
    return (
        candidates.select(*keys, F.posexplode(found).alias("pos", "hit"))
        .where(looks_like_secret(F.col("hit.value")))
        .select(*keys, F.col("pos").cast("long").alias("pos"), F.col("hit.name").alias("key_name"))
    )


def scannable(
    path: Column,
    suffixes: Sequence[str] = C.SECRET_SCAN_SUFFIXES,
    test_folder: str = "tests",
    example_suffix: str = ".env.example",
    own_names: Sequence[str] = (),
) -> Column:
    """Whether a relative path is to be scanned for secrets: code or configuration, not prose.

    The last suffix of the name decides, in any case; a name that only starts with a dot has
    none. Files in a test folder, example settings and ``own_names`` are left out.
    """
    parts = F.split(F.coalesce(path, F.lit("")), "/")
    name = F.element_at(parts, -1)
    suffix = F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))
    kept = suffix.isin(*suffixes) & ~F.array_contains(parts, test_folder) & ~name.endswith(example_suffix)
    return kept & ~name.isin(*own_names) if own_names else kept


def secret_scan_files(df: DataFrame, path: str, text: str, **rules) -> DataFrame:
    """Suspected secrets (path, position, key name) of the files that are to be scanned."""
    return secret_scan(df.where(scannable(F.col(path), **rules)), [path], text)


def path_policy(
    path: Column,
    weight_suffixes: Sequence[str] = C.WEIGHT_SUFFIXES,
    env_files: Sequence[str] = (".env", "frontend/.env.local"),
    checkpoint_root: str = "checkpoints",
    data_prefixes: Sequence[str] = ("data/raw/", "data/processed/"),
    keep: str = ".gitkeep",
) -> Column:
    """Broken storage rules of a relative path, as an array of names."""
    low = F.lower(path)
    name = F.substring_index(path, "/", -1)
    weights = F.lit(False)
    for suffix in weight_suffixes:
        # a name that consists of the suffix alone has no suffix
        weights = weights | (low.endswith(suffix) & (F.lower(name) != suffix))
    raw = F.lit(False)
    for prefix in data_prefixes:
        raw = raw | path.startswith(prefix)
    in_checkpoints = (F.substring_index(path, "/", 1) == checkpoint_root) & (path != "")
    rules = (
        (path.isin(*env_files), "env_file"),
        (weights, "model_weights"),
        (in_checkpoints & (name != keep), "checkpoint_file"),
        (raw & (name != keep), "raw_data"),
    )
    return F.filter(
        F.array(*[F.when(hit, F.lit(rule)) for hit, rule in rules]), lambda r: r.isNotNull()
    )


def path_policy_scan(df: DataFrame, path: str, keys: Sequence[str] = (), **policy) -> DataFrame:
    """One row per (path, broken rule)."""
    return df.select(*keys, path, F.explode(path_policy(F.col(path), **policy)).alias("rule"))


def path_policy_counts(df: DataFrame, path: str, **policy) -> DataFrame:
    return path_policy_scan(df, path, **policy).groupBy("rule").agg(
        F.count(F.lit(1)).alias("paths")
    )


def required_marker_audit(
    df: DataFrame,
    text: str,
    required: Sequence[str],
    forbidden: Sequence[str] = (),
    flagged: str | None = None,
    label: str | None = None,
) -> DataFrame:
    """Adds ``missing_markers``, ``forbidden_markers``, ``label_missing`` and ``passed``."""
    body = F.col(text)

    def listed(names: Sequence[str], present: bool) -> Column:
        hits = [
            F.when(F.contains(body, F.lit(n)) == F.lit(present), F.lit(n)) for n in names
        ]
        if not hits:
            return F.array().cast("array<string>")
        return F.filter(F.array(*hits), lambda n: n.isNotNull())

    unlabelled = F.lit(False)
    if flagged and label:
        unlabelled = F.coalesce(F.col(flagged), F.lit(False)) & ~F.contains(body, F.lit(label))
    return df.withColumns(
        {
            "missing_markers": listed(required, False),
            "forbidden_markers": listed(forbidden, True),
            "label_missing": unlabelled,
        }
    ).withColumn(
        "passed",
        (F.size("missing_markers") == 0)
        & (F.size("forbidden_markers") == 0)
        & ~F.col("label_missing")
        & ~tx.is_blank(body),
    )


@dataclass(frozen=True)
class MarkerRule:
    """What a document must (or must not) say, in one of several ways.

    ``texts`` are found as they are, ``patterns`` as regular expressions, both in any case
    unless ``any_case`` is false. A rule that is not ``required`` forbids what it names.
    Where ``only_if`` names a boolean column, the rule counts for the rows that have it set.
    """

    name: str
    texts: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    any_case: bool = True
    required: bool = True
    only_if: str | None = None

    def said(self, body: Column) -> Column:
        low = F.lower(body) if self.any_case else body
        found = [F.contains(low, F.lit(t.lower() if self.any_case else t)) for t in self.texts]
        # classes know all letters, and only a newline ends a line
        flags = "(?Udiu)" if self.any_case else "(?Ud)"
        found += [F.regexp_like(low, F.lit(flags + p)) for p in self.patterns]
        if not found:
            raise ValueError(f"rule {self.name} names no text and no pattern")
        said = found[0]
        for further in found[1:]:
            said = said | further
        return said

    def broken(self, body: Column) -> Column:
        wrong = ~self.said(body) if self.required else self.said(body)
        if self.only_if:
            wrong = wrong & F.coalesce(F.col(self.only_if), F.lit(False))
        return F.when(wrong, F.lit(self.name))


def marker_rules_audit(df: DataFrame, text: str, rules: Sequence[MarkerRule]) -> DataFrame:
    """Adds ``broken_rules``, the names of the rules a text breaks, and ``passed``.

    A null or blank text breaks every required rule that counts for it and does not pass.
    """
    body = tx.text_or_empty(F.col(text))
    broken = F.filter(F.array(*[r.broken(body) for r in rules]), lambda n: n.isNotNull())
    marked = df.withColumn("broken_rules", broken if rules else F.array().cast("array<string>"))
    return marked.withColumn("passed", (F.size("broken_rules") == 0) & ~tx.is_blank(body))
