"""Secret scan with linking of credentials that come in several parts.

Strong forms (assignments, access identifiers, long hexadecimal runs) are reported
wherever they stand. Weak parts (named identifiers, opaque keys, endpoints) are reported
only where their complement stands within reach: an interval join over the parts of one
text, keyed by stretches of the text so that no two parts far apart ever meet.

Everything here is column expressions and joins.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingloom.llm.common import staged

#: code points between parts of one credential at most
REACH = 300


@dataclass(frozen=True)
class Part:
    """A kind of span: its pattern, the group whose length counts and the least length."""

    kind: str
    pattern: str
    value: str | None = None
    least: int = 1

    @property
    def found(self) -> str:
        return self.pattern + (self.value or "")


# fixed values: the strong kinds in the order in which spans of one start are listed
ASSIGN = Part(
    "assign",
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""",
    r"[A-Za-z0-9+/_.=-]+",
    6,
)
ACCESS = Part("access", r"AKIA[A-Z0-9]{16,}")
HEX = Part("hex", r"[0-9a-f]{24,}")
STRONG = (ASSIGN, ACCESS, HEX)

# weak kinds, listed after the strong ones
IDENT = Part("ident", r"""(?i:(?:client|access|account|tenant)[_-]?(?:key[_-]?)?id)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9._-]+", 4)
OPAQUE = Part("opaque", r"[A-Za-z0-9+/]{32,}={0,2}")
ENDPOINT = Part("endpoint", r"""https?://[^\x20\x09-\x0D"'<>]+""")
WEAK = (IDENT, OPAQUE, ENDPOINT)

KINDS = tuple(p.kind for p in STRONG + WEAK)
#: a weak kind and the kinds one of which must stand within reach
COMPLEMENTS = {
    "ident": ("assign", "hex", "opaque"),
    "opaque": ("access", "ident"),
    "endpoint": ("assign", "access", "hex"),
}


def _lengths(text: Column, part: Part) -> Column:
    """Per match: kind, place in line, code points before it since the last, its own, its value's."""
    # \G: a match goes on where the last one ended, so the gap before it is seen only once
    whole = rf"(?s)\G(.*?)({part.pattern})({part.value or ''})"
    groups = [F.transform(F.regexp_extract_all(text, F.lit(whole), F.lit(g)), F.length) for g in (1, 2, 3)]
    zipped = F.transform(
        F.arrays_zip(*[g.alias(n) for g, n in zip(groups, ("gap", "head", "value"))]),
        lambda m, i: F.struct(
            F.lit(part.kind).alias("kind"),
            i.alias("place"),
            m["gap"].alias("gap"),
            (m["head"] + m["value"]).alias("size"),
            (m["value"] if part.value else m["head"]).alias("counted"),
        ),
    )
    none = F.array().cast("array<struct<kind:string,place:int,gap:int,size:int,counted:int>>")
    return F.when(text.rlike(part.found), zipped).otherwise(none)


def _least(kind: Column) -> Column:
    return reduce(
        lambda other, p: F.when(kind == p.kind, F.lit(p.least)).otherwise(other), STRONG + WEAK, F.lit(1)
    )


def find_parts(matches: DataFrame, key: list[str]) -> DataFrame:
    """``key, kind, start, end`` of every match that is long enough, from the matches' lengths."""
    rows = matches.withColumn("m", F.explode("matches")).select(*key, "m.*")
    upto = Window.partitionBy(*key, "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum((F.col("gap") + F.col("size")).cast("long")).over(upto))
    rows = rows.where(F.col("counted") >= _least(F.col("kind")))
    return rows.select(*key, "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def _near(parts: DataFrame, others: DataFrame, key: list[str], reach: int, fits: Column) -> DataFrame:
    """``parts`` with ``near``: whether one of ``others`` that ``fits`` is less than ``reach`` away.

    The interval join: both sides are laid out over stretches of the text, so only parts
    of the same stretch of the same text meet. Reach 0 means that they overlap.
    """
    cell = max(REACH, reach)

    def stretches(margin: int) -> Column:
        return F.explode(F.sequence(F.floor((F.col("start") - margin) / cell), F.floor((F.col("end") + margin) / cell)))

    left = parts.withColumn("cell", stretches(0)).alias("l")
    right = others.select(*key, "kind", "start", "end").withColumn("cell", stretches(reach)).alias("r")
    match = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    match += [
        F.col("l.cell") == F.col("r.cell"),
        F.col("l.start") < F.col("r.end") + reach,
        F.col("r.start") < F.col("l.end") + reach,
        fits,
    ]
    met = left.join(right, reduce(Column.__and__, match), "left")
    own = [F.col(f"l.{c}") for c in (*key, "kind", "start", "end")]
    return met.groupBy(*own).agg(F.max(F.col("r.kind").isNotNull()).alias("near"))


def link_parts(parts: DataFrame, key: list[str], reach: int = REACH) -> DataFrame:
    """Strong parts, and the weak ones whose complement stands within ``reach``.

    A weak part that overlaps a strong one says nothing new and is left out, and so is an
    opaque key inside an identifier or endpoint. The complement of a weak part may itself
    be weak: an identifier and an opaque key report each other.
    """
    is_strong = F.col("kind").isin(*[p.kind for p in STRONG])
    strong, weak = parts.where(is_strong), parts.where(~is_strong)
    hides = (F.col("l.kind") == "opaque") | F.col("r.kind").isin(*[p.kind for p in STRONG])
    weak = staged(_near(weak, parts.where("kind != 'opaque'"), key, 0, _other() & hides).where("NOT near").drop("near"), "secret-weak")
    completes = F.create_map(*[x for k, v in COMPLEMENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    fits = F.array_contains(completes[F.col("l.kind")], F.col("r.kind"))
    linked = _near(weak, strong.unionAll(weak), key, reach, fits).where("near").drop("near")
    return strong.unionAll(linked)


def _other() -> Column:
    """Not the part itself."""
    return (F.col("l.kind") != F.col("r.kind")) | (F.col("l.start") != F.col("r.start"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per input row: id and ``spans``, an array of (start, rank, kind, end).

    Spans are in code points, the end exclusive, in order of start, then kind; ``rank`` is
    the place of the kind in ``KINDS``. Matches of a kind are leftmost and do not overlap;
    those that are too short are dropped after matching. A null or empty text has no
    spans. Rows that repeat id and text get the same spans. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # an id can repeat with another text, so the text's digest is part of the key
    rows = staged(
        docs.select(
            F.col(id_col).alias("id"),
            F.md5(text.cast("binary")).alias("digest"),
            F.concat(*[_lengths(text, p) for p in STRONG + WEAK]).alias("matches"),
        ),
        "secret-matches",
    )
    key = ["id", "digest"]
    some = rows.where(F.size("matches") > 0).dropDuplicates(key)
    parts = staged(find_parts(some, key), "secret-parts")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    span = F.struct("start", rank.alias("rank"), "kind", "end")
    spans = link_parts(parts, key, reach).groupBy(*key).agg(F.array_sort(F.collect_list(span)).alias("spans"))
    spans = spans.withColumnsRenamed({"id": "s_id", "digest": "s_digest"})
    same = F.col("id").eqNullSafe(F.col("s_id")) & (F.col("digest") == F.col("s_digest"))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return rows.drop("matches").join(spans, same, "left").select(
        F.col("id").alias(id_col), F.coalesce("spans", none).alias("spans")
    )


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
