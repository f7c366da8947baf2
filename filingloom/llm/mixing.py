"""Mixing sources to target weights by hierarchical budgets.

The budget in tokens goes down a tree of domain, language and source. Each node hands its
part to its children by weight; a child that has fewer tokens than its part leaves the
shortage to its siblings, and only what all of them cannot take goes up to the parent's
siblings. A leaf fills its part with whole epochs over its documents and, last, with the
token-prefix of one more epoch, each in its own seeded order.

The order of an epoch is that of a hash, so the prefix is all hashes up to a cut. Cuts are
found from sums over hash ranges; only the documents of the range with the cut are ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingloom.llm.common import fresh, staged

LEVELS = ("domain", "lang", "source")
#: leaves that are planned on the driver; of more, only their domains and languages are, and
#: Spark finds how far each of those fills its leaves
MAX_LEAVES = 100_000
#: documents of a leaf in one hash range, about
RANGE_ROWS = 20_000

Path = tuple[str | None, ...]


def pour(budget: Fraction, nodes: Sequence[tuple[Fraction, Fraction]]) -> list[Fraction]:
    """Parts of a budget for (weight, most) nodes: by weight, shortages to the others by weight."""
    parts = [Fraction(0)] * len(nodes)
    open_ = [i for i, (weight, most) in enumerate(nodes) if weight > 0 and most > 0]
    while open_ and budget > 0:
        total = sum(nodes[i][0] for i in open_)
        short = [i for i in open_ if nodes[i][1] <= budget * nodes[i][0] / total]
        if not short:
            for i in open_:
                parts[i] = budget * nodes[i][0] / total
            break
        for i in short:
            parts[i] = nodes[i][1]
            budget -= nodes[i][1]
        open_ = [i for i in open_ if i not in set(short)]
    return parts


def parts_of(most: Mapping[Path, int], weights: Mapping[Path, float], budget: int) -> dict[Path, Fraction]:
    """The exact part of each leaf. ``weights`` are by path from the root; a path without one has 1."""
    out: dict[Path, Fraction] = {}

    def down(prefix: Path, leaves: list[Path], part: Fraction) -> None:
        depth = len(prefix)
        if leaves and len(leaves[0]) == depth:
            out[prefix] = part
            return
        below: dict[str | None, list[Path]] = {}
        for leaf in leaves:
            below.setdefault(leaf[depth], []).append(leaf)
        names = sorted(below, key=lambda n: (n is not None, n or ""))
        nodes = [
            (Fraction(weights.get((*prefix, n), 1)), Fraction(sum(most[x] for x in below[n]))) for n in names
        ]
        for name, share in zip(names, pour(part, nodes)):
            down((*prefix, name), below[name], share)

    if most:
        down((), list(most), Fraction(budget))
    return out


def budgets(most: Mapping[Path, int], weights: Mapping[Path, float], budget: int) -> dict[Path, int]:
    """Whole tokens for each leaf."""
    return {leaf: int(part) for leaf, part in parts_of(most, weights, budget).items()}


def levels(
    leaves: DataFrame, parts: Mapping[Path, Fraction], special: Mapping[Path, Sequence[tuple[Fraction, int]]]
) -> dict[Path, Fraction | None]:
    """Tokens for each unit of weight, up to which the branches ``parts`` (domain, language) fill their leaves.

    ``leaves`` (domain, lang, most) have weight 1; ``special`` lists weight and most of the
    others. None: all leaves of the branch are full. Each round fills the leaves that the
    level of the round before reaches and pours what they leave on the rest, as
    :func:`pour` does; the leaves are only summed up.
    """
    found: dict[Path, Fraction | None] = {node: Fraction(0) for node in parts}
    open_ = dict(found)
    while open_:
        caps = [(*node, int(level)) for node, level in open_.items()]
        table = leaves.sparkSession.createDataFrame(caps, "c_domain string, c_lang string, cap long")
        same = F.col("domain").eqNullSafe(F.col("c_domain")) & F.col("lang").eqNullSafe(F.col("c_lang"))
        full = F.col("most") <= F.col("cap")
        sums = leaves.where("most > 0").join(table, same).groupBy("c_domain", "c_lang").agg(
            F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0)).alias("full"), F.count_if(~full).alias("rest")
        )
        sums = {(r["c_domain"], r["c_lang"]): (int(r["full"]), r["rest"]) for r in sums.collect()}
        after = {}
        for node, level in open_.items():
            filled, rest = sums.get(node, (0, 0))
            weight = Fraction(rest)
            for w, most in special.get(node, ()):
                if w > 0 and most > 0:
                    filled, weight = (filled + most, weight) if most <= level * w else (filled, weight + w)
            found[node] = (parts[node] - filled) / weight if weight else None
            if found[node] is not None and found[node] != level:
                after[node] = found[node]
        open_ = after
    return found


def largest_budget(most: Mapping[Path, int], weights: Mapping[Path, float]) -> int:
    """The most tokens at which the first level's weights hold: no domain they name runs short.

    Domains that they do not name have weight 1 and give what they have, up to their part.
    """
    supply: dict[Path, int] = {}
    for leaf, n in most.items():
        supply[leaf[:1]] = supply.get(leaf[:1], 0) + n
    named = [Fraction(n) / Fraction(weights[d]) for d, n in supply.items() if weights.get(d, 0) > 0]
    if not named:
        return sum(supply.values())
    return int(sum(min(Fraction(n), min(named) * Fraction(weights.get(d, 1))) for d, n in supply.items()))


def token_count(text: Column) -> Column:
    """Words between ASCII blanks; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, key: Column) -> Column:
    """The place of a document in an epoch, as text that sorts."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), key.cast("string")).cast("binary"))


def plan(
    docs: DataFrame,
    weights: Mapping[Path, float],
    domain: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    budget: int | None = None,
    share: float | None = 1.0,
    max_epochs: int = 1,
    seed: int = 0,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """One row per leaf: ``domain, lang, source, budget, epochs, cut``.

    ``epochs`` whole epochs, and of the next one the documents up to the order key ``cut``
    (null: none). Without ``budget`` it is ``share`` of all tokens; if that is None too, the
    largest at which the weights of the domains hold, see :func:`largest_budget`. A leaf
    gives at most ``max_epochs`` times its tokens. Null languages, sources and domains are
    leaves of their own. An empty table has no leaves; other columns are not read.
    ``range_rows`` does not change the result.
    """
    rows = staged(
        docs.select(
            domain.alias("domain"),
            F.col("lang").alias("lang"),
            F.col("source").alias("source"),
            F.col(id_col).alias("id"),
            token_count(F.col(text_col)).alias("tokens"),
        ),
        "mix-rows",
    )
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    leaves = staged(leaves, "mix-supply")
    spec_df = _spec(leaves, weights, budget, share, max_epochs)
    largest = leaves.agg(F.max("docs")).first()[0] or 0
    digits = 1
    while largest > range_rows * 16**digits:
        digits += 1
    keyed = _with_leaf(rows, spec_df).withColumn("key", order_key(seed, F.col("epochs"), F.col("id")))
    keyed = keyed.withColumn("range", F.substring("key", 1, digits))
    # documents without id have no order; their key is that of the epoch alone, and they go together
    sums = keyed.groupBy(*LEVELS, "range", "rest").agg(F.sum("tokens").alias("tokens"), F.max("key").alias("last"))
    upto = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("tokens").over(upto))
    whole = sums.where("upto <= rest").groupBy(*LEVELS).agg(F.max("last").alias("cut"))
    cutting = sums.where("upto > rest AND upto - tokens <= rest").select(
        *[F.col(k).alias(f"c_{k}") for k in LEVELS],
        F.col("range").alias("c_range"),
        (F.col("rest") - F.col("upto") + F.col("tokens")).alias("room"),
    )
    same = F.col("range") == F.col("c_range")
    for k in LEVELS:
        same = same & F.col(k).eqNullSafe(F.col(f"c_{k}"))
    inside = keyed.join(cutting, same)
    running = Window.partitionBy(*LEVELS).orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.sum("tokens").over(running)).where("upto <= room")
    cuts = whole.unionAll(inside.groupBy(*LEVELS).agg(F.max("key").alias("cut")))
    cuts = staged(cuts.groupBy(*LEVELS).agg(F.max("cut").alias("cut")), "mix-cuts")
    renamed = cuts.select(*[F.col(k).alias(f"c_{k}") for k in LEVELS], "cut")
    match = F.lit(True)
    for k in LEVELS:
        match = match & F.col(k).eqNullSafe(F.col(f"c_{k}"))
    return staged(spec_df.join(renamed, match, "left").select(*LEVELS, "budget", "epochs", "cut"), "mix-leaves")


def _spec(
    leaves: DataFrame, weights: Mapping[Path, float], budget: int | None, share: float | None, max_epochs: int
) -> DataFrame:
    """``budget, epochs, rest`` of each leaf; the planner broadcasts the table while it is small."""
    spark = leaves.sparkSession
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens")).cast("long")).otherwise(F.lit(0))
    rest = F.when(F.col("tokens") > 0, F.col("budget") - whole * F.col("tokens")).otherwise(F.lit(0))
    columns = [*LEVELS, "budget", whole.cast("long").alias("epochs"), rest.cast("long").alias("rest")]
    if leaves.count() <= MAX_LEAVES:
        has = {tuple(r[k] for k in LEVELS): int(r["tokens"]) for r in leaves.collect()}
        most = {k: n * max_epochs for k, n in has.items()}
        if budget is None:
            budget = largest_budget(most, weights) if share is None else int(Fraction(share) * sum(has.values()))
        rows = [(*leaf, has[leaf], part) for leaf, part in budgets(most, weights, budget).items()]
        table = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long, budget long")
        return staged(table.select(*columns), "mix-spec")

    supply = leaves.groupBy("domain", "lang").agg(F.sum("tokens").alias("tokens"))
    branches = supply.limit(MAX_LEAVES + 1).collect()
    if len(branches) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} pairs of domain and language")
    most = {(r["domain"], r["lang"]): int(r["tokens"]) * max_epochs for r in branches}
    if budget is None:
        total = sum(most.values()) // max_epochs
        budget = largest_budget(most, weights) if share is None else int(Fraction(share) * total)
    parts = parts_of(most, weights, budget)
    named = [(*path, True) for path in weights if len(path) == 3]
    marks = spark.createDataFrame(named, "n_domain string, n_lang string, n_source string, named boolean")
    same = F.lit(True)
    for k in LEVELS:
        same = same & F.col(k).eqNullSafe(F.col(f"n_{k}"))
    marked = leaves.join(marks, same, "left").select(*LEVELS, "tokens", F.coalesce("named", F.lit(False)).alias("named"))
    marked = staged(marked.withColumn("most", F.col("tokens") * max_epochs), "mix-marked")
    own = {tuple(r[k] for k in LEVELS): int(r["most"]) for r in marked.where("named").collect()}
    special: dict[Path, list] = {}
    for path, n in own.items():
        special.setdefault(path[:2], []).append((Fraction(weights[path]), n))
    level = levels(marked.where("NOT named"), parts, special)
    caps = spark.createDataFrame(
        [(*node, None if x is None else int(x)) for node, x in level.items()], "c_domain string, c_lang string, cap long"
    )
    same = F.col("domain").eqNullSafe(F.col("c_domain")) & F.col("lang").eqNullSafe(F.col("c_lang"))
    plain = marked.where("NOT named").join(caps, same)
    plain = plain.withColumn("budget", F.least("most", F.coalesce("cap", "most"))).select(*LEVELS, "tokens", "budget")
    parts_own = []
    for path, n in own.items():
        x, w = level[path[:2]], Fraction(weights[path])
        parts_own.append((*path, n // max_epochs, (n if x is None else min(n, int(x * w))) if w > 0 else 0))
    table = spark.createDataFrame(parts_own, "domain string, lang string, source string, tokens long, budget long")
    return staged(plain.unionAll(table).select(*columns), "mix-spec")


def _with_leaf(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    right = leaves.withColumnsRenamed({k: f"leaf_{k}" for k in LEVELS})
    match = F.lit(True)
    for k in LEVELS:
        match = match & F.col(k).eqNullSafe(F.col(f"leaf_{k}"))
    return rows.join(right, match).drop(*[f"leaf_{k}" for k in LEVELS])


def select(
    docs: DataFrame,
    leaves: DataFrame,
    domain: Column,
    id_col: str = "doc_id",
    seed: int = 0,
    epoch_col: str = "mix_epoch",
) -> DataFrame:
    """The rows with all their columns, once for each epoch they are drawn in, and ``epoch_col``.

    A column of ``docs`` that has the name ``epoch_col`` is replaced; other names may be
    anything. The planner broadcasts the leaves while they are few. Rows that
    repeat an id are drawn together; rows without id only in whole epochs. An empty table
    gives an empty result.
    """
    names = [*LEVELS, "epochs", "cut", "own_domain"]
    own = dict(zip(names, fresh([*docs.columns, epoch_col], *[f"leaf_{n}" for n in names])))
    right = leaves.select(*[F.col(n).alias(own[n]) for n in names[:-1]])
    keyed = docs.withColumn(own["own_domain"], domain)
    match = F.col(own["own_domain"]).eqNullSafe(F.col(own["domain"]))
    for k in LEVELS[1:]:
        match = match & docs[k].eqNullSafe(F.col(own[k]))
    drawn = keyed.join(right, match)
    count, cut = F.col(own["epochs"]), F.col(own["cut"])
    last = order_key(seed, count, F.col(id_col)) <= cut
    epochs = F.when(F.coalesce(last, F.lit(False)), F.sequence(F.lit(0).cast("long"), count)).otherwise(
        F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>"))
    )
    kept = [docs[c] for c in docs.columns if c.lower() != epoch_col.lower()]
    return drawn.select(*kept, F.explode(epochs).alias(epoch_col))
