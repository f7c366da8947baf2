"""Near-duplicate vectors by a pivot-permutation index.

Each vector is described by its nearest reference vectors (pivots), nearest first. Two
vectors are candidates when their prefixes share at least two pivots. The inverted lists
are kept per pair of pivots: a vector stands in the list of every pair in its prefix, so
two vectors meet in a list exactly if their shared-pivot count is two or more. A pair is
verified in the list of its two least shared pivots and nowhere else, so each link counts
once. Equal vectors are folded into one before.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingloom.llm.common import Rows, arrow_schema, staged, tidy
from filingloom.llm.graph import components

THRESHOLD = 0.93
#: pivots in a vector's description, and up to how many pivots that is enough; each further
#: doubling takes one more
PREFIX, PREFIX_PIVOTS = 8, 2_048
MIN_SHARED = 2
#: pivots drawn: PIVOT_FACTOR times the root of the number of vectors, within these bounds
PIVOT_FACTOR, MIN_PIVOTS, MAX_PIVOTS = 2.0, 64, 16_384
#: pivots closer to each other than this are not taken
MAX_PIVOT_COSINE = 0.75
#: vectors of a list that meet in one task; longer lists are cut into pairs of blocks
BLOCK = 512
#: lists up to this length are compared pair by pair, longer ones by a matrix product
SHORT = 24


def prefix_length(pivots: int) -> int:
    """Pivots in a description: more of them stand closer together and change places sooner."""
    return min(pivots, PREFIX + max(0, -(-pivots // PREFIX_PIVOTS) - 1).bit_length())


def _describe(pivots: np.ndarray, kind: str, schema: pa.Schema):
    """Adds the prefix of the pivot permutation; vectors of other dimensions get none."""
    n = prefix_length(len(pivots))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            reps, weights, labels, vectors = (c.to_pylist() for c in batch.columns)
            for low in range(0, len(reps), 1000):
                part = slice(low, low + 1000)
                raw = np.array(vectors[part], kind)
                unit = raw.astype(float)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                near = np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :n].astype("<i4")
                for row in zip(reps[part], weights[part], labels[part], raw, near):
                    out.add(*row[:3], row[3].tobytes(), row[4].tolist())
                if out.full():
                    yield from out.take()
        yield from out.take()

    return run


def _verify(threshold: float, kind: str, schema: pa.Schema):
    """Sorted rows of lists to (rep, least linked rep, linked rows), summed within a list."""
    names = ["label", "a", "b", "i", "j", "rep", "weight", "vector", "near", "block"]

    def links(rows: dict[str, np.ndarray]) -> Iterator[tuple]:
        unit = np.stack([np.frombuffer(v, kind) for v in rows["vector"]]).astype(float)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        near = np.array(rows["near"].tolist())
        rep, weight, block = rows["rep"], rows["weight"], rows["block"]
        new = np.ones(len(rep), bool)
        same = np.ones(len(rep) - 1, bool)
        for name in names[:5]:
            same &= rows[name][1:] == rows[name][:-1]
        new[1:] = ~same
        cell = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(rep)))
        size_of = sizes[cell]
        crossing = rows["i"] != rows["j"]

        def canonical(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """Whether the list's pair of pivots is the least that both share."""
            shared = (near[x][:, :, None] == near[y][:, None, :]).any(axis=2)
            ids = np.sort(np.where(shared, near[x], 1 << 30), axis=1)
            return (ids[:, 0] == rows["a"][x]) & (ids[:, 1] == rows["b"][x])

        for shift in range(1, SHORT):
            x = np.flatnonzero((size_of[:-shift] <= SHORT) & (cell[:-shift] == cell[shift:])) if shift < len(rep) else []
            if not len(x):
                break
            y = x + shift
            x, y = (k[~crossing[x] | (block[x] != block[y])] for k in (x, y))
            close = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
            x, y = x[close], y[close]
            once = canonical(x, y)
            for p, q in zip(x[once].tolist(), y[once].tolist()):
                yield rep[p], rep[q], weight[q]
                yield rep[q], rep[p], weight[p]
        for start, size in zip(starts[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist()):
            own = np.arange(start, start + size)
            found = unit[own] @ unit[own].T >= threshold
            np.fill_diagonal(found, False)
            if crossing[start]:
                found &= block[own][:, None] != block[own][None, :]
            a, b = rows["a"][start], rows["b"][start]
            earlier = np.unique(near[own][(near[own] < b) & (near[own] != a)])
            if len(earlier):
                has = (near[own][:, :, None] == earlier).any(axis=1).astype(np.float32)
                found &= (has @ has.T) == 0
            count = found @ weight[own]
            least = rep[own].copy()
            while True:
                lower = np.minimum(least, np.where(found, least, np.iinfo(np.int64).max).min(axis=1))
                if (lower == least).all():
                    break
                least = lower
            for k in np.flatnonzero(found.any(axis=1)).tolist():
                yield rep[own[k]], least[k], count[k]

    def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {}
        for name, column in zip(names, batch.columns):
            if name in ("label", "vector", "near"):
                values = np.empty(len(column), object)
                values[:] = column.to_pylist()
                out[name] = values
            else:
                out[name] = column.to_numpy(zero_copy_only=False)
        return out

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = Rows(schema), None
        for batch in batches:
            rows = columns(batch)
            if held is not None:
                rows = {k: np.concatenate([held[k], rows[k]]) for k in names}
            n = len(rows["rep"])
            if not n:
                continue
            # the last list may go on in the next batch
            last = n - 1
            while last and all(rows[k][last - 1] == rows[k][n - 1] for k in names[:5]):
                last -= 1
            held = {k: v[last:] for k, v in rows.items()}
            if last > 1:
                for row in links({k: v[:last] for k, v in rows.items()}):
                    out.add(*row)
                    if out.full():
                        yield from out.take()
        if held is not None and len(held["rep"]) > 1:
            for row in links(held):
                out.add(*row)
                if out.full():
                    yield from out.take()
        yield from out.take()

    return run


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    pivots: int | None = None,
) -> DataFrame:
    """One row per input row: id, ``n_links``, ``component_id``, ``kept``.

    Rows are compared only when their labels are equal and not null and their vectors have
    one length. Vectors that are null, empty, zero or hold null or non-finite parts link
    with nothing, and neither do rows without id. A pair is linked when the cosine in
    double precision is at least ``threshold``. ``n_links`` counts the other rows linked
    directly, copies included; ``component_id`` is the least id reachable.

    ``pivots`` vectors are drawn by hash from all distinct ones (default: twice the root of
    their number, 64 to 16,384): that is the bounded sample the index is fitted on. Each
    row is indexed. Pairs whose prefixes share fewer than two pivots are missed. Of pairs at
    cosine 0.93 exactly, in 64 dimensions, 98.9 to 99.9 % are found with 453 to 16,384 pivots;
    closer pairs are missed less. An empty table gives an empty result; other columns are
    not read.
    """
    spark = vectors.sparkSession
    element = vectors.schema[vector_col].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v")
    )
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    usable = F.coalesce(usable & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    fold = rows.where("usable").groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    fold = staged(fold, "vectors-folded")

    # a vector alone with its length links with none but its copies, which are folded
    dims = [r["d"] for r in fold.groupBy(F.size("v").alias("d")).count().where("count > 1").orderBy("d").collect()]
    found = None
    for dim in dims:
        part = fold.where(F.size("v") == dim)
        n = part.count()
        want = pivots or int(min(MAX_PIVOTS, max(MIN_PIVOTS, PIVOT_FACTOR * n**0.5)))
        order = F.xxhash64("v")
        share = min(1.0, 3 * want / n)
        drawn = part.where(F.pmod(order, F.lit(1_000_003)) < share * 1_000_003).orderBy(order).limit(2 * want)
        chosen = _spread(np.array([r["v"] for r in drawn.select("v").collect()], float).reshape(-1, dim), want)
        if len(chosen) < MIN_SHARED:
            chosen = np.vstack([chosen, np.full((MIN_SHARED, dim), dim**-0.5)])
        links = _links(part, chosen, kind, threshold)
        found = links if found is None else found.unionAll(links)
    classes = rows.where("usable").join(fold, ["label", "v"]).select("id", "rep", "weight")
    rest = rows.where("NOT usable").selectExpr("id", "id AS rep", "1L AS weight")
    if found is None:
        found = spark.createDataFrame([], "rep long, other long, links long")
    found = staged(found, "vector-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(found.selectExpr("rep AS a", "other AS b"))
    totals = counts.join(comps, counts["rep"] == comps["node"], "left").select(
        F.col("rep").alias("t_rep"), "links", "component"
    )
    everyone = classes.unionAll(rest)
    component = F.coalesce("component", "rep")
    return everyone.join(totals, F.col("rep") == F.col("t_rep"), "left").select(
        F.col("id").alias(id_col),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def _spread(drawn: np.ndarray, want: int) -> np.ndarray:
    """Unit vectors of the sample, leaving out those close to one taken before.

    Pivots that stand together would be told apart by noise alone, and a dense group near
    them would no longer share its prefix.
    """
    unit = drawn / np.linalg.norm(drawn, axis=1, keepdims=True)
    taken, n = np.zeros((min(want, len(unit)), drawn.shape[1])), 0
    for x in unit:
        if n == len(taken):
            break
        if not (taken[:n] @ x > MAX_PIVOT_COSINE).any():
            taken[n] = x
            n += 1
    return taken[:n]


def _links(fold: DataFrame, pivots: np.ndarray, kind: str, threshold: float) -> DataFrame:
    """``rep, other, links`` for folded vectors of one length."""
    described = T.StructType(
        [
            T.StructField("rep", T.LongType()),
            T.StructField("weight", T.LongType()),
            T.StructField("label", T.StringType()),
            T.StructField("vector", T.BinaryType()),
            T.StructField("near", T.ArrayType(T.IntegerType())),
        ]
    )
    index = staged(
        fold.select("rep", "weight", "label", "v").mapInArrow(
            _describe(pivots, kind, arrow_schema(described)), described
        ),
        "pivot-index",
    )
    width = prefix_length(len(pivots))
    pairs = F.array(
        *[
            F.struct(F.least(F.col("near")[p], F.col("near")[q]).alias("a"), F.greatest(F.col("near")[p], F.col("near")[q]).alias("b"))
            for p, q in combinations(range(width), MIN_SHARED)
        ]
    )
    listed = index.withColumn("pair", F.explode(pairs)).select("*", "pair.a", "pair.b").drop("pair")
    key = ["label", "a", "b"]
    long = listed.groupBy(*key).count().where(F.col("count") > BLOCK)
    long = staged(long.select(*key, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "pivot-long-lists")
    listed = listed.join(long, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    listed = listed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    listed = listed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    listed = listed.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")})
    order = [*key, "i", "j"]
    ordered = listed.select(*order, "rep", "weight", "vector", "near", "block")
    ordered = ordered.repartition(*order).sortWithinPartitions(*order)
    schema = "rep long, other long, links long"
    return ordered.mapInArrow(_verify(threshold, kind, arrow_schema(schema)), schema)
