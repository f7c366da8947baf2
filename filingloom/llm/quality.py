"""Text quality by histogram gradient-boosted trees over document statistics.

The statistics come from whole texts. Trees are complete binary trees grown level by level
on binned statistics and kept as flat arrays, so a batch of documents walks all trees at
once in numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingloom.llm.common import Rows, arrow_schema, raw_bytes, tidy

#: labelled rows that are collected for training, about
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS = 60, 4, 64
RATE, L2, MIN_WEIGHT = 0.15, 1.0, 2.0

STATISTICS = (
    "log_bytes lower upper digit space newline stop comma mark symbol bar control wide entropy "
    "log_words word_length word_spread longest distinct_words top_word short_words capital_words "
    "shouted_words marked_words log_lines line_length distinct_lines top_line"
).split()


def _classes() -> np.ndarray:
    """Byte by class, 0 or 1."""
    groups = [
        range(97, 123),
        range(65, 91),
        range(48, 58),
        b" ",
        b"\n",
        b".",
        b",;:",
        b"!?\"'()-",
        b"#$%&*+/<=>@\\^_`~[]{}",
        b"|",
        [b for b in range(32) if b != 10],
        range(128, 256),
    ]
    out = np.zeros((256, len(groups)))
    for i, group in enumerate(groups):
        out[list(group), i] = 1
    return out


_CLASSES = _classes()


def statistics(raw: bytes) -> list[float]:
    """The statistics of one text in UTF-8; an empty text has zeros."""
    if not raw:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = counts / len(raw)
    seen = shares[shares > 0]
    words, lines = raw.split(), raw.split(b"\n")
    n = max(1, len(words))
    sizes = np.array([len(w) for w in words] or [0])
    by_word, by_line = Counter(words), Counter(lines)
    shouted = sum(k for w, k in by_word.items() if w.isupper() and len(w) > 1)
    capital = sum(k for w, k in by_word.items() if w[:1].isupper())
    marked = sum(k for w, k in by_word.items() if not w[-1:].isalnum() and w[-1:] < b"\x80")
    return [
        np.log1p(len(raw)),
        *(shares @ _CLASSES),
        float(-(seen * np.log(seen)).sum()),
        np.log1p(len(words)),
        sizes.mean(),
        sizes.std(),
        sizes.max(),
        len(by_word) / n,
        max(by_word.values(), default=0) / n,
        (sizes <= 2).mean(),
        capital / n,
        shouted / n,
        marked / n,
        np.log1p(len(lines)),
        len(raw) / len(lines),
        len(by_line) / len(lines),
        max(by_line.values()) / len(lines),
    ]


@dataclass
class Forest:
    """Complete trees of one depth; node ``i`` has the children ``2i + 1`` and ``2i + 2``."""

    base: float
    depth: int
    features: np.ndarray
    cuts: np.ndarray
    leaves: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        total = np.full(len(x), self.base)
        if len(self.features) and len(x):
            trees = np.arange(len(self.features))
            node = np.zeros((len(x), len(trees)), np.int64)
            rows = np.arange(len(x))[:, None]
            for _ in range(self.depth):
                value = x[rows, self.features[trees, node]]
                node = 2 * node + 1 + (value > self.cuts[trees, node])
            total += self.leaves[trees, node - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Forest:
    """Boosts trees on the logistic loss. Without rows the score is 0.5 throughout."""
    inner = 2**depth - 1
    if not len(x):
        return Forest(0.0, depth, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T)], axis=1)
    width = x.shape[1]
    flat = binned + np.arange(width) * bins
    total = np.full(len(x), base)
    features = np.zeros((trees, inner), np.int64)
    cuts = np.full((trees, inner), np.inf)
    leaves = np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = y - p, p * (1 - p)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            cell = ((node - first) * width * bins)[:, None] + flat
            g = np.bincount(cell.ravel(), np.repeat(gradient, width), many * width * bins).reshape(many, width, bins)
            h = np.bincount(cell.ravel(), np.repeat(weight, width), many * width * bins).reshape(many, width, bins)
            left_g, left_h = g.cumsum(axis=2), h.cumsum(axis=2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + L2) + right_g**2 / (right_h + L2) - all_g**2 / (all_h + L2)
            gain[(left_h < MIN_WEIGHT) | (right_h < MIN_WEIGHT)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                feature, at = divmod(int(best[k]), bins)
                if gain[k, feature, at] > 1e-9 and at < len(edges[feature]):
                    features[t, first + k], cuts[t, first + k] = feature, edges[feature][at]
            node = 2 * node + 1 + (x[np.arange(len(x)), features[t, node]] > cuts[t, node])
        leaf = node - inner
        g = np.bincount(leaf, gradient, inner + 1)
        h = np.bincount(leaf, weight, inner + 1)
        leaves[t] = RATE * g / (h + L2)
        total += leaves[t][leaf]
    return Forest(base, depth, features, cuts, leaves)


def _statistics_rows(schema: pa.Schema):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            for raw, label in zip(raw_bytes(batch.column(0)), batch.column(1).to_pylist()):
                out.add(statistics(raw), label)
            yield from out.take()

    return run


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    train_rows: int = TRAIN_ROWS,
) -> Forest:
    """A forest from about ``train_rows`` labelled rows, drawn by a hash of the id.

    Rows whose label or id is null teach nothing; labels of absent documents neither. The
    drawn labels are the only broadcast, and their number is bounded by ``train_rows``.
    """
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("label"))
    known = known.where("label_id IS NOT NULL AND label IS NOT NULL")
    n = known.count()
    if not n:
        return train(np.zeros((0, len(STATISTICS))), np.zeros(0))
    share = min(1.0, train_rows / n)
    drawn = known.where(F.pmod(F.xxhash64("label_id"), F.lit(1_000_003)) < share * 1_000_003)
    drawn = drawn.limit(2 * train_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("content"))
    rows = texts.join(F.broadcast(drawn), F.col("id") == F.col("label_id")).select("content", "label")
    schema = T.StructType(
        [T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("label", T.DoubleType())]
    )
    got = rows.mapInArrow(_statistics_rows(arrow_schema(schema)), schema).limit(4 * train_rows).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(STATISTICS))
    # the order in which rows arrive must not matter
    order = np.lexsort([*x.T, got["label"].to_numpy()])
    return train(x[order], got["label"].to_numpy()[order])


def _scores(forest: Forest, schema: pa.Schema):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(raw) for raw in raw_bytes(batch.column(1))]
            x = np.array(rows, float).reshape(len(rows), len(STATISTICS))
            score = np.concatenate([forest.score(x[i : i + 2000]) for i in range(0, max(1, len(x)), 2000)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], schema=schema)

    return run


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``score``, 0 to 1. A null text counts as empty."""
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())]
    )
    return docs.select(id_col, text_col).mapInArrow(_scores(forest, arrow_schema(schema)), schema)
