"""Scorers of text pairs around a model file.

The file goes to every executor once and each Python worker loads it once; texts come in
Arrow batches and are handed to the model in slices of bounded bytes.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from filingloom.session import ship_package

#: bytes of text that a model sees at once, about
SLICE_BYTES = 4 << 20

_loaded: dict[str, object] = {}


class OverlapModel:
    """A linear model of a pair: the share of the hypothesis' length, its digits, and whether it is quoted.

    Its file is one JSON object with ``bias``, ``length``, ``digits`` and ``quoted``.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            told = json.load(source)
        self.bias, self.length, self.digits, self.quoted = (float(told[k]) for k in ("bias", "length", "digits", "quoted"))

    def __call__(self, premises: Sequence[str], hypotheses: Sequence[str]) -> np.ndarray:
        sizes = np.array([len(h) for h in hypotheses], float)
        share = np.array([len(p) for p in premises], float) / np.maximum(sizes, 1.0)
        digits = np.array([sum("0" <= c <= "9" for c in h) for h in hypotheses], float) / np.maximum(sizes, 1.0)
        quoted = np.array([h in p for p, h in zip(premises, hypotheses)], float)
        return self.bias + self.length * share + self.digits * digits + self.quoted * quoted


def _slices(premises: Sequence[str], hypotheses: Sequence[str], most: int) -> Iterator[slice]:
    low, held = 0, 0
    for k, (p, h) in enumerate(zip(premises, hypotheses)):
        held += len(p) + len(h)
        if held >= most:
            yield slice(low, k + 1)
            low, held = k + 1, 0
    if low < len(premises):
        yield slice(low, len(premises))


def score_pairs(
    model: Callable[[Sequence[str], Sequence[str]], np.ndarray], premises: pd.Series, hypotheses: pd.Series, most: int = SLICE_BYTES
) -> np.ndarray:
    """Scores of all pairs; a pair with a null is not shown to the model and has none."""
    known = (premises.notna() & hypotheses.notna()).to_numpy()
    out = np.full(len(premises), np.nan)
    left, right = premises[known].tolist(), hypotheses[known].tolist()
    found = [np.asarray(model(left[s], right[s]), float) for s in _slices(left, right, most)]
    if found:
        out[known] = np.concatenate(found)
    return out


def model_scorer(
    spark: SparkSession, path: str, load: Callable[[str], Callable] = OverlapModel, slice_bytes: int = SLICE_BYTES
) -> Callable[[Column, Column], Column]:
    """A scorer for :func:`filingloom.functions.scores.scored_faithfulness`.

    ``path`` is a file in any store that Spark reads; ``load`` makes a model of its local
    copy: a function of two lists of texts that gives a number for each pair.
    """
    ship_package(spark)
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)

    @F.pandas_udf("double")
    def score(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        if name not in _loaded:
            _loaded[name] = load(SparkFiles.get(name))
        for premises, hypotheses in pairs:
            yield pd.Series(score_pairs(_loaded[name], premises, hypotheses, slice_bytes))

    return score
