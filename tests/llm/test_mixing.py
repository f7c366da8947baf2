import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from filingloom.llm import mixing

from .conftest import AWKWARD, wide


def words(text):
    return sum(1 for w in (text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w)


def test_pour_by_weight_and_to_siblings():
    F_ = Fraction
    assert mixing.pour(F_(10), [(F_(1), F_(99)), (F_(4), F_(99))]) == [2, 8]
    assert mixing.pour(F_(10), [(F_(1), F_(99)), (F_(4), F_(5))]) == [5, 5]
    assert mixing.pour(F_(10), [(F_(1), F_(3)), (F_(1), F_(2))]) == [3, 2]
    assert mixing.pour(F_(10), [(F_(0), F_(30)), (F_(1), F_(2))]) == [0, 2]


def test_siblings_come_before_ancestors():
    most = {("a", "x", "1"): 10, ("a", "x", "2"): 1000, ("a", "y", "1"): 1000, ("b", "x", "1"): 1000}
    got = mixing.budgets(most, {}, 400)
    # the shortage of a/x/1 stays in a/x; the other branches keep what their weights say
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 90, ("a", "y", "1"): 100, ("b", "x", "1"): 200}
    most[("a", "x", "2")] = 30
    got = mixing.budgets(most, {}, 400)
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 30, ("a", "y", "1"): 160, ("b", "x", "1"): 200}


def test_budgets_never_exceed():
    rng = random.Random(1)
    for _ in range(100):
        most = {(rng.choice("ab"), rng.choice("xyz"), str(k)): rng.randint(0, 50) for k in range(rng.randint(1, 9))}
        weights = {("a",): rng.randint(0, 3), ("b", "x"): 2.5}
        budget = rng.randint(0, 300)
        got = mixing.budgets(most, weights, budget)
        assert set(got) == set(most) and sum(got.values()) <= budget
        assert all(got[k] <= most[k] for k in most)


def plain(rows, spread, weights, budget, epochs, seed):
    leaves = defaultdict(list)
    for leaf, i, text in rows:
        leaves[leaf].append((i, words(text)))
    has = {k: sum(n for _, n in v) for k, v in leaves.items()}
    parts = mixing.budgets({k: n * epochs for k, n in has.items()}, weights, budget)
    out = []
    for leaf, docs in leaves.items():
        whole, rest = divmod(parts[leaf], has[leaf]) if has[leaf] else (0, 0)
        out += [(i, e) for e in range(whole) for i, _ in docs]
        by_key = defaultdict(list)
        for i, n in docs:
            text = ":".join(str(x) for x in (seed, whole, i) if x is not None)
            by_key[hashlib.md5(text.encode()).hexdigest()].append((i, n))
        for key in sorted(by_key):
            rest -= sum(n for _, n in by_key[key])
            if rest < 0:
                break
            out += [(i, whole) for i, _ in by_key[key]]
    return sorted(out, key=str)


@pytest.mark.parametrize("budget,epochs,range_rows", [(500, 1, 20_000), (500, 1, 2), (4000, 3, 5), (10**6, 2, 20_000), (0, 1, 5)])
def test_selection_equals_plain(spark, budget, epochs, range_rows):
    rng = random.Random(2)
    rows = [(("en", "fr", None)[k % 3], ("s1", None, "s2", "s1")[k % 4], k, "w " * rng.randint(0, 12)) for k in range(240)]
    rows += [("en", "s1", 7, "w w w"), ("en", "s1", None, "no id"), ("xx", "s9", 500, None)]
    docs = spark.createDataFrame([(i, t, a, s, 1) for a, s, i, t in rows], "doc_id long, text string, lang string, source string, epochs int")
    domain = F.when(F.col("source") == "s1", "d1")
    weights = {("d1",): 3, (None, "en"): 2}
    leaves = mixing.plan(docs.repartition(4), weights, domain, budget=budget, max_epochs=epochs, seed=9, range_rows=range_rows)
    got = mixing.select(docs, leaves, domain, seed=9)
    assert got.columns == [*docs.columns, "mix_epoch"]
    want = plain([(("d1" if s == "s1" else None, a, s), i, t) for a, s, i, t in rows], None, weights, budget, epochs, 9)
    assert sorted(((r["doc_id"], r["mix_epoch"]) for r in got.collect()), key=str) == want


def test_awkward_and_empty(awkward, nothing):
    domain = F.lit(None).cast("string")
    leaves = mixing.plan(awkward, {}, domain)
    assert mixing.select(awkward, leaves, domain).count() == len(AWKWARD)
    assert mixing.select(nothing, mixing.plan(nothing, {}, domain), domain).count() == 0


def test_columns_of_the_names_used_inside(awkward):
    domain = F.lit(None).cast("string")
    drawn = mixing.select(awkward, mixing.plan(awkward, {}, domain), domain)
    assert drawn.columns == [c for c in awkward.columns if c != "mix_epoch"] + ["mix_epoch"]
    assert {r["mix_epoch"] for r in drawn.collect()} == {0} and {r["__domain"] for r in drawn.collect()} == {"own"}
    other = mixing.select(awkward, mixing.plan(awkward, {}, domain), domain, epoch_col="epoch")
    assert other.columns == [*awkward.columns, "epoch"] and {r["mix_epoch"] for r in other.collect()} == {"own"}


def test_largest_budget_lets_the_weights_hold(spark):
    most = {("a", "x", "1"): 300, ("a", "y", "1"): 100, ("b", "x", "1"): 50, (None, "x", "2"): 7, ("c", "x", "1"): 90}
    weights = {("a",): 4, ("b",): 1, ("c",): 1, ("d",): 9}
    budget = mixing.largest_budget(most, weights)
    assert budget == 200 + 50 + 50 + 7
    got = mixing.budgets(most, weights, budget)
    assert got[("a", "x", "1")] + got[("a", "y", "1")] == 200 and got[("b", "x", "1")] == 50 and got[("c", "x", "1")] == 50
    assert mixing.largest_budget(most, {}) == 547 and mixing.largest_budget({}, weights) == 0
    docs = spark.createDataFrame([(k, "w " * 5, "en", f"s{k % 2}") for k in range(60)], "doc_id long, text string, lang string, source string")
    domain = F.col("source")
    leaves = mixing.plan(docs, {("s0",): 1, ("s1",): 3}, domain, share=None)
    assert {r["source"]: r["budget"] for r in leaves.collect()} == {"s0": 50, "s1": 150}


@pytest.mark.parametrize("budget,epochs", [(700, 1), (700, 3), (10**6, 2), (0, 1), (None, 1)])
def test_many_leaves_are_planned_in_spark_as_on_the_driver(spark, monkeypatch, budget, epochs):
    rng = random.Random(4)
    rows = [
        (k, "w " * rng.choice([0, 1, 2, 3, 9, 40]), rng.choice(["en", "fr", None]), rng.choice([f"s{j}" for j in range(25)] + [None]))
        for k in range(400)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    domain = F.when(F.col("source") < "s2", "low").when(F.col("source").isNotNull(), "high")
    weights = {("low",): 3, ("high",): 2, ("high", "en"): 2.5, ("high", "en", "s7"): 4, ("high", None, "s3"): 0, (None, "fr", None): 0.5}

    def planned():
        leaves = mixing.plan(docs, weights, domain, budget=budget, share=None, max_epochs=epochs, seed=3)
        return sorted((tuple(r) for r in leaves.collect()), key=str)

    want = planned()
    monkeypatch.setattr(mixing, "MAX_LEAVES", 20)
    assert planned() == want and len(want) > 60
