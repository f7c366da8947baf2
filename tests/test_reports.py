import random

import pytest
from pyspark.sql import functions as F

from filingloom.operators import compare, report, scoring
from filingloom.plans import builds
from filingloom.session import scratch_dir

PAIR = "pos long, id string, task_type string, prediction string, metrics map<string,double>"


def test_delta_rules(spark):
    rows = [("0.5", "0.6"), ("0", "0.2"), ("0", "-0.2"), ("0", "0"), (None, "nan"), ("x", "1"), ("-0.5", "0.5")]
    df = spark.createDataFrame(rows, "b string, f string")
    got = compare.with_metric_delta(df, F.col("b"), F.col("f")).collect()
    assert [(r.absolute_delta, r.relative_delta_pct, r.improved) for r in got] == [
        (0.1, 20.0, True), (0.2, 100.0, True), (-0.2, 100.0, False), (0.0, 0.0, False),
        (0.0, 0.0, False), (1.0, 100.0, True), (1.0, 200.0, True),
    ]


def test_missing_metrics_warn(spark):
    a = spark.createDataFrame([("x", 0.5), ("y", 0.25)], "metric string, mean double")
    b = spark.createDataFrame([("x", 0.75), ("z", 1.0)], "metric string, mean double")
    got = {r.metric: r for r in compare.compare_metrics(a, b).collect()}
    assert got["x"].warning is None
    assert got["y"].warning == "[overall] metric 'y' missing in finetuned" and got["y"].absolute_delta == -0.25
    assert got["z"].warning == "[overall] metric 'z' missing in baseline"
    summary = compare.comparison_summary(compare.compare_metrics(a, b)).first()
    # without the runs' metadata, backends and sizes are not known
    assert tuple(summary) == (3, 2, 1, round((0.25 - 0.25 + 1.0) / 3, 4), None, None, None, None)


def test_prediction_join_rules(spark):
    base = spark.createDataFrame(
        [(1, "a", "t", "b1", {"m": 0.1}), (2, None, "t", "b2", {"m": 0.2}), (3, "a", "t", "b3", {"n": 0.3}), (4, "q", "t", "b4", {})], PAIR
    )
    fine = spark.createDataFrame(
        [(1, "a", "t", "old", {"m": 0.9}), (2, "a", "t", "new", {"m": 0.4}), (3, None, "t", "f0", {"m": 0.1})], PAIR
    )
    rows = sorted(compare.prediction_join(base, fine, "pos").collect(), key=lambda r: r.pos)
    assert [(r.baseline_prediction, r.finetuned_prediction) for r in rows] == [("b1", "new"), ("b2", "f0"), ("b3", "new")]
    assert [r.improvement_summary for r in rows] == [{"m": 0.3}, {"m": -0.1}, {"n": -0.3, "m": 0.4}]
    assert len(compare.prediction_join(base, fine, "pos", 2).collect()) == 2
    assert [r.pos for r in compare.best_improvements(compare.prediction_join(base, fine, "pos"), "pos", "m").collect()] == [3, 1, 2]
    assert [r.pos for r in compare.worst_regressions(compare.prediction_join(base, fine, "pos"), "pos", "m").collect()] == [2]


PICK = "pos long, id string, task_type string, improvement_summary map<string,double>"
QA, CASE = "filing_qa", "hallucination_detection"


@pytest.mark.parametrize(
    "rows, picked",
    [
        # a single row that is no better takes the average place
        ([(0, QA, {})], [(0, "average")]),
        # two gains, the worst loss, the middle (the second gain again, so skipped), the rest by mean
        (
            [(0, QA, {"a": 0.5}), (1, QA, {"a": 0.25}), (2, QA, {"a": -0.5}), (3, QA, {"a": 0.0}), (4, QA, {"a": -0.25})],
            [(0, "improvement"), (1, "improvement"), (2, "regression"), (3, "average"), (4, "additional")],
        ),
        # a faithfulness metric or task has a place of its own; ties go by position
        (
            [(0, QA, {"a": 0.5}), (1, QA, {"a": 0.5}), (2, QA, {"a": 0.5}), (3, QA, {"a": 0.5}), (4, QA, {"a": 0.25}), (5, CASE, {"a": 0.0}), (6, QA, {"a": 0.0, "lexical_faithfulness": -0.5})],
            [(0, "improvement"), (1, "improvement"), (6, "regression"), (3, "average"), (5, "faithfulness")],
        ),
        # the loss counts by its lowest metric, not by the mean
        (
            [(0, QA, {"a": 0.5, "b": -0.5}), (1, QA, {"a": -0.25}), (2, QA, {"a": 0.5})],
            [(2, "improvement"), (0, "regression"), (1, "additional")],
        ),
    ],
)
@pytest.mark.parametrize("base", [0, 2**60])
def test_qualitative_pick_by_hand(spark, rows, picked, base):
    data = [(base + i, f"id{i}", task, summary) for i, task, summary in rows]
    got = report.qualitative_pick(spark.createDataFrame(data, PICK), "pos").collect()
    assert [(r.pos - base, r.category) for r in got] == picked


def test_leaking_data_under_any_folder_fails_the_gate(spark):
    line = '{"id": "%s", "instruction": "i", "input": "x", "output": "y", "task_type": "filing_qa", "source": "s", "metadata": {"ticker": "AAA", "year": "2020", "form": "10-K", "section": "mda"}}'
    lines = [("/data/latest/train.jsonl", line % "a"), ("/data/latest/test.jsonl", line % "b")]
    gate = builds.audit_dataset(spark.createDataFrame(lines, "file string, line string")).first()
    assert gate.train_test_overlap == 1 and gate.unplaced == 0 and not gate.passed
    gate = builds.audit_dataset(spark.createDataFrame([("/data/latest/part.jsonl", line % "a")], "file string, line string")).first()
    assert gate.unplaced == 1 and not gate.passed


@pytest.mark.parametrize(
    "path, split",
    [
        ("/data/latest/train.jsonl", "train"),
        ("/data/latest/test_sample.jsonl", "test"),
        ("test.jsonl", "test"),
        ("/x/split=validation/part-0.json", "validation"),
        ("/x/train/part-0.json", "train"),
        ("/test/data/training.jsonl", None),
        ("/latest/part.jsonl", None),
    ],
)
def test_split_of_path(one, path, split):
    assert one(builds.split_of_path, path) == split


def test_takeaways(one):
    assert one(lambda c: report.takeaway(c, F.lit(0.5)), "regression") == report.TAKEAWAY_REGRESSED
    assert one(lambda c: report.takeaway(c, F.lit(-0.1)), "faithfulness") == report.TAKEAWAY_REGRESSED
    assert one(lambda c: report.takeaway(c, F.lit(0.0)), "faithfulness") == report.TAKEAWAY_FAITHFUL
    assert one(lambda c: report.takeaway(c, F.lit(0.1)), "average") == report.TAKEAWAY_BETTER
    assert one(lambda c: report.takeaway(c, F.lit(0.0)), "average") == report.TAKEAWAY_EQUAL


def test_aggregate_counts_only_rows_with_the_metric(spark):
    df = spark.createDataFrame([("t", "m", 0.5), ("t", "m", 0.25), ("u", "m", 1.0), ("u", "k", 0.0)], "task_type string, metric string, value double")
    got = {(r.scope, r.task_type, r.metric): (r.mean, r.n) for r in compare.aggregate_metrics(df).collect()}
    assert got[("overall", None, "m")] == (round(1.75 / 3, 4), 3)
    assert got[("task", "t", "m")] == (0.375, 2)
    assert got[("overall", None, "k")] == (0.0, 1)


def test_batch_predictor(spark):
    df = spark.createDataFrame([("q1", "hello"), ("q2", "bye")], "id string, input string")
    out = scoring.predict_batches(df, lambda frame: ["<s>" + t.upper() for t in frame["input"]], ["input"])
    assert {r.id: r.prediction for r in out.collect()} == {"q1": "HELLO", "q2": "BYE"}


PAGE = (
    "<html><body><p>Item 1. Business</p><p>Item 1A. Risk Factors</p><h1>Item 1. Business</h1><p>{b}</p>"
    "<h1>Item 1A. Risk Factors</h1><p>{r}</p><h1>Item 2. Properties</h1><p>none</p></body></html>"
)


def test_pages_to_dataset_to_comparison(spark):
    body = " ".join(f"We sell product number {i} with growth." for i in range(60))
    risk = " ".join(f"There is risk of decline number {i}." for i in range(60))
    rows = [
        (f"raw/T{i}/10-K/2022/acc{i}.html", f"T{i}", f"{i:010d}", "10-K", f"{2015 + i % 6}-02-01", "", f"0-{i}", f"0{i}", "u", PAGE.format(b=body, r=risk))
        for i in range(12)
    ]
    names = "raw_path string, ticker string, cik string, form string, filing_date string, report_date string, accession_number string, accession_number_no_dashes string, document_url string, content string"
    both = spark.createDataFrame(rows, names)
    sections = builds.extract_filings(both.drop("content"), both.select("raw_path", "content"), min_section_words=20)
    found = sections.collect()
    assert len(found) == 24 and {r.section for r in found} == {"business", "risk_factors"}
    assert all(r.text.startswith("Item 1") and "Item 2" not in r.text for r in found)

    built = builds.build_dataset(sections, scratch_dir(spark, "ds"), chunking={"max_tokens": 120, "overlap": 20, "min_tokens": 10})
    stats = {(r.scope, r.name): r.examples for r in built.stats.collect()}
    assert stats[("total", "all")] == built.examples.count() > 0
    assert {r.split for r in built.profile.collect()} == {"train", "validation", "test"}
    assert built.leakage.first().passed
    assert built.manifest.count() == stats[("total", "all")]

    lines = built.examples.select(F.concat(F.col("split"), F.lit(".jsonl")).alias("file"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))
    gate = builds.audit_dataset(lines).first()
    assert gate.passed and gate.duplicate_ids == 0

    test_rows = built.examples.where("split = 'test'").withColumn("pos", F.monotonically_increasing_id() + 1)
    base = builds.evaluate(test_rows, "pos")
    fine = builds.evaluate(test_rows, "pos", extended=True)
    result = builds.compare_runs(base, fine, "pos", max_examples=None)
    assert result.pairs.count() == test_rows.count()
    assert result.summary.first().metrics_compared == result.overall.count() > 3
    assert {r.metric for r in result.overall.collect()} >= {"token_f1", "rouge_l", "lexical_faithfulness"}


def test_dispatch_reads_figures_of_asked_orders_only(spark, tmp_path):
    from filingloom.plans.catalog import evaluation

    roles = ["user", "assistant", "assistant", "user"]
    talks = [(c, t, roles[t], f"text {c} {t}") for c in (3, 5) for t in range(4)] + [(7, 0, "user", "q"), (7, 1, "assistant", "r"), (3, 2, "assistant", "again")]
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    number = F.col("id").cast("double")
    items = spark.range(4000).select(
        F.floor(F.col("id") / 2).alias("l_orderkey"), F.lit(1).cast("long").alias("l_partkey"), F.lit(1).cast("long").alias("l_suppkey"),
        (F.col("id") % 2 + 1).cast("int").alias("l_linenumber"), F.lit(4.0).alias("l_quantity"), (number + 0.5).alias("l_extendedprice"),
        F.lit(0.05).alias("l_discount"), F.lit(0.02).alias("l_tax"),
    )
    items.where("l_orderkey <> 5").write.parquet(f"{tmp_path}/lineitem.parquet")
    turns = evaluation.answered_turns(spark, str(tmp_path))
    got = sorted((r["conv_id"], r["turn"], r["output"], r["prediction"]) for r in turns.collect())
    billed, sold = "Price $6.50 and tax 2.0 % for 4 million", "Item 1 sold for $6.50 at 5.0% off, about 4 million units or 25 basis points."
    assert got == [
        (3, 1, "text 3 1", "text 3 0"),
        (3, 2, f"{billed} again", f"{sold} text 3 1"),
        (3, 2, f"{billed} text 3 2", f"{sold} text 3 1"),
        (5, 1, "text 5 1", "text 5 0"),
        (5, 2, "text 5 2", "text 5 1"),
        (7, 1, "r", "q"),
    ]
    # line items are filtered where they are read: none is joined by its order before
    plan = turns._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and "LeftSemi" not in plan and plan.count("BroadcastHashJoin") >= 1


def test_metrics_are_not_computed_twice_to_be_exploded(spark):
    from filingloom.operators import scoring

    rows = spark.createDataFrame([("metric_extraction", "a 1", "a 1", "a 1"), (None, None, None, None)], "task_type string, input string, output string, prediction string")
    long = scoring.metrics_long(scoring.score_examples(rows), ["task_type"])
    optimised = long._jdf.queryExecution().optimizedPlan().toString()
    assert optimised.count("lcs_counts(") <= 2 and "size(map_from_entries" not in optimised
    # rows without a metric have no row
    empty = spark.sql("SELECT 1 AS k, map() AS metrics UNION ALL SELECT 2, NULL UNION ALL SELECT 3, map('m', CAST(NULL AS DOUBLE))").withColumn("metrics", F.col("metrics").cast("map<string,double>"))
    assert [tuple(r) for r in scoring.metrics_long(empty, ["k"]).collect()] == [(3, "m", None)]
