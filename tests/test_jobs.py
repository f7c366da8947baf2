"""Staged runs: stop, resume, repeat."""

import pytest
from pyspark.sql import functions as F

from filingloom.operators import compare
from filingloom.plans import builds, jobs
from filingloom.session import scratch_dir


class Stopped(Exception):
    pass


def counted(spark, calls, name, rows=5):
    def build():
        calls.append(name)
        return spark.range(rows).withColumn("stage", F.lit(name))

    return build


def test_a_stopped_run_goes_on_with_the_stage_that_failed(spark):
    root, calls = scratch_dir(spark, "runs"), []

    def fails():
        raise Stopped

    first = jobs.StagedRun(spark, root, "r1", limit=3)
    first.stage("one", counted(spark, calls, "one"))
    with pytest.raises(Stopped):
        first.stage("two", fails, inputs=["one"])
    again = jobs.StagedRun(spark, root, "r1", limit=3)
    assert again.stage("one", counted(spark, calls, "one")).count() == 5
    assert again.stage("two", counted(spark, calls, "two", 7), inputs=["one"]).count() == 7
    assert calls == ["one", "two"] and again.computed == ["two"]
    assert {(r["stage"], r["rows"]) for r in again.manifest().collect()} == {("one", 5), ("two", 7)}


def test_a_task_that_dies_while_writing_leaves_nothing_that_counts(spark):
    root, calls = scratch_dir(spark, "runs"), []
    run = jobs.StagedRun(spark, root, "r2")
    broken = spark.range(0, 100, 1, 4).withColumn("x", F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.lit("ok")))
    with pytest.raises(Exception, match="lost"):
        run.stage("one", lambda: broken)
    assert not run.committed("one") and run.manifest().isEmpty()
    assert jobs.StagedRun(spark, root, "r2").stage("one", counted(spark, calls, "one")).count() == 5


def test_a_finished_run_is_not_computed_again(spark):
    root, calls = scratch_dir(spark, "runs"), []
    for _ in range(3):
        out = jobs.StagedRun(spark, root, "r3").stage("one", counted(spark, calls, "one"))
    assert calls == ["one"] and out.columns == ["id", "stage"]


def test_the_first_of_two_attempts_counts(spark):
    root, calls = scratch_dir(spark, "runs"), []
    slow = jobs.StagedRun(spark, root, "r4")

    def overtaken():
        jobs.StagedRun(spark, root, "r4").stage("one", counted(spark, calls, "fast", 3))
        return spark.range(3).withColumn("stage", F.lit("slow"))

    assert {r["stage"] for r in slow.stage("one", overtaken).collect()} == {"fast"}


def test_ids_with_other_parameters_and_stages_out_of_order_are_refused(spark):
    root, calls = scratch_dir(spark, "runs"), []
    jobs.StagedRun(spark, root, "r5", limit=1).stage("one", counted(spark, calls, "one"))
    with pytest.raises(ValueError, match="other parameters"):
        jobs.StagedRun(spark, root, "r5", limit=2).stage("one", counted(spark, calls, "one"))
    with pytest.raises(ValueError, match="before its inputs"):
        jobs.StagedRun(spark, root, "r5", limit=1).stage("three", counted(spark, calls, "x"), inputs=["two"])
    with pytest.raises(ValueError):
        jobs.StagedRun(spark, root, "a/b")
    run = jobs.StagedRun(spark, root, "r5", limit=1)
    run.stage("two", counted(spark, calls, "two"))
    run.stage("three", counted(spark, calls, "three"), inputs=["one"])
    with pytest.raises(ValueError, match="other inputs"):
        run.stage("three", counted(spark, calls, "three"), inputs=["two"])


def turns(spark, n=12):
    kinds = ["filing_qa", "risk_summary", "metric_extraction", "hallucination_detection"]
    rows = [(f"e{i}", i, kinds[i % 4], f"Sales rose to ${i} million in the year. Costs fell.", f"Sales rose to ${i} million.") for i in range(n)]
    return spark.createDataFrame(rows, "id string, pos int, task_type string, input string, output string")


def evaluated(spark, root, name, rows, fail_after=None):
    """An evaluation whose stages after ``fail_after`` cannot be computed."""
    run = jobs.StagedRun(spark, root, name)
    if fail_after:
        plain = run.stage

        def stage(stage_name, build, inputs=()):
            out = plain(stage_name, build, inputs)
            if stage_name == fail_after:
                raise Stopped
            return out

        run.stage = stage
    answers = rows.select("id", F.concat(F.lit(name), F.lit(" "), F.col("output")).alias("prediction"))
    return run, jobs.evaluation_job(run, rows, "pos", name, predictions=answers)


def test_evaluations_and_their_comparison_resume_and_agree_with_the_plain_jobs(spark):
    root, rows = scratch_dir(spark, "runs"), turns(spark)
    with pytest.raises(Stopped):
        evaluated(spark, root, "base", rows, fail_after="scored")
    run, base = evaluated(spark, root, "base", rows)
    assert run.computed == ["metrics", "counts", "metadata"]
    _, fine = evaluated(spark, root, "fine", rows)
    found = jobs.comparison_job(jobs.StagedRun(spark, root, "compare"), base, fine, "pos")
    plain = [
        builds.evaluate(rows, "pos", predictions=rows.select("id", F.concat(F.lit(n), F.lit(" "), F.col("output")).alias("prediction")), backend=n)
        for n in ("base", "fine")
    ]
    want = builds.compare_runs(*plain, order="pos")
    for name in ("overall", "by_task", "summary"):
        mine, theirs = found[name], getattr(want, name)
        assert mine.exceptAll(theirs).isEmpty() and theirs.exceptAll(mine).isEmpty()
    row = found["summary"].first()
    assert (row["baseline_backend"], row["finetuned_backend"]) == ("base", "fine")
    assert (row["num_examples_baseline"], row["num_examples_finetuned"]) == (12, 12)
    assert found["pairs"].count() == 12


def test_summary_without_metadata_and_of_empty_runs(spark):
    long = spark.createDataFrame([("a", "m", 0.5)], "task_type string, metric string, value double")
    overall = compare.aggregate_metrics(long).where("scope = 'overall'")
    row = compare.comparison_summary(compare.compare_metrics(overall, overall)).first()
    assert row["baseline_backend"] is None and row["num_examples_finetuned"] is None and row["metrics_compared"] == 1
    none = compare.run_metadata(spark.createDataFrame([], "backend string"))
    assert tuple(none.first()) == (None, 0)
    row = compare.comparison_summary(compare.compare_metrics(overall, overall), none, none).first()
    assert row["num_examples_baseline"] == 0


def test_extraction_and_dataset_jobs_equal_the_plain_ones(spark):
    words = " ".join(f"word{k}" for k in range(150))
    rows = [(f"f{i}", f"T{i}", f"{i:010d}", f"Item 1. Business {words}. Item 1A. Risk {words} may fall. Item 7. Results {words}.") for i in range(6)]
    page = spark.createDataFrame(rows, "raw_path string, ticker string, cik string, content string")
    extra = {
        "form": F.lit("10-K"), "filing_date": F.lit("2020-03-01"), "report_date": F.lit(""),
        "accession_number": F.col("raw_path"), "accession_number_no_dashes": F.col("raw_path"), "document_url": F.lit("u"),
    }
    manifest = page.drop("content").withColumns(extra)
    files = page.where("raw_path != 'f3'").select("raw_path", "content")
    run = jobs.StagedRun(spark, scratch_dir(spark, "runs"), "extract")
    sections = jobs.extract_job(run, manifest, files, 20)
    plain = builds.extract_filings(manifest, files, 20)
    assert sections.exceptAll(plain).isEmpty() and sections.count() == plain.count() > 0
    assert [r["raw_path"] for r in run.stage("missing", lambda: 1 / 0).collect()] == ["f3"]
    chunking = {"max_tokens": 60, "overlap": 10, "min_tokens": 10}
    tables = jobs.dataset_job(jobs.StagedRun(spark, scratch_dir(spark, "runs"), "set"), sections, chunking=chunking)
    built = builds.build_dataset(sections, scratch_dir(spark, "plain"), chunking=chunking)
    for name in ("stats", "profile", "manifest", "leakage"):
        mine, theirs = tables[name], getattr(built, name)
        assert mine.exceptAll(theirs).isEmpty() and theirs.exceptAll(mine).isEmpty()
