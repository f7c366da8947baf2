"""The end-to-end jobs over whole tables, each as one staged run."""

import uuid

from pyspark.sql import functions as F

from filingloom.plans import jobs
from filingloom.plans.catalog import base as b
from filingloom.plans.catalog import extraction
from filingloom.plans.catalog.auditing import _STATS_SQL
from filingloom.plans.catalog.comparing import _LONG_SQL, _MEAN, _RUNS_SQL
from filingloom.plans.catalog.evaluation import answered_turns, dispatch_sql
from filingloom.plans.catalog.labelling import BANKS
from filingloom.session import scratch_dir

_MIN_WORDS = 40


def _new_run(spark, **params):
    return jobs.StagedRun(spark, scratch_dir(spark, "runs"), uuid.uuid4().hex, **params)


_FILING_SQL = f"""{b.DOCS_SQL},
raw_{extraction._ITEM_SQL},
pages AS (SELECT doc_id AS page_id, text AS html FROM raw_items WHERE doc_id % 9 <> 0),
cleaned AS ({extraction._HTML_SQL}),
items AS (SELECT page_id AS doc_id, text FROM cleaned)"""


@b.query(
    "job_extract_filings",
    extraction._SPANS_SQL.replace(extraction._ITEM_SQL, _FILING_SQL, 1).replace("SELECT doc_id, item, CASE", ", spans AS (SELECT doc_id, item, CASE", 1)
    + f""")
SELECT 'docs/' || CAST(s.doc_id AS VARCHAR) AS raw_path, s.section, length(s.text) AS text_chars, len({b.sql_words('s.text')}) AS text_words, sha256(s.text) AS text_sha256,
  d.cik, d.ticker, d.form, d.accession_number, d.source_url
FROM spans s JOIN docs d ON d.doc_id = s.doc_id WHERE len({b.sql_words('s.text')}) >= {_MIN_WORDS}""",
)
def job_extract_filings(spark, sf_dir):
    """Documents as pages of filings, of which every ninth was never fetched, to sections."""
    filings = b.docs(spark, sf_dir)
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("raw_path")
    manifest = filings.select(
        path, "cik", "ticker", "form", "filing_date", "report_date", "accession_number",
        F.replace("accession_number", F.lit("-"), F.lit("")).alias("accession_number_no_dashes"),
        F.col("source_url").alias("document_url"),
    )
    pages = extraction._items(spark, sf_dir).where("doc_id % 9 <> 0").select(path, F.col("text").alias("content"))
    found = jobs.extract_job(_new_run(spark, words=_MIN_WORDS), manifest, pages, _MIN_WORDS)
    return found.select(
        "raw_path", "section", "text_chars", "text_words", F.sha2("text", 256).alias("text_sha256"),
        "cik", "ticker", "form", "accession_number", "source_url",
    )


@b.query("job_build_dataset", _STATS_SQL)
def job_build_dataset(spark, sf_dir):
    """All documents to a split dataset; its statistics, from what was written."""
    return jobs.dataset_job(_new_run(spark), b.docs(spark, sf_dir), chunking=BANKS)["stats"]


def _evaluated(spark, sf_dir, backend: str):
    """One run over all conversation turns; the tuned one gives every other conversation's reference."""
    rows = answered_turns(spark, sf_dir).withColumn("id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    prediction = F.col("prediction")
    if backend == "tuned":
        prediction = F.when(F.col("conv_id") % 2 == 1, F.col("output")).otherwise(prediction)
    answers = rows.select("id", prediction.alias("prediction"))
    test_rows = rows.select("id", "turn", "task_type", "input", "output")
    return jobs.evaluation_job(_new_run(spark, backend=backend), test_rows, "turn", backend, predictions=answers)


@b.query(
    "job_evaluate",
    f"""WITH RECURSIVE {dispatch_sql()} SELECT CASE WHEN grouping(task_type) = 1 THEN 'overall' ELSE 'task' END AS scope, task_type, metric, {b.sql_round(_MEAN, 4)} AS mean, count(value) AS n
FROM long GROUP BY GROUPING SETS ((task_type, metric), (metric))""",
)
def job_evaluate(spark, sf_dir):
    """Metrics of a run over all turns, from the scored rows that were written."""
    return _evaluated(spark, sf_dir, "extractive")["metrics"]


_TWO_RUNS = """two_runs AS (SELECT 'base' AS run, conv_id, turn, question, answer FROM told
  UNION ALL SELECT 'fine', conv_id, turn, CASE WHEN conv_id % 2 = 1 THEN answer ELSE question END, answer FROM told),"""


@b.query(
    "job_compare_runs",
    f"""WITH RECURSIVE {dispatch_sql('run, conv_id, turn', _TWO_RUNS, 'two_runs')}, metrics AS (SELECT run, task_type, metric, value FROM long),
{_RUNS_SQL.split(_LONG_SQL + ',', 1)[1]}
SELECT 'overall' AS task_type, metric, baseline, finetuned, absolute_delta, relative_delta_pct, improved, coalesce(warning, '') AS warning FROM comparison
UNION ALL SELECT task_type, metric, baseline, finetuned, absolute_delta, relative_delta_pct, improved, coalesce(warning, '') FROM by_task""",
)
def job_compare_runs(spark, sf_dir):
    """Two runs over all turns, compared overall and by task."""
    both = [_evaluated(spark, sf_dir, backend) for backend in ("extractive", "tuned")]
    found = jobs.comparison_job(_new_run(spark), *both, order="turn")
    overall = found["overall"].withColumn("task_type", F.lit("overall"))
    return found["by_task"].unionByName(overall).withColumn("warning", F.coalesce("warning", F.lit("")))
