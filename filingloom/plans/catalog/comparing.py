"""Metric roll-ups, run comparison and report tables."""

from pyspark.sql import functions as F

from filingloom.functions import banks
from filingloom.functions import text as tx
from filingloom.operators import compare, report, safety, scoring
from filingloom.plans.catalog import base as b
from filingloom.plans.catalog.auditing import _STATS_SQL, dataset_stats
from filingloom.plans.catalog.evaluation import _DISPATCH_SQL, _scored
from filingloom.session import load

_HALF = "2024-01-16"

_LONG_SQL = f"""long AS (
  SELECT event_id, event_type AS task_type, CASE WHEN ts < TIMESTAMP '{_HALF}' THEN 'base' ELSE 'fine' END AS run, value AS v, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
metrics AS (
  SELECT run, event_id, task_type, 'latency' AS metric, v AS value FROM long
  UNION ALL SELECT run, event_id, task_type, 'k_score', k / 100 FROM long WHERE task_type <> 'view'
  UNION ALL SELECT run, event_id, task_type, 'lexical_faithfulness', (100 - k) / 100 FROM long WHERE task_type <> 'click'
  UNION ALL SELECT run, event_id, task_type, 'only_base', v / 2 FROM long WHERE run = 'base' AND task_type = 'click'
  UNION ALL SELECT run, event_id, task_type, 'only_fine', 1.0::DOUBLE FROM long WHERE run = 'fine' AND task_type = 'error')"""
_MEAN = "CAST(sum(CAST(value AS DECIMAL(26,12))) AS DOUBLE) / count(value)"


def _metric_rows(spark, sf_dir):
    """Events as scored rows of two runs, the first and the second half of the period."""
    e = load(spark, sf_dir, "events")
    run = F.when(F.col("ts") < F.lit(_HALF).cast("timestamp"), "base").otherwise("fine")
    k = F.get_json_object("props", "$.k").cast("bigint")
    task, value = F.col("event_type"), F.col("value")
    rows = e.select("event_id", task.alias("task_type"), run.alias("run"), value.alias("v"), k.alias("k"))
    entries = F.array(
        F.struct(F.lit("latency").alias("metric"), F.col("v").alias("value")),
        F.when(
            F.col("task_type") != "view",
            F.struct(F.lit("k_score").alias("metric"), (F.col("k") / 100.0).alias("value")),
        ),
        F.when(
            F.col("task_type") != "click",
            F.struct(
                F.lit("lexical_faithfulness").alias("metric"),
                ((100 - F.col("k")) / 100.0).alias("value"),
            ),
        ),
        F.when(
            (F.col("run") == "base") & (F.col("task_type") == "click"),
            F.struct(F.lit("only_base").alias("metric"), (F.col("v") / 2).alias("value")),
        ),
        F.when(
            (F.col("run") == "fine") & (F.col("task_type") == "error"),
            F.struct(F.lit("only_fine").alias("metric"), F.lit(1.0).alias("value")),
        ),
    )
    present = F.filter(entries, lambda x: x.isNotNull())
    return rows.select("run", "event_id", "task_type", F.inline(present))


@b.query(
    "aggregate_metrics",
    f"""WITH {_LONG_SQL} SELECT CASE WHEN grouping(task_type) = 1 THEN 'overall' ELSE 'task' END AS scope, task_type, metric, {b.sql_round(_MEAN, 4)} AS mean, count(value) AS n
FROM metrics GROUP BY GROUPING SETS ((task_type, metric), (metric))""",
)
def aggregate_metrics(spark, sf_dir):
    return compare.aggregate_metrics(_metric_rows(spark, sf_dir))


@b.query(
    "aggregate_scored_examples",
    f"""WITH RECURSIVE {_DISPATCH_SQL} SELECT CASE WHEN grouping(task_type) = 1 THEN 'overall' ELSE 'task' END AS scope, task_type, metric, {b.sql_round(_MEAN, 4)} AS mean, count(value) AS n
FROM long GROUP BY GROUPING SETS ((task_type, metric), (metric))""",
)
def aggregate_scored_examples(spark, sf_dir):
    """Scores of the conversation pairs, rolled up."""
    return compare.aggregate_metrics(scoring.metrics_long(_scored(spark, sf_dir), ["task_type"]))


@b.query(
    "task_counts",
    f"""WITH e AS (SELECT lang AS task_type, substring(text, 1, 200) AS input_preview, source AS prediction FROM documents)
SELECT task_type, CAST(grouping(task_type) AS BIGINT) AS is_total, count(*) AS examples, {b.sql_round('avg(length(input_preview))', 4)} AS average_input_length,
  {b.sql_round('avg(length(prediction))', 4)} AS average_prediction_length FROM e GROUP BY GROUPING SETS ((task_type), ())""",
)
def task_counts(spark, sf_dir):
    rows = b.documents(spark, sf_dir).select(
        F.col("lang").alias("task_type"),
        F.substring("text", 1, 200).alias("input_preview"),
        F.col("source").alias("prediction"),
    )
    return compare.task_counts(rows)


def sql_delta(x: str, y: str) -> str:
    """Delta columns for two finite expressions."""
    d = b.sql_round(f"({y}) - ({x})", 4)
    rel = f"CASE WHEN ({x}) <> 0 THEN {d} / abs({x}) * 100.0::DOUBLE WHEN {d} <> 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END"
    return (
        f"{b.sql_round(x, 4)} AS baseline, {b.sql_round(y, 4)} AS finetuned, {d} AS absolute_delta, "
        f"{b.sql_round(rel, 2)} AS relative_delta_pct, {d} > 0 AS improved"
    )


def _finite(x: str) -> str:
    return f"CASE WHEN isfinite(TRY_CAST({x} AS DOUBLE)) THEN TRY_CAST({x} AS DOUBLE) ELSE 0.0::DOUBLE END"


_DELTA_SQL = """li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_returnflag = 'R' THEN 'abc' WHEN l_linenumber = 1 THEN 'NaN' ELSE CAST(CAST(l_discount AS DECIMAL(5,2)) AS VARCHAR) END AS x,
  CASE WHEN l_linenumber = 2 THEN NULL WHEN l_linenumber = 3 THEN 'Infinity' ELSE '0.' || lpad(CAST(l_partkey AS VARCHAR), 5, '0') END AS y FROM lineitem)"""


@b.query(
    "metric_delta",
    f"""WITH {_DELTA_SQL}, f AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, {_finite('x')} AS bx, {_finite('y')} AS fy FROM li)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {sql_delta('bx', 'fy')} FROM f""",
)
def metric_delta(spark, sf_dir):
    """Text values of which some are missing, not numbers, or not finite."""
    li = load(spark, sf_dir, "lineitem")
    line = F.col("l_linenumber")
    x = (
        F.when(F.col("l_returnflag") == "R", "abc")
        .when(line == 1, "NaN")
        .otherwise(F.col("l_discount").cast("decimal(5,2)").cast("string"))
    )
    y = (
        F.when(line == 2, F.lit(None).cast("string"))
        .when(line == 3, "Infinity")
        .otherwise(F.concat(F.lit("0."), F.lpad(F.col("l_partkey").cast("string"), 5, "0")))
    )
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return compare.with_metric_delta(li, x, y).select(*keys, *compare.DELTA_COLUMNS)


_RUNS_SQL = f"""{_LONG_SQL},
overall AS (SELECT run, metric, {b.sql_round(_MEAN, 4)} AS mean FROM metrics GROUP BY ALL),
tasks AS (SELECT run, task_type, metric, {b.sql_round(_MEAN, 4)} AS mean FROM metrics GROUP BY ALL),
joined AS (SELECT metric, x.mean AS bm, y.mean AS fm FROM (SELECT * FROM overall WHERE run = 'base') x FULL JOIN (SELECT * FROM overall WHERE run = 'fine') y USING (metric)),
comparison AS (SELECT metric, {sql_delta('coalesce(bm, 0.0::DOUBLE)', 'coalesce(fm, 0.0::DOUBLE)')},
  CASE WHEN bm IS NULL THEN '[overall] metric ''' || metric || ''' missing in baseline' WHEN fm IS NULL THEN '[overall] metric ''' || metric || ''' missing in finetuned' END AS warning FROM joined),
task_joined AS (SELECT task_type, metric, x.mean AS bm, y.mean AS fm FROM (SELECT * FROM tasks WHERE run = 'base') x FULL JOIN (SELECT * FROM tasks WHERE run = 'fine') y USING (task_type, metric)),
by_task AS (SELECT task_type, metric, {sql_delta('coalesce(bm, 0.0::DOUBLE)', 'coalesce(fm, 0.0::DOUBLE)')},
  CASE WHEN bm IS NULL THEN '[' || task_type || '] metric ''' || metric || ''' missing in baseline' WHEN fm IS NULL THEN '[' || task_type || '] metric ''' || metric || ''' missing in finetuned' END AS warning FROM task_joined)"""


def _run(spark, sf_dir, name: str, scope: str):
    rows = _metric_rows(spark, sf_dir).where(F.col("run") == name)
    return compare.aggregate_metrics(rows).where(F.col("scope") == scope)


def _overall(spark, sf_dir):
    return compare.compare_metrics(
        _run(spark, sf_dir, "base", "overall"), _run(spark, sf_dir, "fine", "overall")
    )


def _by_task(spark, sf_dir):
    return compare.compare_metrics(
        _run(spark, sf_dir, "base", "task"),
        _run(spark, sf_dir, "fine", "task"),
        ("task_type", "metric"),
    )


@b.query("compare_overall", f"WITH {_RUNS_SQL} SELECT * FROM comparison")
def compare_overall(spark, sf_dir):
    return _overall(spark, sf_dir)


@b.query("compare_by_task", f"WITH {_RUNS_SQL} SELECT * FROM by_task")
def compare_by_task(spark, sf_dir):
    return _by_task(spark, sf_dir)


@b.query("improvements", f"WITH {_RUNS_SQL} SELECT metric, baseline, finetuned, absolute_delta FROM comparison WHERE absolute_delta > 0")
def improvements(spark, sf_dir):
    return compare.improvements(_overall(spark, sf_dir)).select(
        "metric", "baseline", "finetuned", "absolute_delta"
    )


@b.query("regressions", f"WITH {_RUNS_SQL} SELECT metric, baseline, finetuned, absolute_delta FROM comparison WHERE absolute_delta < 0")
def regressions(spark, sf_dir):
    return compare.regressions(_overall(spark, sf_dir)).select(
        "metric", "baseline", "finetuned", "absolute_delta"
    )


_BACKEND_SQL = "CASE WHEN run = 'base' THEN 'extractive' ELSE 'tuned-' || CAST(max(k) OVER (PARTITION BY run) AS VARCHAR) END"


@b.query(
    "run_metadata",
    f"""WITH {_LONG_SQL}, named AS (SELECT run, event_id, {_BACKEND_SQL} AS backend FROM long)
SELECT run, min(backend) AS backend, count(*) AS num_examples FROM named GROUP BY run""",
)
def run_metadata(spark, sf_dir):
    """What produced each run, and how many examples it has."""
    return _metadata(spark, sf_dir)


def _metadata(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    run = F.when(F.col("ts") < F.lit(_HALF).cast("timestamp"), "base").otherwise("fine")
    rows = e.select(run.alias("run"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    named = rows.groupBy("run").agg(F.max("k").alias("k")).select(
        "run",
        F.when(F.col("run") == "base", "extractive").otherwise(F.concat(F.lit("tuned-"), F.col("k").cast("string"))).alias("backend"),
    )
    return compare.run_metadata(rows.select("run").join(named, "run"), ["run"])


@b.query(
    "comparison_summary",
    f"""WITH {_RUNS_SQL}, named AS (SELECT run, event_id, {_BACKEND_SQL} AS backend FROM long),
runs AS (SELECT run, min(backend) AS backend, count(*) AS n FROM named GROUP BY run)
SELECT count(*) AS metrics_compared, count(*) FILTER (absolute_delta > 0) AS metrics_improved, count(*) FILTER (absolute_delta < 0) AS metrics_regressed,
  {b.sql_round('CAST(sum(CAST(absolute_delta AS DECIMAL(26,12))) AS DOUBLE) / greatest(count(*), 1)', 4)} AS mean_absolute_delta,
  (SELECT backend FROM runs WHERE run = 'base') AS baseline_backend, (SELECT backend FROM runs WHERE run = 'fine') AS finetuned_backend,
  (SELECT n FROM runs WHERE run = 'base') AS num_examples_baseline, (SELECT n FROM runs WHERE run = 'fine') AS num_examples_finetuned FROM comparison""",
)
def comparison_summary(spark, sf_dir):
    runs = _metadata(spark, sf_dir)
    return compare.comparison_summary(_overall(spark, sf_dir), runs.where("run = 'base'"), runs.where("run = 'fine'"))


# predictions: clicks as the baseline run, purchases as the fine-tuned run, joined by user
_PAIR_SQL = f"""p AS (SELECT event_id, event_type, nullif(user_id, 7) AS id, props, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
last_fine AS (SELECT id, arg_max(props, event_id) AS fp, arg_max(value, event_id) / 500 AS ft, arg_max(k, event_id) / 100 AS fx FROM p WHERE event_type = 'purchase' GROUP BY id),
pair AS (
  SELECT event_id, p.id, CASE WHEN k > 60 THEN 'hallucination_detection' ELSE 'filing_qa' END AS task_type, props AS baseline_prediction, fp AS finetuned_prediction,
    {b.sql_round('ft - value / 500', 4)} AS d_token_f1, {b.sql_round('0 - k / 100', 4)} AS d_k, {b.sql_round('fx', 4)} AS d_extra
  FROM p JOIN last_fine f ON p.id IS NOT DISTINCT FROM f.id WHERE event_type = 'click')"""


def _pairs(spark, sf_dir, max_examples=None):
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = load(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        F.nullif(F.col("user_id"), F.lit(7)).alias("id"),
        F.col("props").alias("prediction"),
        F.col("value"),
        k.alias("k"),
    )
    task = F.when(F.col("k") > 60, "hallucination_detection").otherwise("filing_qa")
    score = (F.col("value") / 500).alias("value")
    base = e.where("event_type = 'click'").select(
        "event_id",
        "id",
        task.alias("task_type"),
        "prediction",
        F.create_map(F.lit("token_f1"), score, F.lit("k"), F.col("k") / 100).alias("metrics"),
    )
    fine = e.where("event_type = 'purchase'").select(
        "event_id",
        "id",
        "prediction",
        F.create_map(F.lit("token_f1"), score, F.lit("extra"), F.col("k") / 100).alias("metrics"),
    )
    return compare.prediction_join(base, fine, "event_id", max_examples)


def _delta_columns(names=("token_f1", "k", "extra")):
    return [F.col("improvement_summary")[n].alias(f"d_{n}") for n in names]


@b.query("prediction_join", f"WITH {_PAIR_SQL} SELECT event_id, id, baseline_prediction, finetuned_prediction FROM pair")
def prediction_join(spark, sf_dir):
    """All pairs, without the report's cap."""
    return _pairs(spark, sf_dir).select("event_id", "id", "baseline_prediction", "finetuned_prediction")


@b.query(
    "prediction_join_top",
    f"WITH {_PAIR_SQL} SELECT event_id, id, baseline_prediction, finetuned_prediction FROM pair ORDER BY event_id LIMIT 10",
)
def prediction_join_top(spark, sf_dir):
    """The first ten pairs in baseline order, as a report shows them."""
    return _pairs(spark, sf_dir, 10).select(
        "event_id", "id", "baseline_prediction", "finetuned_prediction"
    )


@b.query("row_improvement", f"WITH {_PAIR_SQL} SELECT event_id, d_token_f1, d_k, d_extra FROM pair")
def row_improvement(spark, sf_dir):
    return _pairs(spark, sf_dir).select("event_id", *_delta_columns())


@b.query(
    "best_improvements",
    f"WITH {_PAIR_SQL} SELECT event_id, d_token_f1 AS delta FROM pair ORDER BY d_token_f1 DESC, event_id LIMIT 5",
)
def best_improvements(spark, sf_dir):
    return compare.best_improvements(_pairs(spark, sf_dir), "event_id").select("event_id", "delta")


@b.query(
    "worst_regressions",
    f"WITH {_PAIR_SQL}, w AS (SELECT event_id, d_token_f1 AS delta FROM pair ORDER BY d_token_f1, event_id LIMIT 5) SELECT * FROM w WHERE delta < 0",
)
def worst_regressions(spark, sf_dir):
    return compare.worst_regressions(_pairs(spark, sf_dir), "event_id").select("event_id", "delta")


# ---- report frames ---------------------------------------------------------


def _sql_fixed(x: str, d: int = 3) -> str:
    return f"CASE WHEN isfinite({x}) THEN printf('%.{d}f', {x}) ELSE 'N/A' END"


def _sql_signed(x: str, d: int = 3) -> str:
    return f"CASE WHEN isfinite({x}) THEN CASE WHEN {x} >= 0 THEN '+' ELSE '' END || printf('%.{d}f', {x}) ELSE 'N/A' END"


_RESULT = "CASE WHEN absolute_delta > 0 THEN '▲ improved' WHEN absolute_delta < 0 THEN '▼ regressed' ELSE '— no change' END AS result"


@b.query(
    "overall_table",
    f"""WITH {_RUNS_SQL} SELECT replace(metric, '_', ' ') AS metric, {_sql_fixed('baseline')} AS base, {_sql_fixed('finetuned')} AS fine_tuned, {_sql_signed('absolute_delta')} AS delta_abs,
  {_sql_signed('relative_delta_pct', 1)} AS delta_pct, {_RESULT} FROM comparison""",
)
def overall_table(spark, sf_dir):
    return report.overall_table(_overall(spark, sf_dir))


@b.query(
    "task_table",
    f"""WITH {_RUNS_SQL} SELECT replace(task_type, '_', ' ') AS task, replace(metric, '_', ' ') AS metric, {_sql_fixed('baseline')} AS base, {_sql_fixed('finetuned')} AS fine_tuned,
  {_sql_signed('absolute_delta')} AS delta_abs, {_RESULT} FROM by_task""",
)
def task_table(spark, sf_dir):
    return report.task_table(_by_task(spark, sf_dir))


@b.query(
    "stats_rows",
    f"""WITH st AS ({_STATS_SQL})
SELECT CAST(1 AS BIGINT) AS position, 'Total examples' AS statistic, CAST(examples AS VARCHAR) AS value FROM st WHERE scope = 'total'
UNION ALL SELECT 2, 'Avg. input length (chars)', {_sql_fixed('average_input_length', 1)} FROM st WHERE scope = 'total'
UNION ALL SELECT 3, 'Avg. output length (chars)', {_sql_fixed('average_output_length', 1)} FROM st WHERE scope = 'total'
UNION ALL SELECT 4, 'Split · ' || name, CAST(examples AS VARCHAR) FROM st WHERE scope = 'split'
UNION ALL SELECT 5, 'Task · ' || replace(name, '_', ' '), CAST(examples AS VARCHAR) FROM st WHERE scope = 'task_type'""",
)
def stats_rows(spark, sf_dir):
    return report.stats_rows(dataset_stats(spark, sf_dir))


def _picked_sql(columns: str) -> str:
    return f"""WITH {_PAIR_SQL},
scored AS (SELECT *, (d_token_f1 + d_k + d_extra) / 3 AS mean_delta, least(d_token_f1, d_k, d_extra) AS min_delta FROM pair),
ordered AS (SELECT *, row_number() OVER (ORDER BY mean_delta DESC, event_id) AS rn, count(*) OVER () AS n,
  row_number() OVER (ORDER BY min_delta, mean_delta DESC, event_id) AS worst FROM scored),
early AS (SELECT *, CASE WHEN rn <= 2 AND mean_delta > 0 THEN 1 WHEN worst = 1 AND min_delta < 0 THEN 2 WHEN rn = n // 2 + 1 THEN 3 END AS slot FROM ordered),
late AS (SELECT *, row_number() OVER (PARTITION BY slot IS NULL AND task_type = 'hallucination_detection' ORDER BY rn) AS f FROM early),
slots AS (SELECT *, CASE WHEN slot IS NOT NULL THEN slot WHEN task_type = 'hallucination_detection' AND f = 1 THEN 4 ELSE 5 END AS final_slot FROM late),
picked AS (SELECT *, CASE final_slot WHEN 1 THEN 'improvement' WHEN 2 THEN 'regression' WHEN 3 THEN 'average' WHEN 4 THEN 'faithfulness' ELSE 'additional' END AS category
  FROM slots ORDER BY final_slot, rn LIMIT 5)
SELECT {columns} FROM picked"""


@b.query("qualitative_pick", _picked_sql("event_id, category, mean_delta, min_delta"))
def qualitative_pick(spark, sf_dir):
    return report.qualitative_pick(_pairs(spark, sf_dir), "event_id").select(
        "event_id", "category", "mean_delta", "min_delta"
    )


@b.query(
    "takeaway",
    _picked_sql(
        f"""event_id, CASE category WHEN 'improvement' THEN 'Improvement' WHEN 'regression' THEN 'Regression / failure case' WHEN 'average' THEN 'Average case'
  WHEN 'faithfulness' THEN 'Faithfulness / hallucination case' ELSE 'Additional example' END AS label, CASE WHEN category = 'regression' OR mean_delta < 0 THEN {b.sql_str(report.TAKEAWAY_REGRESSED)}
  WHEN category = 'faithfulness' THEN {b.sql_str(report.TAKEAWAY_FAITHFUL)} WHEN mean_delta > 0 THEN {b.sql_str(report.TAKEAWAY_BETTER)} ELSE {b.sql_str(report.TAKEAWAY_EQUAL)} END AS takeaway"""
    ),
)
def takeaway(spark, sf_dir):
    return report.qualitative_pick(_pairs(spark, sf_dir), "event_id").select(
        "event_id",
        report.category_label(F.col("category")).alias("label"),
        report.takeaway(F.col("category"), F.col("mean_delta")).alias("takeaway"),
    )


@b.query(
    "truncate_text",
    f"""SELECT doc_id, CASE WHEN length({b.sql_trim('text')}) <= 600 THEN {b.sql_trim('text')} ELSE rtrim(substring({b.sql_trim('text')}, 1, 599), {b.BLANKS}) || '…' END AS field,
  CASE WHEN lang = 'es' THEN 'N/A' WHEN length({b.sql_trim('text')}) <= 300 THEN {b.sql_trim('text')} ELSE rtrim(substring({b.sql_trim('text')}, 1, 299), {b.BLANKS}) || '…' END AS excerpt,
  CASE WHEN length(text) <= 200 THEN replace(text, chr(10), ' ') ELSE substring(replace(text, chr(10), ' '), 1, 200) || '…' END AS line FROM documents""",
)
def truncate_text(spark, sf_dir):
    text = F.col("text")
    return b.documents(spark, sf_dir).select(
        "doc_id",
        tx.truncate_ellipsis(text, 600).alias("field"),
        tx.truncate_ellipsis(F.when(F.col("lang") != "es", text), 300).alias("excerpt"),
        tx.truncate_line(text).alias("line"),
    )


@b.query(
    "task_mean_delta",
    f"WITH {_RUNS_SQL} SELECT task_type AS task, CAST(sum(CAST(absolute_delta AS DECIMAL(26,12))) AS DOUBLE) / count(*) AS mean_delta FROM by_task GROUP BY 1",
)
def task_mean_delta(spark, sf_dir):
    return report.task_mean_delta(_by_task(spark, sf_dir))


@b.query("task_distribution", "SELECT event_type AS task, count(*) AS examples FROM events GROUP BY 1")
def task_distribution(spark, sf_dir):
    return report.task_distribution(load(spark, sf_dir, "events"), "event_type")


@b.query(
    "faithfulness_subset",
    f"WITH {_RUNS_SQL} SELECT metric, baseline, finetuned FROM comparison WHERE metric IN ('lexical_faithfulness', 'nli_faithfulness', 'classification_accuracy')",
)
def faithfulness_subset(spark, sf_dir):
    return report.faithfulness_subset(_overall(spark, sf_dir))


@b.query(
    "sample_data_flag",
    """SELECT source, bool_or(lang = 'es' AND n_chars > 8000) OR NOT bool_or(n_chars > 9000) AS is_sample FROM documents GROUP BY source""",
)
def sample_data_flag(spark, sf_dir):
    """Sources as evaluation runs; long Spanish texts stand for a mock backend."""
    d = b.documents(spark, sf_dir)
    mock = (F.col("lang") == "es") & (F.col("n_chars") > 8000)
    runs = d.select(
        "source",
        F.when(mock, "Mock").otherwise("model").alias("backend"),
        (F.col("n_chars") > 9000).alias("has_comparison"),
    )
    return report.sample_data_flag(runs, ["source"])


_REQUIRED, _FORBIDDEN = ("the ", "que ", ". "), ("@", "TODO")


def _sql_marked(names, present: bool) -> str:
    test = "" if present else "NOT "
    cases = ", ".join(
        f"CASE WHEN {test}contains(text, {b.sql_str(n)}) THEN {b.sql_str(n)} END" for n in names
    )
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


@b.query(
    "required_marker_audit",
    f"""WITH m AS (SELECT doc_id, text, {_sql_marked(_REQUIRED, False)} AS mm, {_sql_marked(_FORBIDDEN, True)} AS fm, source = 'src1' AND NOT contains(text, 'of ') AS lm FROM documents)
SELECT doc_id, array_to_string(mm, '|') AS missing_markers, array_to_string(fm, '|') AS forbidden_markers, lm AS label_missing,
  len(mm) = 0 AND len(fm) = 0 AND NOT lm AND {b.sql_trim('text')} <> '' AS passed FROM m""",
)
def required_marker_audit(spark, sf_dir):
    d = b.documents(spark, sf_dir).select(
        "doc_id", "text", (F.col("source") == "src1").alias("flagged")
    )
    out = safety.required_marker_audit(d, "text", _REQUIRED, _FORBIDDEN, "flagged", "of ")
    return out.select(
        "doc_id",
        b.joined(F.col("missing_markers"), "|").alias("missing_markers"),
        b.joined(F.col("forbidden_markers"), "|").alias("forbidden_markers"),
        "label_missing",
        "passed",
    )


_RULES = (
    safety.MarkerRule("licence", texts=("Released under the mit license", "PERMISSION IS")),
    safety.MarkerRule("heading", patterns=(r"(?m)^#{1,6}\s+(?:\d+[.)]\s*)?[a-z]+", r"(?m)^[^\n]{1,40}\.$"), only_if="flagged"),
    safety.MarkerRule("shouting", patterns=(r"[A-Z]{6,}",), any_case=False, required=False),
    safety.MarkerRule("secrets", texts=("password", "Secret", "AKIA"), required=False),
)


def _sql_rule(rule) -> str:
    low = "lower(text)" if rule.any_case else "text"
    found = [f"contains({low}, {b.sql_str(t.lower() if rule.any_case else t)})" for t in rule.texts]
    found += [f"regexp_matches({low}, {b.sql_str(('(?i)' if rule.any_case else '') + p)})" for p in rule.patterns]
    wrong = f"({' OR '.join(found)})"
    if rule.required:
        wrong = f"NOT {wrong}"
    if rule.only_if:
        wrong = f"({wrong}) AND {rule.only_if}"
    return f"CASE WHEN {wrong} THEN {b.sql_str(rule.name)} END"


@b.query(
    "marker_rules_audit",
    f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source IN ('src1', 'src2') AS flagged FROM documents),
r AS (SELECT doc_id, text, list_filter([{', '.join(_sql_rule(r) for r in _RULES)}], lambda x: x IS NOT NULL) AS broken FROM d)
SELECT doc_id, array_to_string(broken, '|') AS broken_rules, len(broken) = 0 AND {b.sql_trim('text')} <> '' AS passed FROM r""",
)
def marker_rules_audit(spark, sf_dir):
    """Any-case markers, patterns and forbidden words, each rule met in one of several ways."""
    d = b.documents(spark, sf_dir).select("doc_id", "text", F.col("source").isin("src1", "src2").alias("flagged"))
    out = safety.marker_rules_audit(d, "text", _RULES)
    return out.select("doc_id", b.joined(F.col("broken_rules"), "|").alias("broken_rules"), "passed")


@b.query(
    "bank_term_hits",
    """WITH w AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS term FROM benchmark),
bank AS (SELECT term FROM w WHERE length(term) >= 5),
t AS (SELECT doc_id, lower(text) AS body FROM documents)
SELECT doc_id, count(*) AS n_terms, min(instr(body, term)) AS first_position, string_agg(term, '|' ORDER BY term) AS terms
FROM t JOIN bank ON contains(body, term) GROUP BY doc_id""",
)
def bank_term_hits(spark, sf_dir):
    """Which of all longer words of the benchmark each whole document holds, anywhere in it."""
    words = load(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("term"))
    bank = banks.bank_of(words.where(F.length("term") >= 5), "term")
    hits = banks.bank_hits(b.documents(spark, sf_dir), ["doc_id"], "text", bank)
    return hits.select(
        "doc_id", F.size("terms").cast("long").alias("n_terms"), "first_position", b.joined(F.col("terms"), "|").alias("terms")
    )
