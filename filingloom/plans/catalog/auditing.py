"""Splits, leakage, audits and training texts."""

from pyspark.sql import functions as F

from filingloom import constants as C
from filingloom.functions import prompts as pr
from filingloom.functions import text as tx
from filingloom.operators import audit, examples, safety, splits
from filingloom.operators.ranking import ordered_index
from filingloom.plans import builds
from filingloom.plans.catalog import base as b
from filingloom.plans.catalog.labelling import BANKS, built_examples, examples_sql
from filingloom.plans.catalog.manifests import SPLIT_SQL, split_docs
from filingloom.session import load
from filingloom.sources import filings as fl


@b.query(
    "company_key",
    f"""WITH {b.DOCS_SQL} SELECT doc_id, upper(coalesce(nullif(ticker, ''), nullif(cik, ''), 'UNK')) AS company FROM docs""",
)
def company_key(spark, sf_dir):
    key = splits.company_key(F.col("ticker"), F.col("cik"))
    return b.docs(spark, sf_dir).select("doc_id", key.alias("company"))


@b.query(
    "year_key",
    f"""WITH {b.FILINGS_SQL} SELECT o_orderkey, CASE WHEN filing_date = '' THEN '' ELSE CAST(CAST(substring(filing_date, 1, 4) AS INTEGER) AS VARCHAR) END AS year_key FROM filings""",
)
def year_key(spark, sf_dir):
    """The filing year as text, empty where there is none."""
    key = splits.year_key(fl.filing_year(F.col("filing_date")))
    return b.filings(spark, sf_dir).select("o_orderkey", key.alias("year_key"))


@b.query(
    "company_holdout_split",
    f"WITH {b.DOCS_SQL}, {SPLIT_SQL} SELECT doc_id, company, split FROM split_docs",
)
def company_holdout_split(spark, sf_dir):
    return split_docs(spark, sf_dir).select("doc_id", "company", "split")


_TIME_SQL = f"""{b.FILINGS_SQL},
dated AS (SELECT *, substring(filing_date, 1, 4) AS "year" FROM filings),
years AS (SELECT "year", row_number() OVER (ORDER BY "year" DESC) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT "year" FROM dated)),
wish AS (SELECT *, greatest(1, CAST(round_even(n * 0.05, 0) AS BIGINT)) AS t, greatest(1, CAST(round_even(n * 0.10, 0) AS BIGINT)) AS v FROM years),
time_split AS (SELECT dated.*, CASE WHEN n <= 1 THEN 'train' WHEN rn <= t THEN 'test' WHEN rn <= t + v THEN 'validation' ELSE 'train' END AS split
  FROM dated JOIN wish USING ("year"))"""


def _time_split(spark, sf_dir):
    f = b.filings(spark, sf_dir).withColumn("year", F.substring("filing_date", 1, 4))
    return splits.split_examples(f, splits.year_key(F.col("year")), "time_holdout")


@b.query("time_holdout_split", f'WITH {_TIME_SQL} SELECT o_orderkey, "year", split FROM time_split')
def time_holdout_split(spark, sf_dir):
    return _time_split(spark, sf_dir).select("o_orderkey", "year", "split")


@b.query(
    "time_holdout_by_filing",
    f"""WITH {b.FILINGS_SQL}, k AS (SELECT o_orderkey, filing_date || '/' || accession_number AS moment FROM filings),
r AS (SELECT *, row_number() OVER (ORDER BY moment DESC) AS rn, count(*) OVER () AS n FROM k),
w AS (SELECT *, greatest(1, CAST(round_even(n * 0.05, 0) AS BIGINT)) AS t, greatest(1, CAST(round_even(n * 0.10, 0) AS BIGINT)) AS v FROM r)
SELECT o_orderkey, moment, CASE WHEN rn <= t THEN 'test' WHEN rn <= t + v THEN 'validation' ELSE 'train' END AS split FROM w""",
)
def time_holdout_by_filing(spark, sf_dir):
    """Newest filings held out one by one: as many keys as rows."""
    moment = F.concat_ws("/", "filing_date", "accession_number")
    rows = b.filings(spark, sf_dir).select("o_orderkey", moment.alias("moment"))
    return splits.split_examples(rows, F.col("moment"), "time_holdout")


@b.query(
    "allocate_groups",
    """WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL),
w AS (SELECT *, greatest(1, CAST(round_even(n * 0.05, 0) AS BIGINT)) AS t, greatest(1, CAST(round_even(n * 0.10, 0) AS BIGINT)) AS v FROM g),
x AS (SELECT *, CASE WHEN t + v > n - 1 THEN greatest(1, n - 1 - t) ELSE v END AS v2 FROM w)
SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment, n, CASE WHEN n <= 1 THEN 0 WHEN t + v2 > n - 1 THEN greatest(1, n - 1 - v2) ELSE t END AS n_test,
  CASE WHEN n <= 1 THEN 0 ELSE v2 END AS n_validation FROM x""",
)
def allocate_groups(spark, sf_dir):
    groups = load(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n")
    )
    test, validation = splits.allocation(F.col("n"), 0.10, 0.05)
    return groups.withColumns({"n_test": test, "n_validation": validation})


_HELD_SQL = """held AS (SELECT ticker AS group_key, bool_or(split = 'train') AS a, bool_or(split = 'validation') AS v, bool_or(split = 'test') AS t FROM time_split GROUP BY ticker)"""


@b.query(
    "leakage_check",
    f"""WITH {_TIME_SQL}, {_HELD_SQL} SELECT count(*) FILTER (a AND t) AS train_test_overlap, count(*) FILTER (a AND v) AS train_validation_overlap,
  count(*) FILTER (v AND t) AS validation_test_overlap, count(*) FILTER (a AND t) = 0 AS passed FROM held""",
)
def leakage_check(spark, sf_dir):
    """Companies shared between the parts of a time split."""
    return splits.leakage_check(_time_split(spark, sf_dir), F.col("ticker"))


@b.query(
    "leakage_overlaps",
    f"""WITH {_TIME_SQL}, {_HELD_SQL} SELECT 'train_test' AS pair, group_key FROM held WHERE a AND t
UNION ALL SELECT 'train_validation', group_key FROM held WHERE a AND v UNION ALL SELECT 'validation_test', group_key FROM held WHERE v AND t""",
)
def leakage_overlaps(spark, sf_dir):
    return splits.leakage_overlaps(_time_split(spark, sf_dir), F.col("ticker"))


# companies are taken from the examples: documents without tasks have none
_STATS_SQL = f"""WITH {examples_sql(BANKS)}, {SPLIT_SQL.replace("FROM docs)", "FROM docs WHERE section <> 'other')", 1)},
e AS (SELECT x.split, task_type, s.section, length(input) AS n_in, length(output) AS n_out FROM examples s JOIN split_docs x USING (doc_id)),
g AS (SELECT split, task_type, section, grouping(split, task_type, section) AS gid, count(*) AS examples, avg(n_in) AS mi, avg(n_out) AS mo,
  min(n_in) AS min_input_length, max(n_in) AS max_input_length FROM e GROUP BY GROUPING SETS ((split), (task_type), (section), ()))
SELECT CASE gid WHEN 3 THEN 'split' WHEN 5 THEN 'task_type' WHEN 6 THEN 'section' ELSE 'total' END AS scope, coalesce(split, task_type, section, 'all') AS name,
  examples, {b.sql_round('mi', 2)} AS average_input_length, {b.sql_round('mo', 2)} AS average_output_length, min_input_length, max_input_length FROM g"""


def split_examples(spark, sf_dir):
    """Examples of all documents with their company-holdout split."""
    built = built_examples(spark, sf_dir, **BANKS).withColumn("section", F.col("metadata.section"))
    key = splits.company_key(F.col("metadata.ticker"), F.col("metadata.cik"))
    usable = examples.usable_sections(b.docs(spark, sf_dir))
    groups = usable.select(splits.company_key(F.col("ticker"), F.col("cik")))
    return splits.split_examples(built, key, groups=groups)


@b.query("dataset_stats", _STATS_SQL)
def dataset_stats(spark, sf_dir):
    return splits.dataset_stats(split_examples(spark, sf_dir))


_PROFILE_SQL = f"""WITH {_TIME_SQL}"""


def _profile_input(spark, sf_dir):
    return _time_split(spark, sf_dir).withColumn("company", F.col("ticker"))


@b.query(
    "split_profile",
    f"""{_PROFILE_SQL} SELECT split, count(*) AS examples, count(DISTINCT ticker) AS unique_tickers, count(DISTINCT cik) AS unique_ciks,
  min(nullif("year", '')) AS first_year, max(nullif("year", '')) AS last_year FROM time_split GROUP BY split""",
)
def split_profile(spark, sf_dir):
    return splits.split_profile(_profile_input(spark, sf_dir))


@b.query(
    "split_members",
    f"""{_PROFILE_SQL} SELECT DISTINCT split, 'company' AS kind, ticker AS value FROM time_split UNION SELECT split, 'cik', cik FROM time_split
UNION SELECT split, 'year', "year" FROM time_split WHERE "year" <> ''""",
)
def split_members(spark, sf_dir):
    return splits.split_members(_profile_input(spark, sf_dir))


_LINES_SQL = """lines AS (
  SELECT conv_id, turn, role AS file, CASE
    WHEN role = 'system' THEN '{"id": "broken'
    WHEN role = 'assistant' THEN '{"id": "' || conv_id || '-' || turn || '", "instruction": "Answer.", "input": ' || to_json(text)::VARCHAR || ', "output": ' || to_json(text)::VARCHAR
      || ', "task_type": "filing_qa", "metadata": {"ticker": "T"}, "split": "' || CASE WHEN turn > 3 THEN 'holdout' ELSE 'train' END || '"}'
    WHEN turn = 0 THEN '{"id": "' || conv_id || '-' || turn || '", "instruction": "  ", "input": null, "task_type": null, "metadata": {}}'
    WHEN turn = 2 THEN '{"id": " ", "instruction": ' || to_json(text)::VARCHAR || ', "input": "", "output": 5, "task_type": "bogus", "metadata": [1], "split": null}'
    ELSE '  ' END AS line
  FROM conversations)"""


def _json_lines(spark, sf_dir):
    """Turns as raw example lines of one file per role, with planted faults."""
    c = load(spark, sf_dir, "conversations")
    ident = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    text = tx.json_text(F.col("text"))
    valid = F.concat(
        F.lit('{"id": "'), ident, F.lit('", "instruction": "Answer.", "input": '), text,
        F.lit(', "output": '), text,
        F.lit(', "task_type": "filing_qa", "metadata": {"ticker": "T"}, "split": "'),
        F.when(F.col("turn") > 3, "holdout").otherwise("train"), F.lit('"}'),
    )
    absent = F.concat(
        F.lit('{"id": "'), ident,
        F.lit('", "instruction": "  ", "input": null, "task_type": null, "metadata": {}}'),
    )
    wrong = F.concat(
        F.lit('{"id": " ", "instruction": '), text,
        F.lit(', "input": "", "output": 5, "task_type": "bogus", "metadata": [1], "split": null}'),
    )
    line = (
        F.when(F.col("role") == "system", '{"id": "broken')
        .when(F.col("role") == "assistant", valid)
        .when(F.col("turn") == 0, absent)
        .when(F.col("turn") == 2, wrong)
        .otherwise("  ")
    )
    return c.select("conv_id", "turn", F.col("role").alias("file"), line.alias("line"))


def _sql_errors() -> str:
    checks = []
    for name in audit.REQUIRED:
        checks.append(
            f"CASE WHEN NOT json_exists(line, '$.{name}') THEN 'missing field ''{name}''' "
            f"WHEN json_type(line, '$.{name}') = 'NULL' THEN 'null field ''{name}''' END"
        )
    for name in ("id", "instruction"):
        checks.append(
            f"CASE WHEN NOT json_exists(line, '$.{name}') OR trim(json_extract_string(line, '$.{name}')) = '' THEN 'empty {name}' END"
        )
    for name in ("input", "output"):
        checks.append(
            f"CASE WHEN NOT json_exists(line, '$.{name}') OR json_extract_string(line, '$.{name}') = '' THEN 'empty {name}' END"
        )
    for name, allowed in (("task_type", C.TASK_TYPES), ("split", C.SPLITS)):
        names = ", ".join(b.sql_str(a) for a in allowed)
        check = (
            f"CASE WHEN json_extract_string(line, '$.{name}') NOT IN ({names}) "
            f"THEN 'invalid {name} ''' || json_extract_string(line, '$.{name}') || '''' END"
        )
        checks.append(check)
    meta = "CASE WHEN json_exists(line, '$.metadata') AND json_type(line, '$.metadata') <> 'OBJECT' THEN 'metadata is not an object' END"
    checks.insert(len(checks) - 1, meta)
    return "list_filter([" + ", ".join(checks) + "], lambda e: e IS NOT NULL)"


_VALIDATED_SQL = f"""{_LINES_SQL},
validated AS (SELECT conv_id, turn, file, CASE WHEN line IS NOT NULL THEN {_sql_errors()} ELSE ['JSON parse error'] END AS errors
  FROM (SELECT conv_id, turn, file, CASE WHEN json_valid(line) THEN line END AS line FROM lines WHERE trim(line) <> ''))"""


def _validated(spark, sf_dir):
    return audit.validate_lines(_json_lines(spark, sf_dir)).select("conv_id", "turn", "file", "errors")


@b.query(
    "validate_examples",
    f"WITH {_VALIDATED_SQL} SELECT conv_id, turn, file, array_to_string(errors, '; ') AS errors FROM validated",
)
def validate_examples(spark, sf_dir):
    return _validated(spark, sf_dir).withColumn("errors", b.joined(F.col("errors"), "; "))


_REPORT_SQL = """report AS (
  SELECT f.file, count(v.file) AS total_examples, count(*) FILTER (len(v.errors) = 0) AS valid_examples, count(*) FILTER (len(v.errors) > 0) AS invalid_examples,
    count(v.file) > 0 AS found, count(*) FILTER (len(v.errors) > 0) = 0 AS passed
  FROM (SELECT DISTINCT file FROM lines UNION SELECT 'absent') f LEFT JOIN validated v ON v.file = f.file GROUP BY f.file)"""


def _report(spark, sf_dir):
    names = _json_lines(spark, sf_dir).select("file").distinct()
    absent = spark.range(1).select(F.lit("absent").alias("file"))
    return audit.file_report(_validated(spark, sf_dir), names.union(absent))


@b.query("file_report", f"WITH {_VALIDATED_SQL}, {_REPORT_SQL} SELECT * FROM report")
def file_report(spark, sf_dir):
    """Per file; the file that does not exist is reported and passes."""
    return _report(spark, sf_dir)


@b.query(
    "duplicate_ids",
    "SELECT lang || '-' || CAST(n_chars AS VARCHAR) AS id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_ids(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    ids = d.select(F.concat_ws("-", "lang", F.col("n_chars").cast("string")).alias("id"))
    return audit.duplicate_ids(ids)


@b.query(
    "task_coverage",
    """SELECT coalesce(x.t, s.event_type) AS task_type, x.t IS NOT NULL AS expected, s.event_type IS NOT NULL AS present, coalesce(s.n, 0) AS examples
FROM (VALUES ('click'), ('view'), ('refund'), ('error')) x(t) FULL JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) s ON s.event_type = x.t""",
)
def task_coverage(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("task_type"))
    return audit.task_coverage(e, ("click", "view", "refund", "error"))


@b.query(
    "dataset_gate",
    f"""WITH {_VALIDATED_SQL}, {_REPORT_SQL}, {b.DOCS_SQL}, {SPLIT_SQL},
dup AS (SELECT count(*) AS duplicate_ids FROM (SELECT 1 FROM documents GROUP BY lang, n_chars HAVING count(*) > 1)),
leak AS (SELECT count(*) AS train_test_overlap FROM (SELECT company FROM split_docs WHERE split = 'train' INTERSECT SELECT company FROM split_docs WHERE split = 'test')),
files AS (SELECT bool_and(passed) AS files_valid, CAST(sum(invalid_examples) AS BIGINT) AS invalid_examples FROM report)
SELECT files_valid, invalid_examples, duplicate_ids, train_test_overlap, files_valid AND duplicate_ids = 0 AND train_test_overlap = 0 AS passed
FROM files, dup, leak""",
)
def dataset_gate(spark, sf_dir):
    leak = splits.leakage_check(split_docs(spark, sf_dir), F.col("company"))
    return audit.dataset_gate(_report(spark, sf_dir), duplicate_ids(spark, sf_dir), leak)


_GATE_JOB_SQL = """WITH d AS (SELECT text, source, CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'validation' ELSE 'train' END AS split FROM documents),
apart AS (SELECT count(*) AS train_test_overlap FROM (SELECT source FROM d WHERE split = 'train' INTERSECT SELECT source FROM d WHERE split = 'test'))
SELECT count(*) FILTER (text = '') = 0 AS files_valid, count(*) FILTER (text = '') AS invalid_examples, CAST(0 AS BIGINT) AS duplicate_ids,
  any_value(train_test_overlap) AS train_test_overlap, CAST(0 AS BIGINT) AS unplaced,
  count(*) FILTER (text = '') = 0 AND any_value(train_test_overlap) = 0 AS passed
FROM d, apart"""


@b.query("audit_job", _GATE_JOB_SQL)
def audit_job(spark, sf_dir):
    """The gate over raw lines of all documents, in files below a folder with a split's name in it."""
    d = load(spark, sf_dir, "documents")
    tenth = F.col("doc_id") % 10
    split = F.when(tenth == 0, "test").when(tenth == 1, "validation").otherwise("train")
    example = F.struct(
        F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("id"),
        F.lit("Answer from the filing.").alias("instruction"),
        F.col("text").alias("input"),
        F.col("lang").alias("output"),
        F.lit("filing_qa").alias("task_type"),
        F.struct(F.col("source").alias("ticker")).alias("metadata"),
    )
    lines = d.select(F.concat(F.lit("/data/latest/"), split, F.lit(".jsonl")).alias("file"), F.to_json(example).alias("line"))
    return builds.audit_dataset(lines)


_PATH_SQL = """CASE lang WHEN 'en' THEN 'src/' || source || '.PY' WHEN 'de' THEN 'src/tests/' || source || '.py'
  WHEN 'fr' THEN 'docs/' || source || '.md' ELSE 'conf/' || source || CASE WHEN doc_id % 2 = 0 THEN '.env.example' ELSE '.env' END END"""


@b.query(
    "secret_file_rule",
    f"""SELECT doc_id, path, lang = 'en' OR (lang = 'es' AND doc_id % 2 = 1) AS scanned FROM (SELECT doc_id, lang, {_PATH_SQL} AS path FROM documents)""",
)
def secret_file_rule(spark, sf_dir):
    """Which of the files are to be scanned: by kind, test folder and example settings."""
    lang, source, even = F.col("lang"), F.col("source"), F.col("doc_id") % 2 == 0
    path = (
        F.when(lang == "en", F.concat(F.lit("src/"), source, F.lit(".PY")))
        .when(lang == "de", F.concat(F.lit("src/tests/"), source, F.lit(".py")))
        .when(lang == "fr", F.concat(F.lit("docs/"), source, F.lit(".md")))
        .otherwise(F.concat(F.lit("conf/"), source, F.when(even, ".env.example").otherwise(".env")))
    )
    return load(spark, sf_dir, "documents").select("doc_id", path.alias("path"), safety.scannable(path).alias("scanned"))


@b.query(
    "length_filter",
    f"WITH {b.PAIRS_SQL} SELECT conv_id, turn FROM pairs WHERE length(question) >= 100 AND length(answer) >= 10",
)
def length_filter(spark, sf_dir):
    rows = b.pairs(spark, sf_dir).withColumnsRenamed({"question": "input", "answer": "output"})
    return audit.length_filter(rows).select("conv_id", "turn")


_TRAIN_SQL = f"""{b.PAIRS_SQL},
train AS (SELECT conv_id, turn, '  Answer the question.  ' AS instruction, question AS input, CASE WHEN length(answer) < 300 THEN '   ' ELSE answer || chr(10) END AS output,
  CASE WHEN turn = 1 THEN NULL ELSE 'filing_qa' END AS task_type FROM pairs)"""


def _train(spark, sf_dir):
    return b.pairs(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.lit("  Answer the question.  ").alias("instruction"),
        F.col("question").alias("input"),
        F.when(F.length("answer") < 300, "   ")
        .otherwise(F.concat("answer", F.lit("\n")))
        .alias("output"),
        F.when(F.col("turn") != 1, "filing_qa").alias("task_type"),
    )


@b.query(
    "sft_validate",
    f"""WITH {_TRAIN_SQL} SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN trim(output) = '' THEN 'empty field ''output''' END,
  CASE WHEN task_type IS NULL THEN 'empty field ''task_type''' END], lambda x: x IS NOT NULL), '; ') AS errors FROM train""",
)
def sft_validate(spark, sf_dir):
    checked = audit.training_errors(_train(spark, sf_dir))
    return checked.select("conv_id", "turn", b.joined(F.col("errors"), "; ").alias("errors"))


_SFT = f"""'<s>[INST] You are FilingAssistant, a financial filing analysis assistant.' || chr(10) || 'Answer using only the provided filing excerpt. Do not provide investment advice.'
  || chr(10) || chr(10) || 'Task Type:' || chr(10) || coalesce(task_type, '') || chr(10) || chr(10) || 'Instruction:' || chr(10) || trim(instruction) || chr(10) || chr(10)
  || 'Filing Excerpt:' || chr(10) || {b.sql_trim('input')} || chr(10) || '[/INST]' || chr(10) || {b.sql_trim('output')} || '</s>'"""


@b.query(
    "sft_text",
    f"""WITH {_TRAIN_SQL} SELECT conv_id, turn, {_SFT} AS text,
  '<s>[INST] ' || instruction || chr(10) || chr(10) || input || ' [/INST] ' || output || '</s>' AS plain FROM train""",
)
def sft_text(spark, sf_dir):
    rows = audit.with_training_text(_train(spark, sf_dir))
    plain = pr.sft_text_plain(F.col("instruction"), F.col("input"), F.col("output"))
    return rows.select("conv_id", "turn", "text", plain.alias("plain"))


@b.query(
    "sft_token_stats",
    f"WITH {_TRAIN_SQL} SELECT count(*) AS examples, avg(len({b.sql_words(_SFT)})) AS mean_tokens FROM train",
)
def sft_token_stats(spark, sf_dir):
    return audit.training_token_stats(audit.with_training_text(_train(spark, sf_dir)))


_DRY_SQL = f"""{_TRAIN_SQL},
dry AS (SELECT *, CASE WHEN conv_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split FROM train),
placed AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY conv_id, turn) - 1 AS position FROM dry)"""


def _dry_run(spark, sf_dir):
    """Training rows in two splits, numbered within each."""
    split = F.when(F.col("conv_id") % 5 == 0, "validation").otherwise("train")
    rows = _train(spark, sf_dir).withColumn("split", split)
    ranges = F.floor(F.col("conv_id") / 4096).cast("int")
    placed = ordered_index(rows, ["split"], [F.col("conv_id"), F.col("turn")], ranges, "position")
    return placed.withColumn("position", F.col("position") - 1)


@b.query(
    "sft_dry_run_errors",
    f"""WITH {_DRY_SQL} SELECT split, position, split || '[' || CAST(position AS VARCHAR) || ']: ' || e AS message FROM (
  SELECT split, position, unnest(list_filter([CASE WHEN trim(output) = '' THEN 'empty field ''output''' END,
    CASE WHEN task_type IS NULL THEN 'empty field ''task_type''' END], lambda x: x IS NOT NULL)) AS e FROM placed)""",
)
def sft_dry_run_errors(spark, sf_dir):
    return audit.dry_run_errors(_dry_run(spark, sf_dir))


@b.query(
    "sft_dry_run_summary",
    f"""WITH {_DRY_SQL} SELECT CAST(count(*) FILTER (trim(output) = '') + count(*) FILTER (task_type IS NULL) AS BIGINT) AS errors,
  count(*) FILTER (split = 'train') AS train_examples, count(*) FILTER (split = 'validation') AS validation_examples,
  avg(len({b.sql_words(_SFT)})) FILTER (split = 'train') AS mean_tokens FROM placed""",
)
def sft_dry_run_summary(spark, sf_dir):
    return audit.dry_run_summary(_dry_run(spark, sf_dir))


@b.query(
    "loss_history",
    """WITH logs AS (SELECT user_id AS run, event_id AS step, CASE WHEN event_type = 'click' THEN CASE WHEN value > 150 THEN 'Infinity'::DOUBLE ELSE value END END AS loss,
  CASE WHEN event_type = 'purchase' THEN value END AS eval_loss FROM events)
SELECT run, arg_max(loss, step) FILTER (loss IS NOT NULL) AS final_train_loss, arg_max(eval_loss, step) FILTER (eval_loss IS NOT NULL) AS final_eval_loss,
  min(step) FILTER (isinf(loss)) AS first_bad_step, coalesce(bool_or(isinf(loss)), false) AS has_bad_loss FROM logs GROUP BY run""",
)
def loss_history(spark, sf_dir):
    """Events as training logs of one run per user; large values stand for divergence."""
    value = F.when(F.col("value") > 150, F.lit(float("inf"))).otherwise(F.col("value"))
    logs = load(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("step"),
        F.when(F.col("event_type") == "click", value).alias("loss"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("eval_loss"),
    )
    return audit.loss_history(logs)
