"""Instruction examples and weak labels."""

from pyspark.sql import functions as F

from filingloom import constants as C
from filingloom.functions import labels as lb
from filingloom.functions import text as tx
from filingloom.operators import chunks, examples
from filingloom.plans.catalog import base as b
from filingloom.plans.catalog.extraction import chunk_sql
from filingloom.session import load, spread

# banks that occur in the driver's invented prose
BANKS = {
    "yoy_terms": ("the ", "les ", "nicht"),
    "risk_terms": ("and", "que ", "eine"),
    "revenue_terms": ("with", "dans", "para"),
    "positive": ("the", "en", "que"),
    "negative": ("an", "er", "de"),
}

_TASKS_VALUES = ", ".join(
    f"({b.sql_str(s)}, {i}, {b.sql_str(t)})"
    for s, tasks in C.SECTION_TASKS.items()
    for i, t in enumerate(tasks)
)
ROUTING_SQL = f"routing(section, task_pos, task_type) AS (VALUES {_TASKS_VALUES})"


@b.query(
    "task_routing",
    f"WITH {b.DOCS_SQL}, {ROUTING_SQL} SELECT doc_id, section, CAST(task_pos AS BIGINT) AS task_pos, task_type FROM docs JOIN routing USING (section)",
)
def task_routing(spark, sf_dir):
    return examples.route_tasks(b.docs(spark, sf_dir).select("doc_id", "section"))


@b.query(
    "task_routing_allowed",
    f"WITH {b.DOCS_SQL}, {ROUTING_SQL} SELECT doc_id, task_type FROM docs JOIN routing USING (section) WHERE task_type IN ('filing_qa', 'yoy_comparison')",
)
def task_routing_allowed(spark, sf_dir):
    rows = b.docs(spark, sf_dir).select("doc_id", "section")
    return examples.route_tasks(rows, ["filing_qa", "yoy_comparison"]).select("doc_id", "task_type")


_CHUNK_COLS = "doc_id, section, ticker, cik, form, filing_date, accession_number"
_CHUNKS_SQL = f"""{b.DOCS_SQL}, {chunk_sql('docs', _CHUNK_COLS)},
sents AS (SELECT *, {b.sql_sentences('text')} AS s FROM chunks)"""


def _bulleted(items: str, fallback: str) -> str:
    return (
        f"CASE WHEN len({items}) > 0 THEN '- ' || array_to_string({items}, chr(10) || '- ') "
        f"ELSE {b.sql_str(fallback)} END"
    )


def _keyword(terms, fallback: str, s: str = "s") -> str:
    hits = f"list_filter({s}, lambda x: {b.sql_contains_any('lower(x)', terms)})[1:5]"
    return _bulleted(hits, fallback)


def _figures(t: str) -> str:
    found = (
        f"list_transform(list_concat(regexp_extract_all({t}, '{C.MONEY}'), regexp_extract_all({t}, '{C.PERCENT}'), "
        f"regexp_extract_all({t}, '(?i){C.MAGNITUDE}'), regexp_extract_all({t}, '(?i){C.BASIS_POINTS}')), lambda x: trim(x))"
    )
    return b.sql_distinct_ordered(found)


def _metric(t: str) -> str:
    return _bulleted(_figures(t), C.NO_METRIC)


def _analyst(t: str = "text", s: str = "s") -> str:
    summary = b.sql_summary(s, t, 3)
    return (
        f"'Analyst Summary: ' || ({summary}) || chr(10) || 'Key Point: ' || coalesce({s}[1], {summary}) "
        f"|| chr(10) || 'Evidence: ' || substring({b.sql_trim(t)}, 1, 200)"
    )


def _count(t: str, terms) -> str:
    return " + ".join(
        f"(length({t}) - length(replace({t}, {b.sql_str(x)}, ''))) // {len(x)}" for x in terms
    )


def _outlook(t: str, positive, negative) -> str:
    p, n = f"({_count(f'lower({t})', positive)})", f"({_count(f'lower({t})', negative)})"
    return (
        f"'{{\"label\": \"' || CASE WHEN {p} > {n} THEN 'positive' WHEN {n} > {p} THEN 'negative' ELSE 'neutral' END "
        f"|| '\", \"reason\": \"Found ' || CAST({p} AS VARCHAR) || ' positive and ' || CAST({n} AS VARCHAR) "
        "|| ' negative outlook term(s) in the excerpt (template keyword scoring).\"}'"
    )


_DRAWN = "(chunk_id % 2 = 0 AND len(s) > 0)"
_CLAIM_INPUT = f"text || chr(10) || chr(10) || 'Proposed answer: ' || CASE WHEN {_DRAWN} THEN s[1] ELSE {b.sql_str(C.FALSE_CLAIM)} END"
_CLAIM = (
    f"CASE WHEN {_DRAWN} THEN '{{\"supported\": true, \"reason\": \"{C.REASON_TRUE}\"}}' "
    f"ELSE '{{\"supported\": false, \"reason\": \"{C.REASON_FALSE}\"}}' END"
)


def _answer_case(banks: dict) -> str:
    return f"""CASE task_type
  WHEN 'risk_summary' THEN {b.sql_summary('s', 'text', 4)}
  WHEN 'mda_explanation' THEN {b.sql_summary('s', 'text', 4)}
  WHEN 'metric_extraction' THEN {_metric('text')}
  WHEN 'yoy_comparison' THEN {_keyword(banks.get('yoy_terms', C.YOY_TERMS), C.NO_YOY)}
  WHEN 'business_risk_identification' THEN {_keyword(banks.get('risk_terms', C.RISK_TERMS), C.NO_RISK)}
  WHEN 'revenue_driver_explanation' THEN {_keyword(banks.get('revenue_terms', C.REVENUE_TERMS), C.NO_DRIVER)}
  WHEN 'filing_qa' THEN {b.sql_summary('s', 'text', 3)}
  WHEN 'analyst_summary' THEN {_analyst()}
  WHEN 'outlook_classification' THEN {_outlook('text', banks.get('positive', C.POSITIVE_TERMS), banks.get('negative', C.NEGATIVE_TERMS))}
  ELSE {_CLAIM} END"""


_INSTRUCTION_CASE = "CASE task_type " + " ".join(
    f"WHEN {b.sql_str(t)} THEN {b.sql_str(C.INSTRUCTIONS[t])}" for t in C.TASK_TYPES
) + " END"
_COMPANY = "coalesce(nullif(ticker, ''), nullif(cik, ''), 'UNK')"
_YEAR = "coalesce(nullif(substring(filing_date, 1, 4), ''), 'XXXX')"
_ID = (
    f"upper({_COMPANY}) || '-' || {_YEAR} || '-' || replace(form, '/', '-') || '-' || "
    "right(replace(accession_number, '-', ''), 6) || '-' || section || '-' || CAST(chunk_id AS VARCHAR) || '-' || task_type"
)
_SOURCE = f"{_COMPANY} || ' ' || {_YEAR} || ' ' || form || ' ' || section"


def examples_sql(banks: dict) -> str:
    """CTEs ending in ``examples``."""
    return f"""{_CHUNKS_SQL}, {ROUTING_SQL},
examples AS (
  SELECT doc_id, chunk_id, CAST(task_pos AS BIGINT) AS task_pos, {_ID} AS id, {_INSTRUCTION_CASE} AS instruction,
    CASE WHEN task_type = 'hallucination_detection' THEN {_CLAIM_INPUT} ELSE text END AS input,
    {_answer_case(banks)} AS output, task_type, {_SOURCE} AS source, section, token_count, ticker, cik, form,
    substring(filing_date, 1, 4) AS "year"
  FROM sents JOIN routing USING (section))"""


def built_examples(spark, sf_dir, **banks):
    return examples.build_examples(spread(b.docs(spark, sf_dir)), keys=["doc_id"], **banks)


_FLAT = ("doc_id", "chunk_id", "task_pos", "id", "instruction", "input", "output", "task_type", "source")


@b.query(
    "example_build",
    f"WITH {examples_sql(BANKS)} SELECT {', '.join(_FLAT)}, section, token_count, 'template_extractive' AS generation_method, true AS weak_supervision FROM examples",
)
def example_build(spark, sf_dir):
    return built_examples(spark, sf_dir, **BANKS).select(
        *_FLAT,
        "metadata.section",
        "metadata.token_count",
        "metadata.generation_method",
        "metadata.weak_supervision",
    )


@b.query(
    "example_build_default_terms",
    f"WITH {examples_sql({})} SELECT id, output FROM examples",
)
def example_build_default_terms(spark, sf_dir):
    return built_examples(spark, sf_dir).select("id", "output")


@b.query("example_id", f"WITH {examples_sql(BANKS)} SELECT doc_id, chunk_id, task_type, id FROM examples")
def example_id(spark, sf_dir):
    return built_examples(spark, sf_dir, **BANKS).select("doc_id", "chunk_id", "task_type", "id")


@b.query("source_label", f"WITH {b.DOCS_SQL} SELECT doc_id, {_SOURCE} AS source FROM docs")
def source_label(spark, sf_dir):
    d = examples.filing_metadata(b.docs(spark, sf_dir))
    return d.select("doc_id", examples.source_label(F.col("metadata")).alias("source"))


def _doc_label(key: str, sql: str, make):
    """Registers one label over whole documents (chunk number: the document's line count)."""
    cte = f"WITH sents AS (SELECT doc_id, text, {b.sql_sentences('text')} AS s, len(string_split(text, chr(10))) AS chunk_id FROM documents)"

    @b.query(key, f"{cte} SELECT doc_id, {sql} AS label FROM sents")
    def run(spark, sf_dir):
        d = b.documents(spark, sf_dir).select(
            "doc_id",
            "text",
            tx.sentences(F.col("text")).alias("s"),
            F.size(F.split("text", "\n")).alias("chunk_id"),
        )
        return d.select("doc_id", make(F.col("text"), F.col("s")).alias("label"))


_doc_label("label_risk_summary", b.sql_summary("s", "text", 4), lambda t, s: lb.summary_label(t, s, 4))
_doc_label("label_mda_explanation", b.sql_summary("s", "text", 4), lambda t, s: lb.summary_label(t, s))
_doc_label("label_metric_extraction", _metric("text"), lambda t, s: lb.metric_label(t))
_doc_label(
    "label_yoy_comparison",
    _keyword(BANKS["yoy_terms"], C.NO_YOY),
    lambda t, s: lb.keyword_label(s, BANKS["yoy_terms"], C.NO_YOY),
)
_doc_label(
    "label_business_risk",
    _keyword(BANKS["risk_terms"], C.NO_RISK),
    lambda t, s: lb.keyword_label(s, BANKS["risk_terms"], C.NO_RISK),
)
_doc_label(
    "label_revenue_driver",
    _keyword(BANKS["revenue_terms"], C.NO_DRIVER),
    lambda t, s: lb.keyword_label(s, BANKS["revenue_terms"], C.NO_DRIVER),
)
_doc_label("label_filing_qa", b.sql_summary("s", "text", 3), lambda t, s: lb.summary_label(t, s, 3))
_doc_label("label_analyst_summary", _analyst(), lambda t, s: lb.analyst_label(t, s))
_doc_label(
    "label_outlook",
    _outlook("text", BANKS["positive"], BANKS["negative"]),
    lambda t, s: lb.outlook_label(t, BANKS["positive"], BANKS["negative"]),
)
_doc_label(
    "label_hallucination",
    f"{_CLAIM} || chr(10) || {_CLAIM_INPUT}",
    lambda t, s: F.concat(
        lb.claim_label(lb.claim_is_drawn(F.col("chunk_id"), s)),
        F.lit("\n"),
        lb.claim_input(t, lb.claim_is_drawn(F.col("chunk_id"), s), s),
    ),
)


@b.query(
    "task_type_check",
    "SELECT event_id, event_type AS task_type, event_type IN ('click', 'view', 'purchase') AS known FROM events",
)
def task_type_check(spark, sf_dir):
    """Event types checked against a supplied list of known types."""
    task = F.col("event_type")
    known = examples.is_task_type(task, ("click", "view", "purchase"))
    return load(spark, sf_dir, "events").select("event_id", task.alias("task_type"), known.alias("known"))


@b.query(
    "cap_examples",
    f"WITH {examples_sql(BANKS)} SELECT id, doc_id, chunk_id, task_pos FROM examples ORDER BY doc_id, chunk_id, task_pos LIMIT 100",
)
def cap_examples(spark, sf_dir):
    built = built_examples(spark, sf_dir, **BANKS).select("id", "doc_id", "chunk_id", "task_pos")
    return examples.cap_examples(built, ["doc_id", "chunk_id", "task_pos"], 100)


def _rewrite_sql(t: str, old: str) -> str:
    s = b.sql_sentences(b.sql_trim(t))
    return (
        f"CASE WHEN len({s}) > 0 THEN array_to_string({s}[1:3], ' ') ELSE "
        f"coalesce(nullif(substring({b.sql_trim(t)}, 1, 300), ''), {b.sql_trim(old)}) END"
    )


@b.query(
    "rewrite_targets_offline",
    f"WITH {examples_sql(BANKS)} SELECT id, {_rewrite_sql('input', 'output')} AS output, 'llm_assisted_mock' AS generation_method, true AS enhanced, false AS weak_supervision, 'mock' AS enhancement_model FROM examples",
)
def rewrite_targets_offline(spark, sf_dir):
    return examples.rewrite_targets(built_examples(spark, sf_dir, **BANKS)).select(
        "id",
        "output",
        "metadata.generation_method",
        "metadata.enhanced",
        "metadata.weak_supervision",
        "metadata.enhancement_model",
    )


@b.query(
    "rewrite_prompt",
    f"""WITH {examples_sql(BANKS)} SELECT id, 'Task type: ' || task_type || chr(10) || 'Instruction: ' || instruction || chr(10) || chr(10)
  || 'Filing excerpt:' || chr(10) || {b.sql_trim('input')} || chr(10) || chr(10) || 'Weak draft answer to improve:' || chr(10) || {b.sql_trim('output')}
  || chr(10) || chr(10) || 'Return only the improved answer.' AS rewrite_prompt FROM examples""",
)
def rewrite_prompt(spark, sf_dir):
    return examples.with_rewrite_prompt(built_examples(spark, sf_dir, **BANKS)).select(
        "id", "rewrite_prompt"
    )
