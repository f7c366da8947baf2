"""Prompts, predictions and per-row scores."""

import json

from pyspark.sql import functions as F

from filingloom import constants as C
from filingloom.functions import labels as lb
from filingloom.functions import models
from filingloom.functions import prompts as pr
from filingloom.functions import scores as sc
from filingloom.functions import text as tx
from filingloom.operators import scoring
from filingloom.plans.catalog import base as b
from filingloom.plans.catalog.labelling import BANKS, built_examples, examples_sql
from filingloom.session import load, scratch_dir, spread
from filingloom.sources.seen import keep_asked

_NL = "chr(10)"
_USER = (
    f"'Task type: ' || task || {_NL} || 'Instruction: ' || {b.sql_trim('question')} || {_NL} || {_NL} || 'Filing excerpt:' || {_NL} "
    f"|| {b.sql_trim('answer')} || {_NL} || {_NL} || {b.sql_str(C.EVAL_CLOSING)}"
)
_TASKED_SQL = f"{b.PAIRS_SQL}, tasked AS (SELECT *, CASE WHEN turn = 1 THEN 'general' ELSE 'filing_qa' END AS task FROM pairs)"


@b.query(
    "eval_prompt",
    f"WITH {_TASKED_SQL} SELECT conv_id, turn, {b.sql_str(C.EVAL_SYSTEM)} || {_NL} || {_NL} || {_USER} AS prompt FROM tasked",
)
def eval_prompt(spark, sf_dir):
    task = F.when(F.col("turn") != 1, "filing_qa")
    prompt = pr.eval_prompt(task, F.col("question"), F.col("answer"))
    return b.pairs(spark, sf_dir).select("conv_id", "turn", prompt.alias("prompt"))


@b.query(
    "chat_messages",
    f"""WITH {_TASKED_SQL} SELECT conv_id, turn, 2 AS n_messages, 'system' AS first_role, {b.sql_str(C.EVAL_SYSTEM)} AS first_content, 'user' AS second_role, {_USER} AS second_content,
  CASE WHEN turn = 1 THEN '' ELSE 'Task Type: filing_qa' || {_NL} END || 'Question: ' || question || {_NL} || 'Filing Excerpt:' || {_NL} || answer AS serving_content FROM tasked""".replace(
        "2 AS n_messages", "CAST(2 AS BIGINT) AS n_messages"
    ),
)
def chat_messages(spark, sf_dir):
    task = F.when(F.col("turn") != 1, "filing_qa")
    user = pr.eval_user_text(task, F.col("question"), F.col("answer"))
    serving = pr.serving_user_text(F.col("question"), F.col("answer"), task)
    rows = b.pairs(spark, sf_dir).select(
        "conv_id",
        "turn",
        pr.messages(C.EVAL_SYSTEM, user).alias("m"),
        serving.alias("serving_content"),
    )
    return rows.select(
        "conv_id",
        "turn",
        F.size("m").alias("n_messages"),
        F.col("m")[0]["role"].alias("first_role"),
        F.col("m")[0]["content"].alias("first_content"),
        F.col("m")[1]["role"].alias("second_role"),
        F.col("m")[1]["content"].alias("second_content"),
        "serving_content",
    )


def _sql_clean(t: str) -> str:
    bare = rf"regexp_replace(regexp_replace({t}, '(?i)</?s>|\[/?INST\]|<\|[^>]*\|>|<<SYS>>|<</SYS>>', ' ', 'g'), '(?i)[\w-]+ is not a licensed financial advisor\.[^\n]*', ' ', 'g')"
    return (
        f"array_to_string(list_filter(list_transform(string_split({bare}, {_NL}), lambda l: {b.sql_trim('l')}), lambda l: l <> ''), {_NL})"
    )


@b.query(
    "clean_prediction",
    f"""WITH noisy AS (SELECT conv_id, turn, '<s>[INST] ' || replace(text, '. ', '. ' || {_NL} || {_NL} || ' ') || ' [/inst]<|end|>' || {_NL} || 'Model-7x Is Not a licensed financial advisor. Ask one.'
  || {_NL} || role || '</S>' AS t FROM conversations) SELECT conv_id, turn, {_sql_clean('t')} AS prediction FROM noisy""",
)
def clean_prediction(spark, sf_dir):
    noisy = F.concat(
        F.lit("<s>[INST] "), F.replace("text", F.lit(". "), F.lit(". \n\n ")),
        F.lit(" [/inst]<|end|>\nModel-7x Is Not a licensed financial advisor. Ask one.\n"),
        F.col("role"), F.lit("</S>"),
    )
    return load(spark, sf_dir, "conversations").select(
        "conv_id", "turn", lb.clean_prediction(noisy).alias("prediction")
    )


def _baseline(sentences: int, figures: int) -> str:
    found = "list_transform(regexp_extract_all(input, '(?i)" + C.ANY_FIGURE + "'), lambda x: trim(x))"
    seen = b.sql_distinct_ordered(found)
    sents = b.sql_sentences(b.sql_trim("input"), 1)
    return _sql_clean(
        f"""(CASE task_type WHEN 'metric_extraction' THEN CASE WHEN len({seen}) > 0 THEN 'Reported metrics: ' || array_to_string({seen}[1:{figures}], ', ') || '.' ELSE {b.sql_str(C.NO_METRIC)} END
  WHEN 'outlook_classification' THEN {b.sql_str(C.BASELINE_OUTLOOK)}
  WHEN 'hallucination_detection' THEN CASE WHEN contains(lower(input), 'guarantees future investment returns') OR NOT contains(lower(input), 'proposed answer:')
    THEN {b.sql_str(C.BASELINE_UNSUPPORTED)} ELSE {b.sql_str(C.BASELINE_SUPPORTED)} END
  ELSE CASE WHEN len({sents}) > 0 THEN array_to_string({sents}[1:{sentences}], ' ') ELSE {b.sql_str(C.BASELINE_EMPTY)} END END)"""
    )


@b.query(
    "extractive_baseline_answer",
    f"WITH {examples_sql(BANKS)} SELECT id, {_baseline(2, 5)} AS prediction, {_baseline(3, 8)} AS extended FROM examples",
)
def extractive_baseline_answer(spark, sf_dir):
    rows = scoring.with_baseline_prediction(built_examples(spark, sf_dir, **BANKS))
    extended = lb.baseline_answer(F.col("task_type"), F.col("input"), extended=True)
    return rows.select("id", "prediction", extended.alias("extended"))


@b.query(
    "eval_rows",
    """SELECT doc_id, CASE WHEN lang = 'es' THEN 'example-' || CAST(doc_id + 1 AS VARCHAR) ELSE source || '-' || CAST(doc_id AS VARCHAR) END AS id,
  CASE WHEN lang = 'de' THEN 'unknown' ELSE 'filing_qa' END AS task_type, substring(text, 1, 200) AS input_preview, lang AS reference FROM documents""",
)
def eval_rows(spark, sf_dir):
    """Documents as examples; one language lacks ids, another task types."""
    d = b.documents(spark, sf_dir).select(
        "doc_id",
        F.when(F.col("lang") != "es", F.concat_ws("-", "source", F.col("doc_id").cast("string"))).alias("id"),
        F.when(F.col("lang") != "de", "filing_qa").alias("task_type"),
        F.col("text").alias("input"),
        F.col("lang").alias("output"),
        (F.col("doc_id") + 1).alias("position"),
    )
    return scoring.eval_rows(d, "position").select(
        "doc_id", "id", "task_type", "input_preview", "reference"
    )


# punctuation is removed and articles are dropped as whole tokens
_PUNCT = r"[!-/:-@\[-`{-~]"


def sql_tokens(t: str, articles: bool = False) -> str:
    bare = rf"list_filter(string_split_regex(regexp_replace(lower({t}), '{_PUNCT}', '', 'g'), '\s+'), lambda w: w <> '')"
    return bare if articles else f"list_filter({bare}, lambda w: w NOT IN ('a', 'an', 'the'))"


@b.query(
    "norm_answer",
    f"SELECT conv_id, turn, array_to_string({sql_tokens('text')}, ' ') AS norm, array_to_string({sql_tokens('text', True)}, ' ') AS with_articles FROM conversations",
)
def norm_answer(spark, sf_dir):
    text = F.col("text")
    return load(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        sc.norm_answer(text).alias("norm"),
        sc.norm_keep_articles(text).alias("with_articles"),
    )


@b.query(
    "exact_match",
    f"""WITH {b.PAIRS_SQL}, p AS (SELECT *, CASE WHEN length(question) < 150 THEN 'The "' || question || '", a' ELSE answer END AS reference FROM pairs)
SELECT conv_id, turn, CAST(array_to_string({sql_tokens('question')}, ' ') = array_to_string({sql_tokens('reference')}, ' ') AS DOUBLE) AS exact_match FROM p""",
)
def exact_match(spark, sf_dir):
    reference = F.when(
        F.length("question") < 150, F.concat(F.lit('The "'), "question", F.lit('", a'))
    ).otherwise(F.col("answer"))
    return b.pairs(spark, sf_dir).select(
        "conv_id", "turn", sc.exact_match(F.col("question"), reference).alias("exact_match")
    )


def f1_sql(source: str, keys: str, pred: str, ref: str) -> str:
    """CTE ``f1``: multiset overlap by counting tokens per side."""
    return f"""toks AS (SELECT {keys}, {sql_tokens(pred)} AS p, {sql_tokens(ref)} AS r FROM {source}),
pc AS (SELECT {keys}, w, count(*) AS c FROM (SELECT {keys}, unnest(p) AS w FROM toks) GROUP BY ALL),
rc AS (SELECT {keys}, w, count(*) AS c FROM (SELECT {keys}, unnest(r) AS w FROM toks) GROUP BY ALL),
ov AS (SELECT {keys}, sum(least(pc.c, rc.c)) AS o FROM pc JOIN rc USING ({keys}, w) GROUP BY ALL),
pr AS (SELECT {keys}, len(p) AS np, len(r) AS nr, coalesce(o, 0)::DOUBLE AS o, o::DOUBLE / nullif(len(p), 0) AS a, o::DOUBLE / nullif(len(r), 0) AS b FROM toks LEFT JOIN ov USING ({keys})),
f1 AS (SELECT {keys}, CASE WHEN np = 0 AND nr = 0 THEN 1.0::DOUBLE WHEN o = 0 THEN 0.0::DOUBLE ELSE a END AS "precision",
  CASE WHEN np = 0 AND nr = 0 THEN 1.0::DOUBLE WHEN o = 0 THEN 0.0::DOUBLE ELSE b END AS recall,
  CASE WHEN np = 0 AND nr = 0 THEN 1.0::DOUBLE WHEN o = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * a * b / (a + b) END AS f1 FROM pr)"""


@b.query(
    "token_f1",
    f'WITH {b.PAIRS_SQL}, {f1_sql("pairs", "conv_id, turn", "question", "answer")} SELECT * FROM f1',
)
def token_f1(spark, sf_dir):
    score = sc.token_overlap(F.col("question"), F.col("answer"))
    return b.pairs(spark, sf_dir).select("conv_id", "turn", score.alias("s")).select(
        "conv_id", "turn", "s.*"
    )


_SUMMARISED_SQL = f"d AS (SELECT doc_id, text, CASE WHEN lang = 'es' THEN '' ELSE array_to_string({b.sql_sentences('text')}[1:4], ' ') END AS summary FROM documents)"


@b.query(
    "token_f1_documents",
    f'WITH {_SUMMARISED_SQL}, {f1_sql("d", "doc_id", "summary", "text")} SELECT doc_id, f1 FROM f1',
)
def token_f1_documents(spark, sf_dir):
    """Summaries against whole documents, some summaries empty."""
    d = b.documents(spark, sf_dir)
    summary = F.when(F.col("lang") == "es", "").otherwise(
        tx.join_first(tx.sentences(F.col("text")), 4)
    )
    return d.select("doc_id", "text", summary.alias("summary")).select(
        "doc_id", sc.token_f1(F.col("summary"), F.col("text")).alias("f1")
    )


def lcs_sql(source: str, keys: str, pred: str, ref: str) -> str:
    """CTE ``rouge``: one row of the LCS table per step; a row is a running maximum."""
    eq = " AND ".join(f"l.{k.strip()} = l.{k.strip()}" for k in keys.split(","))
    return f"""lt AS (SELECT {keys}, {sql_tokens(pred)} AS p, {sql_tokens(ref)} AS r FROM {source}),
lcs AS (
  SELECT {keys}, p, r, 0 AS i, list_transform(p, lambda x: 0) AS line FROM lt
  UNION ALL
  SELECT {keys}, p, r, i + 1, list_transform(range(1, len(p) + 1), lambda j: list_max(cand[1:j])) FROM (
    SELECT {keys}, p, r, i, list_transform(p, lambda x, j: CASE WHEN x = r[i + 1] THEN coalesce(line[j - 1], 0) + 1 ELSE line[j] END) AS cand
    FROM lcs WHERE i < len(r))),
rouge AS (SELECT {keys}, len(p) AS np, len(r) AS nr, coalesce(line[len(p)], 0)::DOUBLE AS l FROM lcs WHERE i = len(r)),
rouge_l AS (SELECT {keys}, CASE WHEN l = 0 OR np = 0 OR nr = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * (l / np) * (l / nr) / ((l / np) + (l / nr)) END AS rouge_l FROM rouge)"""


@b.query(
    "rouge_l",
    f'WITH RECURSIVE {b.PAIRS_SQL}, {lcs_sql("pairs", "conv_id, turn", "question", "answer")} SELECT * FROM rouge_l',
)
def rouge_l(spark, sf_dir):
    return b.pairs(spark, sf_dir).select(
        "conv_id", "turn", sc.rouge_l(F.col("question"), F.col("answer")).alias("rouge_l")
    )


@b.query("rouge_l_documents")
def rouge_l_documents(spark, sf_dir):
    """Each document against its own sentences in the order of their text; SQL is too slow here."""
    shuffled = F.array_join(F.array_sort(tx.sentences(F.col("text"))), " ")
    return b.documents(spark, sf_dir).select(
        "doc_id", sc.rouge_l(shuffled, F.col("text")).alias("rouge_l")
    )


@b.query(
    "rouge_l_subsequence",
    f"""WITH t AS (SELECT doc_id, {sql_tokens('text')} AS r FROM documents), n AS (SELECT doc_id, len(r) AS n, (len(r) + 1) // 2 AS m FROM t)
SELECT doc_id, CASE WHEN m = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * (m::DOUBLE / m) * (m::DOUBLE / n) / ((m::DOUBLE / m) + (m::DOUBLE / n)) END AS rouge_l FROM n""",
)
def rouge_l_subsequence(spark, sf_dir):
    """Each whole document against every second of its tokens, all of which are common to both."""
    tokens = sc.answer_tokens(F.col("text"))
    half = F.array_join(F.filter(tokens, lambda t, i: i % 2 == 0), " ")
    return spread(b.documents(spark, sf_dir)).select("doc_id", sc.rouge_l(half, F.col("text")).alias("rouge_l"))


def _sql_numbers(t: str) -> str:
    found = (
        f"list_transform(list_concat(regexp_extract_all({t}, '{C.MONEY}'), regexp_extract_all({t}, '{C.PERCENT}'), "
        f"regexp_extract_all({t}, '(?i){C.MAGNITUDE}'), regexp_extract_all({t}, '{C.BARE_NUMBER}')), lambda x: trim(x))"
    )
    return found


_FIG_KEYS = "l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey"


@b.query(
    "numeric_extract",
    f"""WITH {b.FIGURES_SQL}, n AS (SELECT {_FIG_KEYS}, {_sql_numbers('sold')} AS nums FROM figures)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string({b.sql_distinct_ordered('nums')}, ' | ') AS "values" FROM n""",
)
def numeric_extract(spark, sf_dir):
    values = b.joined(tx.numeric_values(F.col("sold")))
    return b.figures(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", values.alias("values")
    )


def _sql_bare(t: str) -> str:
    return f"list_distinct(list_transform({_sql_numbers(t)}, lambda x: regexp_replace(lower(x), '[$, ]', '', 'g')))"


@b.query(
    "numeric_match",
    f"""WITH {b.FIGURES_SQL}, n AS (SELECT {_FIG_KEYS}, {_sql_bare('sold')} AS p, CASE WHEN l_linenumber = 7 THEN [] ELSE {_sql_bare('billed')} END AS r FROM figures)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(len(list_intersect(p, r)) = len(p) AND len(p) = len(r) AS DOUBLE) AS numeric_exact_match,
  CASE WHEN len(p) > 0 THEN len(list_intersect(p, r)) / len(p) WHEN len(r) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS numeric_precision,
  CASE WHEN len(r) > 0 THEN len(list_intersect(p, r)) / len(r) ELSE 1.0::DOUBLE END AS numeric_recall FROM n""",
)
def numeric_match(spark, sf_dir):
    billed = F.when(F.col("l_linenumber") == 7, "").otherwise(F.col("billed"))
    score = sc.numeric_match(F.col("sold"), billed)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return b.figures(spark, sf_dir).select(*keys, score.alias("s")).select(*keys, "s.*")


# label texts of every kind, from the two flags of a labelled document
_LABEL_TEXTS = (
    ("""'{"label": " ' || CASE WHEN quality = 1 THEN 'Positive' ELSE 'NEGATIVE' END || ' "}'""",),
    ("""'{"supported": ' || CASE WHEN toxic = 1 THEN 'false' ELSE 'true' END || ', "reason": "x"}'""",),
    ("""'{"supported": "' || CASE WHEN toxic = 1 THEN 'false' ELSE '' END || '"}'""",),
    ("""'{"label": ' || CASE WHEN quality = 1 THEN '1' ELSE 'null' END || '}'""",),
    ("""CASE WHEN toxic = 1 THEN 'This is NOT supported.' ELSE 'Fully supported by the text' END""",),
    ("""CASE WHEN quality = 1 THEN 'neutral to positive' ELSE 'Negative, hardly neutral' END""",),
    ("""CASE WHEN toxic = 1 THEN '{"label": broken negative' ELSE '["positive"]' END""",),
    ("""CASE WHEN quality = 1 THEN '{"supported": 0}' ELSE 'no opinion' END""",),
)
_KINDS = len(_LABEL_TEXTS)


def sql_label(t: str) -> str:
    obj = f"CASE WHEN json_valid(trim({t})) THEN trim({t}) END"
    first = [
        f"coalesce(nullif(instr(lower({t}), '{w}'), 0), 1000000)" for w in ("positive", "neutral", "negative")
    ]
    worded = (
        f"CASE WHEN contains(lower({t}), 'unsupported') OR contains(lower({t}), 'not supported') THEN 'unsupported' "
        f"WHEN contains(lower({t}), 'supported') THEN 'supported' WHEN least({', '.join(first)}) = 1000000 THEN 'unknown' "
        f"WHEN least({', '.join(first)}) = {first[0]} THEN 'positive' WHEN least({', '.join(first)}) = {first[1]} THEN 'neutral' ELSE 'negative' END"
    )
    return (
        f"CASE WHEN json_exists({obj}, '$.label') THEN lower(trim(coalesce(json_extract_string({obj}, '$.label'), 'None'))) "
        f"WHEN json_exists({obj}, '$.supported') THEN CASE WHEN CAST(json_extract({obj}, '$.supported') AS VARCHAR) IN ('false', 'null', '0', '\"\"', '[]', '{{}}') THEN 'unsupported' ELSE 'supported' END "
        f"ELSE {worded} END"
    )


_LABELS_SQL = "texts AS (" + " UNION ALL ".join(
    f"SELECT doc_id, CAST({i} AS BIGINT) AS kind, quality, toxic, {t[0]} AS t FROM labels" for i, t in enumerate(_LABEL_TEXTS)
) + ")"


def _label_texts(spark, sf_dir):
    rows = load(spark, sf_dir, "labels")
    texts = F.array(*[F.expr(t[0]) for t in _LABEL_TEXTS])
    return rows.select("doc_id", "quality", "toxic", F.posexplode(texts).alias("kind", "t"))


@b.query("parse_label", f"WITH {_LABELS_SQL} SELECT doc_id, kind, {sql_label('t')} AS label FROM texts")
def parse_label(spark, sf_dir):
    return _label_texts(spark, sf_dir).select("doc_id", "kind", sc.parse_label(F.col("t")).alias("label"))


_GOLD = "CASE WHEN quality = 1 THEN 'The outlook is positive' WHEN toxic = 1 THEN 'unsupported' ELSE 'supported' END"


@b.query(
    "classification_accuracy",
    f"""WITH {_LABELS_SQL}, g AS (SELECT *, {_GOLD} AS gold FROM texts)
SELECT doc_id, kind, CAST({sql_label('t')} = {sql_label('gold')} AND {sql_label('t')} <> 'unknown' AS DOUBLE) AS accuracy FROM g""",
)
def classification_accuracy(spark, sf_dir):
    accuracy = sc.classification_accuracy(F.col("t"), F.expr(_GOLD))
    return _label_texts(spark, sf_dir).select("doc_id", "kind", accuracy.alias("accuracy"))


def sql_faithfulness(pred: str, source: str) -> str:
    stop = ", ".join(b.sql_str(w) for w in C.STOPWORDS)
    content = f"list_distinct(list_filter({sql_tokens(pred, True)}, lambda w: w NOT IN ({stop})))"
    return (
        f"CASE WHEN len({content}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({content}, {sql_tokens(source, True)})) / len({content}) END"
    )


@b.query(
    "lexical_faithfulness",
    f"WITH {b.PAIRS_SQL} SELECT conv_id, turn, {sql_faithfulness('question', 'answer')} AS lexical_faithfulness FROM pairs",
)
def lexical_faithfulness(spark, sf_dir):
    score = sc.lexical_faithfulness(F.col("question"), F.col("answer"))
    return b.pairs(spark, sf_dir).select("conv_id", "turn", score.alias("lexical_faithfulness"))


@b.query(
    "scored_faithfulness",
    f"WITH {b.PAIRS_SQL} SELECT conv_id, turn, CASE WHEN turn = 1 THEN 1.0::DOUBLE ELSE least(greatest(length(answer) / length(question) - 2.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) END AS score FROM pairs",
)
def scored_faithfulness(spark, sf_dir):
    """A plain length expression stands in for an entailment model."""
    prediction = F.when(F.col("turn") == 1, "  ").otherwise(F.col("question"))
    score = sc.scored_faithfulness(
        prediction, F.col("answer"), lambda p, h: F.length(p) / F.length(h) - 2.0
    )
    return b.pairs(spark, sf_dir).select("conv_id", "turn", score.alias("score"))


_MODEL = {"bias": -0.5, "length": 0.25, "digits": 3.0, "quoted": 0.125}


@b.query(
    "scored_faithfulness_model",
    f"""WITH {b.PAIRS_SQL}, f AS (SELECT conv_id, turn, length(answer)::DOUBLE / greatest(length(question), 1)::DOUBLE AS share,
  length(regexp_replace(question, '[^0-9]', '', 'g'))::DOUBLE / greatest(length(question), 1)::DOUBLE AS digits, contains(answer, question)::INT::DOUBLE AS quoted, question FROM pairs)
SELECT conv_id, turn, CASE WHEN turn = 1 OR {b.sql_trim('question')} = '' THEN 1.0::DOUBLE ELSE least(greatest(
  {_MODEL['bias']}::DOUBLE + {_MODEL['length']}::DOUBLE * share + {_MODEL['digits']}::DOUBLE * digits + {_MODEL['quoted']}::DOUBLE * quoted, 0.0::DOUBLE), 1.0::DOUBLE) END AS score FROM f""",
)
def scored_faithfulness_model(spark, sf_dir):
    """Scores by a model that every worker loads from a file."""
    path = scratch_dir(spark, "pair-model")
    spark.createDataFrame([(json.dumps(_MODEL),)], "value string").coalesce(1).write.text(path)
    part = spark.read.format("binaryFile").load(path).select("path").first()[0]
    prediction = F.when(F.col("turn") == 1, "  ").otherwise(F.col("question"))
    score = sc.scored_faithfulness(prediction, F.col("answer"), models.model_scorer(spark, part))
    return b.pairs(spark, sf_dir).select("conv_id", "turn", score.alias("score"))


def dispatch_sql(keys: str = "conv_id, turn", further: str = "", source: str = "told") -> str:
    """CTEs ending in ``long``: the metrics that each turn's task asks for.

    ``further`` are CTEs over ``told``, of which ``source`` holds the turns to score.
    """
    return f"""{b.PAIRS_SQL},
{b.FIGURES_SQL},
told AS (SELECT p.conv_id, p.turn, CASE WHEN turn = 2 THEN concat_ws(' ', sold, question) ELSE question END AS question,
  CASE WHEN turn = 2 THEN concat_ws(' ', billed, answer) ELSE answer END AS answer
  FROM pairs p LEFT JOIN (SELECT l_orderkey, min(sold) AS sold, min(billed) AS billed FROM figures GROUP BY l_orderkey) ON l_orderkey = conv_id),
{further}
ev AS (SELECT {keys}, question, answer, CASE turn WHEN 1 THEN 'filing_qa' WHEN 2 THEN 'metric_extraction' WHEN 3 THEN 'risk_summary' WHEN 4 THEN 'hallucination_detection'
  WHEN 5 THEN 'outlook_classification' ELSE 'other' END AS task_type FROM {source}),
{f1_sql('ev', keys, 'question', 'answer')},
{lcs_sql("ev", keys, "question", "answer")},
long AS (
  SELECT {keys}, task_type, 'exact_match' AS metric, CAST(array_to_string({sql_tokens('question')}, ' ') = array_to_string({sql_tokens('answer')}, ' ') AS DOUBLE) AS value FROM ev WHERE task_type = 'filing_qa'
  UNION ALL SELECT {keys}, task_type, 'token_f1', f1 FROM ev JOIN f1 USING ({keys}) WHERE task_type <> 'hallucination_detection'
  UNION ALL SELECT {keys}, task_type, 'rouge_l', rouge_l FROM ev JOIN rouge_l USING ({keys}) WHERE task_type = 'risk_summary'
  UNION ALL SELECT {keys}, task_type, 'classification_accuracy', CAST({sql_label('question')} = {sql_label('answer')} AND {sql_label('question')} <> 'unknown' AS DOUBLE) FROM ev
    WHERE task_type IN ('hallucination_detection', 'outlook_classification')
  UNION ALL SELECT {keys}, task_type, unnest(['numeric_exact_match', 'numeric_precision', 'numeric_recall']), unnest([
      CAST(len(list_intersect(p, r)) = len(p) AND len(p) = len(r) AS DOUBLE),
      CASE WHEN len(p) > 0 THEN len(list_intersect(p, r)) / len(p) WHEN len(r) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END,
      CASE WHEN len(r) > 0 THEN len(list_intersect(p, r)) / len(r) ELSE 1.0::DOUBLE END])
    FROM (SELECT *, {_sql_bare('question')} AS p, {_sql_bare('answer')} AS r FROM ev WHERE task_type = 'metric_extraction')
  UNION ALL SELECT {keys}, task_type, 'lexical_faithfulness', {sql_faithfulness('question', 'answer')} FROM ev WHERE task_type <> 'outlook_classification')"""


_DISPATCH_SQL = dispatch_sql()


def answered_turns(spark, sf_dir):
    """Conversation turns as test rows (input, output) with a prediction."""
    turn = F.col("turn")
    task = (
        F.when(turn == 1, "filing_qa")
        .when(turn == 2, "metric_extraction")
        .when(turn == 3, "risk_summary")
        .when(turn == 4, "hallucination_detection")
        .when(turn == 5, "outlook_classification")
        .otherwise("other")
    )
    # the turns about figures carry the amounts of the order of that number
    asked = load(spark, sf_dir, "conversations").where("role = 'assistant' AND turn = 2")
    items = keep_asked(load(spark, sf_dir, "lineitem"), "l_orderkey", asked, "conv_id")
    sentences = b.figures_of(items).groupBy(F.col("l_orderkey").alias("conv_id"))
    # the turn is a value of the group: with it the pairs are joined where they lie
    figures = sentences.agg(F.min("sold").alias("sold"), F.min("billed").alias("billed"), F.max(F.lit(2).cast("long")).alias("turn"))
    told = b.pairs(spark, sf_dir).join(figures, ["conv_id", "turn"], "left")
    question = F.when(turn == 2, F.concat_ws(" ", "sold", "question")).otherwise(F.col("question"))
    answer = F.when(turn == 2, F.concat_ws(" ", "billed", "answer")).otherwise(F.col("answer"))
    return told.select(
        "conv_id",
        "turn",
        task.alias("task_type"),
        answer.alias("input"),
        answer.alias("output"),
        question.alias("prediction"),
    )


def _scored(spark, sf_dir):
    return scoring.score_examples(answered_turns(spark, sf_dir))


@b.query("metrics_by_task_dispatch", f"WITH RECURSIVE {_DISPATCH_SQL} SELECT * FROM long")
def metrics_by_task_dispatch(spark, sf_dir):
    return scoring.metrics_long(_scored(spark, sf_dir), ["conv_id", "turn", "task_type"])
