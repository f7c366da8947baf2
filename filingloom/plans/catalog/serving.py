"""Request logs, budgets and corpus safety."""

from pyspark.sql import functions as F

from filingloom import constants as C
from filingloom.functions import text as tx
from filingloom.operators import report, safety
from filingloom.operators import requests as rq
from filingloom.plans.catalog import base as b
from filingloom.plans.catalog.auditing import loss_history
from filingloom.plans.catalog.comparing import _sql_fixed
from filingloom.session import cut_lineage, load, scratch_dir
from filingloom.streaming import limits

_REQ_SQL = """req AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS client, event_type AS endpoint, event_type <> 'error' AS ok, value AS latency_s, CAST(json_extract(props, '$.k') AS BIGINT) AS tokens FROM events)"""


def _requests(spark, sf_dir):
    """Events as requests: errors failed, the value is the latency, k the tokens."""
    return load(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.col("user_id").cast("string").alias("client"),
        F.col("event_type").alias("endpoint"),
        (F.col("event_type") != "error").alias("ok"),
        F.col("value").alias("latency_s"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
    )


def _percentile_sql(key: str) -> str:
    def pick(p: int) -> str:
        rank = f"greatest(least(CAST(round_even({p / 100.0}::DOUBLE * max(n), 0) AS BIGINT), max(n)), 1)"
        return f"CASE WHEN max(n) > 0 THEN {b.sql_round(f'list(latency_s ORDER BY latency_s)[{rank}]', 4)} ELSE 0.0::DOUBLE END AS p{p}_latency_s"

    return f"""lat AS (SELECT {key}, latency_s, count(*) OVER (PARTITION BY {key}) AS n FROM req WHERE ok),
pct AS (SELECT {key}, {', '.join(pick(p) for p in rq.PERCENTILES)} FROM lat GROUP BY {key}),
percentiles AS (SELECT k.{key}, coalesce(p50_latency_s, 0) AS p50_latency_s, coalesce(p95_latency_s, 0) AS p95_latency_s, coalesce(p99_latency_s, 0) AS p99_latency_s
  FROM (SELECT DISTINCT {key} FROM req) k LEFT JOIN pct USING ({key}))"""


@b.query("latency_percentiles", f"WITH {_REQ_SQL}, {_percentile_sql('endpoint')} SELECT * FROM percentiles")
def latency_percentiles(spark, sf_dir):
    return rq.latency_percentiles(_requests(spark, sf_dir), ["endpoint"])


@b.query("latency_percentiles_client", f"WITH {_REQ_SQL}, {_percentile_sql('client')} SELECT * FROM percentiles")
def latency_percentiles_client(spark, sf_dir):
    return rq.latency_percentiles(_requests(spark, sf_dir), ["client"])


@b.query("latency_percentiles_merged", f"WITH {_REQ_SQL}, {_percentile_sql('endpoint')} SELECT * FROM percentiles")
def latency_percentiles_merged(spark, sf_dir):
    """Exact percentiles from the counts of single days, without the log."""
    path = scratch_dir(spark, "latency-days")
    days = _requests(spark, sf_dir).withColumn("day", F.to_date("ts"))
    rq.latency_counts(days, ["day", "endpoint"]).write.partitionBy("day").parquet(path)
    return rq.percentiles_of_counts(spark.read.parquet(path).drop("day"), ["endpoint"])


def _summary_sql(key: str) -> str:
    return f"""summary AS (
  SELECT {key}, count(*) AS num_requests, count(*) FILTER (ok) AS successful_requests, count(*) FILTER (NOT ok) AS failed_requests,
    coalesce({b.sql_round('CAST(sum(CAST(latency_s AS DECIMAL(26,12))) FILTER (ok) AS DOUBLE) / nullif(count(*) FILTER (ok), 0)', 4)}, 0) AS avg_latency_s,
    coalesce({b.sql_round('min(latency_s) FILTER (ok)', 4)}, 0) AS min_latency_s, coalesce({b.sql_round('max(latency_s) FILTER (ok)', 4)}, 0) AS max_latency_s,
    CAST(coalesce(sum(tokens) FILTER (ok), 0) AS BIGINT) AS total_completion_tokens,
    coalesce(CASE WHEN epoch_us(max(ts)) > epoch_us(min(ts)) AND sum(tokens) FILTER (ok) > 0 THEN
      {b.sql_round('CAST(sum(tokens) FILTER (ok) AS DOUBLE) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE)', 2)} END, 0) AS approx_tokens_per_second
  FROM req GROUP BY {key})"""


def _summary(spark, sf_dir, key: str):
    wall = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1_000_000.0
    return rq.request_summary(_requests(spark, sf_dir), [key], wall)


@b.query("request_summary", f"WITH {_REQ_SQL}, {_summary_sql('client')} SELECT * FROM summary")
def request_summary(spark, sf_dir):
    return _summary(spark, sf_dir, "client")


def _label_union(rows: list[tuple[str, str]], key: str, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {key}, CAST({i} AS BIGINT) AS position, {b.sql_str(label)} AS label, {value} AS value FROM {source}"
        for i, (label, value) in enumerate(rows, start=1)
    )


_LATENCY_LABELS = [
    ("Endpoint", "endpoint"),
    ("Model", "'N/A'"),
    ("Requests", "CAST(num_requests AS VARCHAR)"),
    ("Concurrency", "'N/A'"),
    ("Successful", "CAST(successful_requests AS VARCHAR)"),
    ("Failed", "CAST(failed_requests AS VARCHAR)"),
    ("p50 latency (s)", _sql_fixed("p50_latency_s")),
    ("p95 latency (s)", _sql_fixed("p95_latency_s")),
    ("p99 latency (s)", _sql_fixed("p99_latency_s")),
    ("Avg latency (s)", _sql_fixed("avg_latency_s")),
    ("Approx tokens/s", _sql_fixed("approx_tokens_per_second", 1)),
]


@b.query(
    "latency_rows",
    f"""WITH {_REQ_SQL}, {_percentile_sql('endpoint')}, {_summary_sql('endpoint')}, both_ AS (SELECT * FROM summary JOIN percentiles USING (endpoint))
{_label_union(_LATENCY_LABELS, 'endpoint', 'both_')}""",
)
def latency_rows(spark, sf_dir):
    percentiles = rq.latency_percentiles(_requests(spark, sf_dir), ["endpoint"])
    return report.latency_rows(_summary(spark, sf_dir, "endpoint").join(percentiles, "endpoint"), ["endpoint"])


_TRAINING_LABELS = [
    ("Base model", "'N/A'"), ("Train examples", "CAST(n AS VARCHAR)"), ("Eval examples", "'N/A'"),
    ("LoRA rank (r)", "'N/A'"), ("LoRA alpha", "'N/A'"), ("Learning rate", "'N/A'"), ("Epochs", "'3'"),
    ("Max sequence length", "'N/A'"), ("Sequence packing", "'N/A'"), ("Final train loss", "'N/A'"),
    ("Final eval loss", "coalesce(CAST(CAST(v AS DECIMAL(12,2)) AS VARCHAR), 'N/A')"),
]


@b.query(
    "training_rows",
    f"""WITH t AS (SELECT user_id AS run, count(*) AS n, arg_max(value, event_id) FILTER (event_type = 'purchase') AS v FROM events GROUP BY 1)
{_label_union(_TRAINING_LABELS, 'run', 't')}""",
)
def training_rows(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    sizes = e.groupBy(F.col("user_id").alias("run")).agg(F.count(F.lit(1)).alias("num_train_examples"))
    losses = loss_history(spark, sf_dir).select(
        "run", F.col("final_eval_loss").cast("decimal(12,2)").alias("final_eval_loss")
    )
    return report.training_rows(sizes.join(losses, "run").withColumn("epochs", F.lit(3)), ["run"])


_DAY = 86_400


_SLIDING_SQL = f"""WITH RECURSIVE {_REQ_SQL},
line AS (SELECT client, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY client ORDER BY ts, event_id) AS i FROM req),
walk AS (
  SELECT client, 0::BIGINT AS i, 0::BIGINT AS event_id, 0::BIGINT AS t, []::BIGINT[] AS live, []::BIGINT[] AS hits, true AS allowed FROM (SELECT DISTINCT client FROM line)
  UNION ALL
  SELECT client, i, event_id, t, live, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END, len(live) < 3 FROM (
    SELECT l.client, l.i, l.event_id, l.t, list_filter(w.hits, lambda h: h > l.t - {_DAY}000000) AS live FROM walk w JOIN line l ON l.client = w.client AND l.i = w.i + 1))
SELECT client, event_id, allowed, CASE WHEN allowed THEN 3 - len(hits) ELSE 0 END AS remaining, (hits[1] + {_DAY}000000 - t) // 1000000 + 1 AS reset_seconds FROM walk WHERE i > 0"""


@b.query("sliding_rate_limit", _SLIDING_SQL)
def sliding_rate_limit(spark, sf_dir):
    """Three requests per rolling day."""
    return rq.sliding_rate_limit(
        _requests(spark, sf_dir), limit=3, window_seconds=_DAY, windows_per_piece=4
    ).select("client", "event_id", "allowed", "remaining", "reset_seconds")


_FIXED_SQL = f"""WITH {_REQ_SQL}, w AS (SELECT client, event_id, epoch_us(ts) // {_DAY}000000 AS window_no, row_number() OVER (PARTITION BY client, epoch_us(ts) // {_DAY}000000 ORDER BY ts, event_id) AS hit_no,
  (min(epoch_us(ts)) OVER (PARTITION BY client, epoch_us(ts) // {_DAY}000000) + {_DAY}000000 - epoch_us(ts) + 500000) // 1000000 AS left_s FROM req)
SELECT client, event_id, window_no, hit_no, hit_no <= 2 AS allowed, greatest(2 - hit_no, 0) AS remaining, CASE WHEN left_s > 0 THEN left_s ELSE {_DAY} END AS reset_seconds FROM w"""


@b.query("fixed_window_limit", _FIXED_SQL)
def fixed_window_limit(spark, sf_dir):
    """Two requests per calendar day."""
    return rq.fixed_window_limit(_requests(spark, sf_dir), limit=2, window_seconds=_DAY).select(
        "client", "event_id", "window_no", "hit_no", "allowed", "remaining", "reset_seconds"
    )


_LOG_SQL = f"""SELECT 'r-' || CAST(event_id AS VARCHAR) AS request_id, CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS method, '/v1/' || event_type AS path,
  CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS BIGINT) AS status_code, {b.sql_round('value * 1000.0::DOUBLE', 2)} AS latency_ms, 'host' || CAST(user_id AS VARCHAR) AS client_host,
  CASE WHEN event_type = 'click' THEN NULL ELSE 'agent' END AS user_agent, CASE WHEN event_type = 'view' THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS input_chars FROM events"""


@b.query("request_log", _LOG_SQL)
def request_log(spark, sf_dir):
    return rq.request_log(raw_requests(load(spark, sf_dir, "events")))


def raw_requests(events):
    """Events in the shape a gateway would log; works on a stream too."""
    kind = F.col("event_type")
    return events.select(
        F.concat(F.lit("r-"), F.col("event_id").cast("string")).alias("request_id"),
        F.when(kind == "view", "GET").otherwise("POST").alias("method"),
        F.concat(F.lit("/v1/"), kind).alias("path"),
        F.when(kind == "error", 500).otherwise(200).alias("status_code"),
        F.col("value").alias("latency_s"),
        F.concat(F.lit("host"), F.col("user_id").cast("string")).alias("client_host"),
        F.when(kind != "click", "agent").alias("user_agent"),
        F.when(kind == "view", "").otherwise(F.get_json_object("props", "$.k")).alias("content_length"),
    )


def _event_stream(spark, sf_dir):
    """The events table as a stream of files; a micro-batch is bounded in bytes."""
    folder = sf_dir.rstrip("/")
    stream = (
        spark.readStream.schema(spark.read.parquet(f"{folder}/events.parquet").schema)
        .option("maxBytesPerTrigger", str(8 << 30))
        # a stream wants a folder unless the path is a glob; the table may be either
        .parquet(f"{folder}/event[s].parquet")
    )
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _run_stream(spark, df, label: str):
    """Runs a stream over all files that are there, to Parquet, and reads the result."""
    out = scratch_dir(spark, label)
    query = (
        df.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_dir(spark, f"{label}-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@b.query("request_log_stream", _LOG_SQL)
def request_log_stream(spark, sf_dir):
    """The request log written by a stream."""
    return _run_stream(spark, rq.request_log(raw_requests(_event_stream(spark, sf_dir))), "log")


_ARRIVALS = "client string, event_id bigint, ts timestamp"
_ROUNDS = 3


def _judged(spark, sf_dir, rounds, judge):
    """Requests that arrive round by round, through a budget that picks up where it stopped.

    ``rounds`` numbers the requests; each round is written behind the ones before and read
    by the next start of the query. A heartbeat at the end moves time past all requests.
    """
    requests = _requests(spark, sf_dir).select("client", "event_id", "ts")
    arrived, out, state = (scratch_dir(spark, f"budget-{name}") for name in ("in", "out", "state"))
    numbered = cut_lineage(rounds(requests), "budget-rounds")
    end = spark.sql("SELECT CAST(NULL AS STRING) AS client, CAST(NULL AS BIGINT) AS event_id, TIMESTAMP'2200-01-01' AS ts")
    for number in range(_ROUNDS + 1):
        part = end if number == _ROUNDS else numbered.where(F.col("round") == number).drop("round")
        part.write.mode("append").parquet(arrived)
        judged = judge(spark.readStream.schema(_ARRIVALS).parquet(arrived))
        limits.start_budget(judged, out, state, availableNow=True).awaitTermination()
    return limits.read_budget(spark, out, judged)


def _jittered(requests):
    """Rounds of time in which a request is up to 20 hours late."""
    jitter = F.pmod(F.xxhash64("event_id"), F.lit(20 * 3600)).cast("int")
    arrival = F.unix_seconds("ts") + jitter
    bounds = requests.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    low, span = bounds[0] or 0, max(1, (bounds[1] or 0) - (bounds[0] or 0))
    number = F.floor((arrival - low) * _ROUNDS / span).cast("int")
    return requests.withColumn("round", F.least(number, F.lit(_ROUNDS - 1)))


@b.query("sliding_rate_limit_stream", _SLIDING_SQL)
def sliding_rate_limit_stream(spark, sf_dir):
    """The rolling budget over requests up to 20 hours out of order; nothing is late."""
    verdicts, _ = _judged(spark, sf_dir, _jittered, lambda s: limits.sliding_limit_stream(s, "1 day", 3, _DAY))
    return verdicts.select("client", "event_id", "allowed", "remaining", "reset_seconds")


@b.query("fixed_window_limit_stream", _FIXED_SQL)
def fixed_window_limit_stream(spark, sf_dir):
    """The fixed-window counter over requests up to 20 hours out of order; nothing is late."""
    verdicts, _ = _judged(spark, sf_dir, _jittered, lambda s: limits.fixed_limit_stream(s, "1 day", 2, _DAY))
    return verdicts.select("client", "event_id", "window_no", "hit_no", "allowed", "remaining", "reset_seconds")


_ROUND_SQL = f"""rounds AS (SELECT event_id, event_id % {_ROUNDS} AS round, epoch_us(ts) AS t FROM events),
marks AS (SELECT round, max(max(t) // 1000 * 1000 - 7 * {_DAY}000000) OVER (ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM rounds GROUP BY round),
late AS (SELECT event_id FROM rounds r JOIN marks m ON m.round = r.round AND t <= mark),"""


@b.query(
    "late_requests_stream",
    _SLIDING_SQL.replace("WITH RECURSIVE ", f"WITH RECURSIVE {_ROUND_SQL} ", 1)
    .replace("FROM req),", "FROM req WHERE event_id NOT IN (SELECT event_id FROM late)),", 1)
    .replace("SELECT client, event_id, allowed,", "SELECT client, event_id, CASE WHEN allowed THEN 'allowed' ELSE 'refused' END AS verdict,", 1)
    + " UNION ALL SELECT client, event_id, 'late', 0, 0 FROM req WHERE event_id IN (SELECT event_id FROM late)",
)
def late_requests_stream(spark, sf_dir):
    """The rolling budget over shuffled requests: those a week behind are late and do not count."""

    def rounds(requests):
        return requests.withColumn("round", (F.col("event_id") % _ROUNDS).cast("int"))

    verdicts, late = _judged(spark, sf_dir, rounds, lambda s: limits.sliding_limit_stream(s, "7 days", 3, _DAY))
    columns = ["client", "event_id", "verdict", "remaining", "reset_seconds"]
    judged = verdicts.withColumn("verdict", F.when(F.col("allowed"), "allowed").otherwise("refused")).select(*columns)
    none = F.lit(0).cast("long")
    return judged.unionByName(
        late.select("client", "event_id", F.lit("late").alias("verdict"), none.alias("remaining"), none.alias("reset_seconds"))
    )


@b.query(
    "client_pseudonym",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'key:' || substring(sha256('k' || CAST(user_id AS VARCHAR)), 1, 16)
  WHEN 'view' THEN 'key:' || substring(sha256('b' || CAST(user_id AS VARCHAR)), 1, 16) WHEN 'error' THEN 'ip:unknown' ELSE 'ip:host' || CAST(user_id AS VARCHAR) END AS client FROM events""",
)
def client_pseudonym(spark, sf_dir):
    """Key header for clicks, bearer header for views, other schemes and blanks ignored."""
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    header = F.when(kind == "click", F.concat(F.lit(" k"), user)).when(kind == "purchase", "  ")
    auth = (
        F.when(kind == "view", F.concat(F.lit("BEARER  b"), user, F.lit(" ")))
        .when(kind == "signup", F.concat(F.lit("Basic "), user))
        .when(kind == "click", "Bearer ignored")
    )
    host = F.when(kind != "error", F.concat(F.lit("host"), user))
    return load(spark, sf_dir, "events").select(
        "event_id", rq.client_pseudonym(rq.api_key(header, auth), host).alias("client")
    )


_CHAT_SQL = f"""{b.PAIRS_SQL},
chat AS (SELECT conv_id, turn, CASE WHEN turn = 5 THEN '  ' ELSE question END AS question, CASE WHEN turn = 7 THEN '' ELSE answer END AS answer,
  CASE WHEN turn = 3 THEN 'chitchat' WHEN turn = 1 THEN NULL ELSE 'filing_qa' END AS task_type, length(question) * 10 AS max_tokens, length(answer) / 500 AS temperature FROM pairs),
checked AS (SELECT conv_id, turn, list_filter([
  CASE WHEN question = '' THEN 'question: too short' WHEN length(question) > 2000 THEN 'question: too long' WHEN trim(question) = '' THEN 'question: blank' END,
  CASE WHEN answer = '' THEN 'filing_excerpt: too short' WHEN length(answer) > 100000 THEN 'filing_excerpt: too long' END,
  CASE WHEN task_type = 'chitchat' THEN 'task_type: unknown' END,
  CASE WHEN max_tokens NOT BETWEEN 1 AND 2048 THEN 'max_tokens: out of range' END,
  CASE WHEN temperature NOT BETWEEN 0 AND 2 THEN 'temperature: out of range' END], lambda x: x IS NOT NULL) AS errors FROM chat)"""


def _checked(spark, sf_dir):
    turn = F.col("turn")
    chat = b.pairs(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.when(turn == 5, "  ").otherwise(F.col("question")).alias("question"),
        F.when(turn == 7, "").otherwise(F.col("answer")).alias("filing_excerpt"),
        F.when(turn == 3, "chitchat").when(turn != 1, "filing_qa").alias("task_type"),
        (F.length("question") * 10).alias("max_tokens"),
        (F.length("answer") / 500).alias("temperature"),
    )
    return rq.request_errors(chat)


@b.query(
    "request_validation",
    f"WITH {_CHAT_SQL} SELECT conv_id, turn, array_to_string(errors, '; ') AS errors FROM checked WHERE len(errors) > 0",
)
def request_validation(spark, sf_dir):
    """The quarantined requests with their reasons."""
    return rq.quarantined_requests(_checked(spark, sf_dir)).select(
        "conv_id", "turn", b.joined(F.col("errors"), "; ").alias("errors")
    )


@b.query("request_valid", f"WITH {_CHAT_SQL} SELECT conv_id, turn FROM checked WHERE len(errors) = 0")
def request_valid(spark, sf_dir):
    return rq.valid_requests(_checked(spark, sf_dir)).select("conv_id", "turn")


@b.query(
    "status_rollup",
    """SELECT CAST(user_id AS VARCHAR) AS client, count(*) AS checks, count(*) FILTER (NOT (event_type = 'view' OR value < 150)) AS failed,
  bool_and(event_type = 'view' OR value < 150) AS all_ok FROM events GROUP BY user_id""",
)
def status_rollup(spark, sf_dir):
    checks = load(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("client"),
        F.col("event_type").alias("check"),
        (F.col("value") < 150).alias("ok"),
    )
    return rq.status_rollup(checks, ["client"], skipped=["view"])


_NOTICE = "Not financial advice. Verify against the filing."


@b.query(
    "append_notice",
    f"""WITH n AS (SELECT doc_id, CASE WHEN lang = 'es' THEN {b.sql_str(_NOTICE)} ELSE replace(text, '. ', '. ' || {b.sql_str(_NOTICE)} || '  ' || chr(10)) END AS t FROM documents),
c AS (SELECT doc_id, {b.sql_trim(f"array_to_string(list_transform(string_split(replace(t, {b.sql_str(_NOTICE)}, ''), chr(10)), lambda l: rtrim(l, {b.BLANKS})), chr(10))")} AS base FROM n)
SELECT doc_id, CASE WHEN base = '' THEN {b.sql_str(_NOTICE)} ELSE base || chr(10) || chr(10) || {b.sql_str(_NOTICE)} END AS text FROM c""",
)
def append_notice(spark, sf_dir):
    noisy = F.when(F.col("lang") == "es", _NOTICE).otherwise(
        F.replace("text", F.lit(". "), F.lit(f". {_NOTICE}  \n"))
    )
    return b.documents(spark, sf_dir).select(
        "doc_id", tx.append_notice(noisy, _NOTICE).alias("text")
    )


_SECRETS_SQL = """s AS (SELECT doc_id, text || chr(10) || CASE lang WHEN 'en' THEN 'HF_TOKEN: ' || md5(text) || ' SECRET_KEY = "' || source || md5(text) || '"'
  WHEN 'fr' THEN 'SECRET_KEY=''your-key-here-123'' WANDB_API_KEY=' || upper(md5(text)) WHEN 'de' THEN 'OPENAI_API_KEY=process.env.KEY1' || source || ' API_SECRET_KEY=abc1'
  ELSE 'HF_TOKEN=HF_TOKEN_VALUE OPENAI_API_KEY = onlyletterswithoutanydigits API_SECRET_KEY="lettersonly"' END AS text FROM documents)"""


def _secret_texts(spark, sf_dir):
    """Documents followed by assignments of the known key names."""
    digest, lang = F.md5("text"), F.col("lang")
    extra = (
        F.when(
            lang == "en",
            F.concat(F.lit("HF_TOKEN: "), digest, F.lit(' SECRET_KEY = "'), "source", digest, F.lit('"')),
        )
        .when(
            lang == "fr",
            F.concat(F.lit("SECRET_KEY='your-key-here-123' WANDB_API_KEY="), F.upper(digest)),
        )
        .when(
            lang == "de",
            F.concat(F.lit("OPENAI_API_KEY=process.env.KEY1"), "source", F.lit(" API_SECRET_KEY=abc1")),
        )
        .otherwise(
            'HF_TOKEN=HF_TOKEN_VALUE OPENAI_API_KEY = onlyletterswithoutanydigits API_SECRET_KEY="lettersonly"'
        )
    )
    return b.documents(spark, sf_dir).select(
        "doc_id", F.concat("text", F.lit("\n"), extra).alias("text")
    )


_HINTS = " OR ".join(f"contains(lower(v), {b.sql_str(h)})" for h in C.PLACEHOLDER_HINTS)
_KEYS = "|".join(C.SECRET_KEYS)
_ASSIGNMENT = rf"({_KEYS})\s*[:=]\s*([\"'']?[^\s\"''#,)]+[\"'']?)"


@b.query(
    "secret_scan",
    f"""WITH {_SECRETS_SQL},
m AS (SELECT doc_id, regexp_extract_all(text, '{_ASSIGNMENT}', 1) AS names, regexp_extract_all(text, '{_ASSIGNMENT}', 2) AS vals FROM s),
hit AS (SELECT doc_id, generate_subscripts(names, 1) - 1 AS pos, unnest(names) AS key_name, trim(unnest(vals), '"''') AS v FROM m)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, key_name FROM hit
WHERE length(v) >= 8 AND NOT ({_HINTS}) AND NOT contains(v, '.') AND NOT contains(lower(v), 'env') AND NOT contains(lower(v), 'process') AND NOT starts_with(v, '$')
  AND NOT (upper(v) = v AND contains(v, '_') AND NOT regexp_matches(v, '[0-9]')) AND ((regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]')) OR length(v) >= 24)""",
)
def secret_scan(spark, sf_dir):
    return safety.secret_scan(_secret_texts(spark, sf_dir), ["doc_id"], "text")


_PATH_SQL = r"""paths AS (SELECT page_id, CASE WHEN contains(url, 'page=2') THEN 'checkpoints/' WHEN contains(url, '#top') THEN 'data/raw/' WHEN contains(url, 'example.org') THEN 'frontend/' ELSE '' END
  || CASE WHEN contains(url, '/fr/') THEN '.env.local' WHEN contains(url, '/de/') THEN 'model.SafeTensors' WHEN contains(url, '/es/') THEN '.env' ELSE regexp_replace(url, '^https?://', '') END AS path FROM pages)"""


def _paths(spark, sf_dir):
    """Addresses as repository paths of several kinds."""
    url = F.col("url")

    def has(part: str):
        return F.contains(url, F.lit(part))

    folder = (
        F.when(has("page=2"), "checkpoints/")
        .when(has("#top"), "data/raw/")
        .when(has("example.org"), "frontend/")
        .otherwise("")
    )
    name = (
        F.when(has("/fr/"), ".env.local")
        .when(has("/de/"), "model.SafeTensors")
        .when(has("/es/"), ".env")
        .otherwise(F.regexp_replace(url, "^https?://", ""))
    )
    return load(spark, sf_dir, "pages").select("page_id", F.concat(folder, name).alias("path"))


@b.query(
    "path_policy_scan",
    f"""WITH {_PATH_SQL} SELECT page_id, path, 'env_file' AS rule FROM paths WHERE path IN ('.env', 'frontend/.env.local')
UNION ALL SELECT page_id, path, 'model_weights' FROM paths WHERE regexp_matches(lower(path), '[^/]\\.(safetensors|bin|pt|gguf|ckpt|pth)$')
UNION ALL SELECT page_id, path, 'checkpoint_file' FROM paths WHERE starts_with(path, 'checkpoints/')
UNION ALL SELECT page_id, path, 'raw_data' FROM paths WHERE starts_with(path, 'data/raw/')""",
)
def path_policy_scan(spark, sf_dir):
    return safety.path_policy_scan(_paths(spark, sf_dir), "path", ["page_id"])


@b.query(
    "path_policy_counts",
    f"""WITH {_PATH_SQL} SELECT rule, count(*) AS paths FROM (SELECT unnest(list_filter([CASE WHEN path IN ('.env', 'frontend/.env.local') THEN 'env_file' END,
  CASE WHEN regexp_matches(lower(path), '[^/]\\.(safetensors|bin|pt|gguf|ckpt|pth)$') THEN 'model_weights' END, CASE WHEN starts_with(path, 'checkpoints/') THEN 'checkpoint_file' END,
  CASE WHEN starts_with(path, 'data/raw/') THEN 'raw_data' END], lambda x: x IS NOT NULL)) AS rule FROM paths) GROUP BY rule""",
)
def path_policy_counts(spark, sf_dir):
    return safety.path_policy_counts(_paths(spark, sf_dir), "path")
