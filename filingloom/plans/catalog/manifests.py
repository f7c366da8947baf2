"""Sources, sinks and manifests."""

from pyspark.sql import functions as F

from filingloom.operators import splits
from filingloom.operators.ranking import ordered_index
from filingloom.plans.catalog import base as b
from filingloom.sources import filings as fl
from filingloom.sources import jsonl
from filingloom.sources.seen import SeenIds
from filingloom.session import load, scratch_dir

_LINES_SQL = """lines AS (
  SELECT 'part-' || CAST(user_id AS VARCHAR) AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no,
    CASE event_type WHEN 'error' THEN '{"k": ' WHEN 'view' THEN '[1, 2]' WHEN 'signup' THEN '  ' ELSE props END AS line, event_id
  FROM events),
kinds AS (
  SELECT *, CASE WHEN trim(line) = '' THEN 'blank' WHEN NOT json_valid(line) THEN 'bad'
    WHEN json_type(line) = 'OBJECT' THEN 'object' ELSE 'other' END AS kind FROM lines)"""


def _lines(spark, sf_dir):
    """Event properties as lines of one file per user, some broken, some blank."""
    e = load(spark, sf_dir, "events")
    text = (
        F.when(F.col("event_type") == "error", '{"k": ')
        .when(F.col("event_type") == "view", "[1, 2]")
        .when(F.col("event_type") == "signup", "  ")
        .otherwise(F.col("props"))
    )
    rows = e.select(
        F.concat(F.lit("part-"), F.col("user_id").cast("string")).alias("file"),
        "ts",
        "event_id",
        text.alias("line"),
    )
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    return ordered_index(rows, ["file"], [F.col("ts"), F.col("event_id")], hour, "line_no").drop("ts")


@b.query(
    "jsonl_read_modes",
    f"""WITH {_LINES_SQL}
SELECT file, count(*) AS lines, count(*) FILTER (kind <> 'blank') AS audited, count(*) FILTER (kind = 'bad') AS bad_lines,
  count(*) FILTER (kind = 'object') AS lenient_rows, min(line_no) FILTER (kind = 'bad') AS first_bad_line
FROM kinds GROUP BY file""",
)
def jsonl_read_modes(spark, sf_dir):
    """What the audit, lenient and fail-fast policies would say about each file."""
    lines = _lines(spark, sf_dir).withColumn("kind", jsonl.line_kind(F.col("line")))
    kind = F.col("kind")
    return lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(kind != "blank").alias("audited"),
        F.count_if(kind == "bad").alias("bad_lines"),
        F.count_if(kind == "object").alias("lenient_rows"),
        F.min(F.when(kind == "bad", F.col("line_no"))).alias("first_bad_line"),
    )


_EVENT_FILES_SQL = """parts AS (SELECT 16 + count(*) // 100000 AS n FROM events),
stored AS (SELECT event_id, event_type, props, event_id % n AS part, row_number() OVER (PARTITION BY event_id % n ORDER BY event_id) AS line_no FROM events, parts)"""


def _event_files(spark, sf_dir, broken: bool):
    """Events as JSON Lines in many files, one folder each; errors, views and signups are no records."""
    e = load(spark, sf_dir, "events")
    parts = 16 + e.count() // 100_000
    kind = F.col("event_type")
    record = F.concat(
        F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "event_type": "'), kind,
        F.lit('", "props": '), F.col("props"), F.lit("}"),
    )
    line = F.when(kind == "signup", "  ")
    if broken:
        line = line.when(kind == "error", '{"event_id": ').when(kind == "view", "[1, 2]")
    rows = e.select((F.col("event_id") % parts).cast("int").alias("part"), "event_id", line.otherwise(record).alias("line"))
    path = scratch_dir(spark, "event-lines")
    ordered = rows.repartition(min(parts, 1000), "part").sortWithinPartitions("part", "event_id")
    ordered.select("part", "line").write.partitionBy("part").text(path)
    return path


_EVENT_SCHEMA = "event_id bigint, event_type string, props struct<k: bigint>"


@b.query(
    "jsonl_read_lenient",
    "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type NOT IN ('error', 'view', 'signup')",
)
def jsonl_read_lenient(spark, sf_dir):
    """Records of files in which some lines are blank, broken or no objects."""
    rows = jsonl.read_objects(spark, _event_files(spark, sf_dir, broken=True), _EVENT_SCHEMA)
    return rows.select("event_id", "event_type", "props.k")


@b.query(
    "jsonl_read_strict",
    "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'signup'",
)
def jsonl_read_strict(spark, sf_dir):
    """Records of files without a bad line; blank lines are none."""
    rows = jsonl.read_strict(spark, _event_files(spark, sf_dir, broken=False), _EVENT_SCHEMA)
    return rows.select("event_id", "event_type", "props.k")


@b.query(
    "jsonl_read_audit",
    f"""WITH {_EVENT_FILES_SQL} SELECT part, line_no, CASE event_type WHEN 'error' THEN 'bad' WHEN 'view' THEN 'other' ELSE 'object' END AS kind,
  length(CASE event_type WHEN 'error' THEN '{{"event_id": ' WHEN 'view' THEN '[1, 2]'
    ELSE '{{"event_id": ' || event_id || ', "event_type": "' || event_type || '", "props": ' || props || '}}' END) AS chars
FROM stored WHERE event_type <> 'signup'""",
)
def jsonl_read_audit(spark, sf_dir):
    """Every line that is not blank with its file, its number in the whole file, and its kind."""
    rows = jsonl.read_audit(spark, _event_files(spark, sf_dir, broken=True))
    part = F.regexp_extract("file", r"part=(\d+)/", 1).cast("bigint")
    return rows.select(part.alias("part"), "line_no", "kind", F.length("line").alias("chars"))


@b.query(
    "json_object_read",
    """WITH j AS (SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN '[1, 2]' WHEN 'signup' THEN '{"k": ' ELSE props END AS t FROM events)
SELECT event_id, CASE WHEN json_valid(t) AND json_type(t) = 'OBJECT' THEN CAST(json_extract(t, '$.k') AS BIGINT) END AS k,
  'event ' || CAST(event_id AS VARCHAR) || CASE WHEN t IS NULL THEN ': missing' WHEN NOT json_valid(t) THEN ': unreadable'
    WHEN json_type(t) <> 'OBJECT' THEN ': not an object' END AS warning
FROM j""",
)
def json_object_read(spark, sf_dir):
    text = (
        F.when(F.col("event_type") == "error", F.lit(None).cast("string"))
        .when(F.col("event_type") == "view", "[1, 2]")
        .when(F.col("event_type") == "signup", '{"k": ')
        .otherwise(F.col("props"))
    )
    e = load(spark, sf_dir, "events").select("event_id", text.alias("t"))
    name = F.concat(F.lit("event "), F.col("event_id").cast("string"))
    return e.select(
        "event_id",
        jsonl.json_object(F.col("t"), "k bigint")["k"].alias("k"),
        jsonl.object_warning(name, F.col("t")).alias("warning"),
    )


SPLIT_SQL = """keys AS (SELECT DISTINCT upper(coalesce(nullif(ticker, ''), nullif(cik, ''), 'UNK')) AS company FROM docs),
ranked AS (SELECT company, row_number() OVER (ORDER BY md5(company || '|42'), company) AS rn, count(*) OVER () AS n FROM keys),
wish AS (SELECT *, greatest(1, CAST(round_even(n * 0.05, 0) AS BIGINT)) AS t, greatest(1, CAST(round_even(n * 0.10, 0) AS BIGINT)) AS v FROM ranked),
assigned AS (SELECT company, CASE WHEN n <= 1 THEN 'train' WHEN rn <= t THEN 'test' WHEN rn <= t + v THEN 'validation' ELSE 'train' END AS split FROM wish),
split_docs AS (SELECT docs.*, company, split FROM docs JOIN assigned ON assigned.company = upper(coalesce(nullif(ticker, ''), nullif(cik, ''), 'UNK')))"""


def split_docs(spark, sf_dir):
    """Documents with company key and company-holdout split."""
    key = splits.company_key(F.col("ticker"), F.col("cik"))
    return splits.split_examples(b.docs(spark, sf_dir).withColumn("company", key), F.col("company"))


@b.query(
    "write_split_dataset",
    f"WITH {b.DOCS_SQL}, {SPLIT_SQL} SELECT doc_id, text, section, ticker, split FROM split_docs",
)
def write_split_dataset(spark, sf_dir):
    """Written as JSON Lines, one folder per split, and read back."""
    rows = split_docs(spark, sf_dir).select("doc_id", "text", "section", "ticker", "split")
    path = jsonl.write_splits(rows, scratch_dir(spark, "splits"), "json")
    return jsonl.read_splits(spark, path, rows.schema, "json")


@b.query(
    "dataset_manifest",
    f"WITH {b.DOCS_SQL}, {SPLIT_SQL} SELECT CAST(doc_id AS VARCHAR) AS id, split, 'filing_qa' AS task_type, section, ticker, origin AS source FROM split_docs",
)
def dataset_manifest(spark, sf_dir):
    rows = split_docs(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("id"),
        "split",
        F.lit("filing_qa").alias("task_type"),
        F.struct("section", "ticker").alias("metadata"),
        F.col("origin").alias("source"),
    )
    return jsonl.dataset_manifest(rows)


def _register(spark, sf_dir):
    """Customers as a company register, read from JSON objects."""
    c = load(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    obj = F.concat(
        F.lit('{"'), key, F.lit('": {"cik_str": '), key, F.lit(', "ticker": "c'), key,
        F.lit('", "title": "'), F.col("c_name"), F.lit('"}}'),
    )
    return fl.company_register(c.select(obj.alias("obj")), "obj")


def _wanted(spark, sf_dir):
    """Requested tickers: one per part, of which many are unknown."""
    key = F.col("p_partkey").cast("string")
    return load(spark, sf_dir, "part").select(F.concat(F.lit(" c"), key).alias("ticker"))


@b.query(
    "ticker_lookup",
    """SELECT DISTINCT 'C' || CAST(p_partkey AS VARCHAR) AS ticker, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, c_custkey IS NOT NULL AS known
FROM part LEFT JOIN customer ON c_custkey = p_partkey""",
)
def ticker_lookup(spark, sf_dir):
    return fl.resolve_tickers(_wanted(spark, sf_dir), _register(spark, sf_dir))


@b.query(
    "company_register",
    "SELECT 'C' || CAST(c_custkey AS VARCHAR) AS ticker, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, c_name AS title FROM customer",
)
def company_register(spark, sf_dir):
    return _register(spark, sf_dir).drop("position")


@b.query(
    "normalize_cik",
    """SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS padded, CAST(c_custkey AS VARCHAR) || '12345678901' AS long_number,
  CAST(NULL AS VARCHAR) AS no_digits FROM customer""",
)
def normalize_cik(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    return load(spark, sf_dir, "customer").select(
        "c_custkey",
        fl.normalize_cik(F.concat(F.lit("CIK "), key)).alias("padded"),
        fl.normalize_cik(F.concat(key, F.lit("-12345678901"))).alias("long_number"),
        fl.normalize_cik(F.col("c_mktsegment")).alias("no_digits"),
    )


@b.query(
    "filing_history",
    """WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS acc, string_split(text, '. ') AS fd, string_split(text, ', ') AS rd, string_split(text, ' ') AS fo, [source] AS pd FROM documents),
p AS (SELECT *, unnest(range(len(acc))) AS pos FROM a)
SELECT doc_id, pos, acc[pos + 1] AS accession_number, coalesce(fd[pos + 1], '') AS filing_date, coalesce(rd[pos + 1], '') AS report_date,
  coalesce(fo[pos + 1], '') AS form, coalesce(pd[pos + 1], '') AS primary_document FROM p""",
)
def filing_history(spark, sf_dir):
    """Parallel arrays of unequal length, cut from each document."""
    d = load(spark, sf_dir, "documents").select(
        "doc_id",
        F.split("text", "\n").alias("accession_number"),
        F.split("text", r"\. ").alias("filing_date"),
        F.split("text", ", ").alias("report_date"),
        F.split("text", " ").alias("form"),
        F.array("source").alias("primary_document"),
    )
    return fl.filing_history(d, ["doc_id"], "accession_number")


@b.query(
    "filing_filter",
    f"""WITH {b.FILINGS_SQL} SELECT * FROM filings WHERE upper(form) IN ('10-K', '8-K/A')
  AND try_cast(substring(filing_date, 1, 4) AS INTEGER) BETWEEN 1995 AND 1998""",
)
def filing_filter(spark, sf_dir):
    return fl.filter_filings(b.filings(spark, sf_dir), ["10-k", "8-K/a"], 1995, 1998)


@b.query(
    "filing_filter_open",
    f"WITH {b.FILINGS_SQL} SELECT * FROM filings WHERE form = '10-Q'",
)
def filing_filter_open(spark, sf_dir):
    """Without a year bound, filings without a date stay."""
    return fl.filter_filings(b.filings(spark, sf_dir), ["10-q"])


@b.query(
    "newest_n_per_company",
    f"WITH {b.FILINGS_SQL} SELECT * FROM filings QUALIFY row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, o_orderkey) <= 3",
)
def newest_n_per_company(spark, sf_dir):
    return fl.newest_filings(b.filings(spark, sf_dir), 3, "o_orderkey")


_URLS = """replace(accession_number, '-', '') AS accession_number_no_dashes,
  'https://www.sec.gov/Archives/edgar/data/' || CAST(CAST(cik AS BIGINT) AS VARCHAR) || '/' || replace(accession_number, '-', '') || '/' || accession_number || '-index.htm' AS filing_url,
  'https://www.sec.gov/Archives/edgar/data/' || CAST(CAST(cik AS BIGINT) AS VARCHAR) || '/' || replace(accession_number, '-', '') || '/' || primary_document AS document_url"""


@b.query("filing_urls", f"WITH {b.FILINGS_SQL} SELECT o_orderkey, {_URLS} FROM filings")
def filing_urls(spark, sf_dir):
    return fl.with_filing_urls(b.filings(spark, sf_dir)).select(
        "o_orderkey", "accession_number_no_dashes", "filing_url", "document_url"
    )


def _sql_path(ticker: str) -> str:
    return (
        f"coalesce(nullif({ticker}, ''), cik) || '/' || replace(form, '/', '-') || '/' || "
        "coalesce(nullif(substring(filing_date, 1, 4), ''), '0000') || '/' || replace(accession_number, '-', '') || '.html'"
    )


@b.query(
    "storage_path",
    f"WITH {b.FILINGS_SQL}, f AS (SELECT *, CASE WHEN form = '10-Q' THEN '' ELSE ticker END AS t FROM filings) SELECT o_orderkey, {_sql_path('t')} AS path FROM f",
)
def storage_path(spark, sf_dir):
    ticker = F.when(F.col("form") == "10-Q", "").otherwise(F.col("ticker"))
    bare = F.replace("accession_number", F.lit("-"), F.lit(""))
    path = fl.storage_path(ticker, F.col("cik"), F.col("form"), F.col("filing_date"), bare)
    return b.filings(spark, sf_dir).select("o_orderkey", path.alias("path"))


@b.query(
    "download_manifest",
    f"""WITH {b.FILINGS_SQL},
wanted AS (SELECT DISTINCT lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS cik, 'C' || CAST(p_partkey AS VARCHAR) AS ticker FROM part JOIN customer ON c_custkey = p_partkey),
chosen AS (SELECT f.* EXCLUDE (ticker), w.ticker FROM filings f JOIN wanted w USING (cik)
  QUALIFY row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, accession_number) <= 2),
flagged AS (SELECT *, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS downloaded FROM chosen)
SELECT ticker, cik, accession_number, form, filing_date, {_URLS}, downloaded,
  CASE WHEN downloaded THEN {_sql_path('ticker')} ELSE '' END AS raw_path FROM flagged""",
)
def download_manifest(spark, sf_dir):
    """A filing counts as fetched when its order has line items."""
    f = b.filings(spark, sf_dir)
    items = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    fetched = f.join(items, "o_orderkey", "left_semi").select("accession_number")
    requested = fl.resolve_tickers(_wanted(spark, sf_dir), _register(spark, sf_dir))
    return fl.download_manifest(requested, f, fetched, limit_per_company=2).select(
        "ticker", "cik", "accession_number", "form", "filing_date", "accession_number_no_dashes",
        "filing_url", "document_url", "downloaded", "raw_path",
    )


@b.query(
    "not_yet_stored",
    f"WITH {b.FILINGS_SQL} SELECT * FROM filings WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000)",
)
def not_yet_stored(spark, sf_dir):
    stored = load(spark, sf_dir, "orders").where("o_totalprice > 300000").select("o_orderkey")
    return fl.not_yet_stored(b.filings(spark, sf_dir), stored, "o_orderkey")


_BATCHES = 4
_ARRIVALS_SQL = f"""arrivals AS (SELECT o_orderkey, batch FROM orders, range({_BATCHES}) t(batch) WHERE o_orderkey % {_BATCHES} = batch OR o_orderkey % 7 = batch)"""


@b.query(
    "not_yet_stored_batches",
    f"""WITH {_ARRIVALS_SQL}, seen AS (SELECT o_orderkey, min(batch) AS first_batch FROM arrivals GROUP BY o_orderkey)
SELECT o_orderkey, first_batch FROM seen""",
)
def not_yet_stored_batches(spark, sf_dir):
    """Filings that arrive in batches, some again: each is kept with the batch it is new in."""
    orders = load(spark, sf_dir, "orders").select("o_orderkey")
    store = SeenIds(spark, scratch_dir(spark, "seen"), expected=max(1, orders.count()))
    kept = None
    for batch in range(_BATCHES):
        here = orders.where((F.col("o_orderkey") % _BATCHES == batch) | (F.col("o_orderkey") % 7 == batch))
        fresh = store.add(here, "o_orderkey").withColumn("first_batch", F.lit(batch).cast("long"))
        kept = fresh if kept is None else kept.unionByName(fresh)
    return kept


@b.query(
    "ticker_list",
    """SELECT c_custkey, 'C' || CAST(c_custkey AS VARCHAR) || ',' || upper(c_mktsegment) || ',' || upper(c_name) AS tickers FROM customer""",
)
def ticker_list(spark, sf_dir):
    key, segment = F.col("c_custkey").cast("string"), F.lower("c_mktsegment")
    raw = F.concat(
        F.lit("c"), key, F.lit(", "), segment, F.lit(",, C"), key, F.lit(" ,"), F.col("c_name"),
        F.lit(","), F.col("c_mktsegment"),
    )
    return load(spark, sf_dir, "customer").select(
        "c_custkey", b.joined(fl.ticker_list(raw), ",").alias("tickers")
    )


_MANIFEST_SQL = """manifest AS (SELECT event_id, CASE WHEN event_type = 'signup' THEN '' ELSE 'docs/' || CAST(event_id AS VARCHAR) END AS raw_path FROM events),
files AS (SELECT 'docs/' || CAST(doc_id AS VARCHAR) AS raw_path, text AS content FROM documents)"""


def _manifest_and_files(spark, sf_dir):
    path = F.when(F.col("event_type") == "signup", "").otherwise(
        F.concat(F.lit("docs/"), F.col("event_id").cast("string"))
    )
    manifest = load(spark, sf_dir, "events").select("event_id", path.alias("raw_path"))
    files = load(spark, sf_dir, "documents").select(
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("raw_path"),
        F.col("text").alias("content"),
    )
    return manifest, files


@b.query(
    "manifest_file_join",
    f"WITH {_MANIFEST_SQL} SELECT event_id, raw_path, content FROM manifest JOIN files USING (raw_path)",
)
def manifest_file_join(spark, sf_dir):
    return fl.attach_files(*_manifest_and_files(spark, sf_dir))


@b.query(
    "manifest_missing_files",
    f"WITH {_MANIFEST_SQL} SELECT event_id, raw_path FROM manifest WHERE raw_path NOT IN (SELECT raw_path FROM files)",
)
def manifest_missing_files(spark, sf_dir):
    return fl.missing_files(*_manifest_and_files(spark, sf_dir))


_PAGE_FILES_SQL = """listed AS (SELECT page_id, html, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'page=' || CAST(page_id AS VARCHAR) END AS raw_path FROM pages),
stored AS (SELECT 'page=' || CAST(page_id AS VARCHAR) AS raw_path, html || chr(10) AS content FROM pages WHERE page_id % 7 <> 0)"""


def _page_files(spark, sf_dir):
    """Pages as files, of which every seventh was never fetched; and their manifest."""
    pages = load(spark, sf_dir, "pages")
    folder = scratch_dir(spark, "pages")
    name = F.concat(F.lit("page="), F.col("page_id").cast("string"))
    fl.write_files(pages.where("page_id % 7 <> 0").select(name.alias("name"), "html"), folder, "name", "html")
    path = F.when(F.col("page_id") % 5 == 0, "").otherwise(name)
    return folder, pages.select("page_id", path.alias("raw_path"))


def _page_path(folder):
    """The manifest names a file without the folder of the task that wrote it."""
    return F.substring_index(fl.below(F.col("raw_path"), folder), "/", -1)


@b.query(
    "whole_file_read",
    f"WITH {_PAGE_FILES_SQL} SELECT page_id, raw_path, octet_length(encode(content))::BIGINT AS size, sha256(content) AS content_sha256 FROM listed JOIN stored USING (raw_path)",
)
def whole_file_read(spark, sf_dir):
    """Manifest rows with their files, read whole."""
    folder, manifest = _page_files(spark, sf_dir)
    files = fl.read_whole_files(spark, folder).withColumn("raw_path", _page_path(folder))
    return fl.attach_files(manifest, files).select("page_id", "raw_path", "size", F.sha2("content", 256).alias("content_sha256"))


@b.query(
    "whole_file_limit",
    f"""WITH {_PAGE_FILES_SQL}, big AS (SELECT raw_path, octet_length(encode(content))::BIGINT AS size, content FROM stored)
SELECT page_id, size, size > 4000 AS skipped, sha256(CASE WHEN size > 4000 THEN '' ELSE content END) AS content_sha256 FROM listed JOIN big USING (raw_path)""",
)
def whole_file_limit(spark, sf_dir):
    """As ``whole_file_read``, but files of more than 4,000 bytes are not opened."""
    folder, manifest = _page_files(spark, sf_dir)
    files = fl.read_whole_files(spark, folder, max_bytes=4000).withColumn("raw_path", _page_path(folder))
    return fl.attach_files(manifest, files).select(
        "page_id", "size", F.col("content").isNull().alias("skipped"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_sha256")
    )


@b.query(
    "whole_file_missing",
    f"WITH {_PAGE_FILES_SQL} SELECT page_id, raw_path FROM listed WHERE raw_path NOT IN (SELECT raw_path FROM stored)",
)
def whole_file_missing(spark, sf_dir):
    """Manifest rows without a file, from the listing alone."""
    folder, manifest = _page_files(spark, sf_dir)
    return fl.missing_files(manifest, fl.list_files(spark, folder).withColumn("raw_path", _page_path(folder)))


@b.query(
    "path_identifiers",
    r"""WITH p AS (SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '' AND x <> '.') AS p FROM pages)
SELECT page_id, coalesce(p[-4], 'UNKNOWN') AS ticker_or_cik, coalesce(p[-3], 'UNKNOWN') AS form, coalesce(p[-2], '0000') AS "year",
  regexp_replace(p[-1], '^(.+)\.[^.]+$', '\1') AS accession FROM p""",
)
def path_identifiers(spark, sf_dir):
    return load(spark, sf_dir, "pages").select(
        "page_id", fl.path_identifiers(F.col("url")).alias("i")
    ).select("page_id", "i.*")


@b.query(
    "path_identifiers_metadata",
    f"""WITH {b.DOCS_SQL} SELECT doc_id, coalesce(nullif(ticker, ''), nullif(cik, ''), 'https:') AS ticker_or_cik, replace(form, '/', '-') AS form,
  coalesce(nullif(substring(filing_date, 1, 4), ''), origin) AS "year", replace(accession_number, '-', '') AS accession FROM docs""",
)
def path_identifiers_metadata(spark, sf_dir):
    d = b.docs(spark, sf_dir)
    bare = F.replace("accession_number", F.lit("-"), F.lit(""))
    ids = fl.path_identifiers(
        F.col("source_url"), F.col("ticker"), F.col("cik"), F.col("form"), F.col("filing_date"), bare
    )
    return d.select("doc_id", ids.alias("i")).select("doc_id", "i.*")


@b.query(
    "artifact_inventory",
    """WITH expected AS (SELECT DISTINCT source || '-' || lang AS name, 'reports/' || source || '/' || lang AS path FROM documents),
present AS (SELECT DISTINCT 'reports/' || source || '/' || lang AS path FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT name, path, path IN (SELECT path FROM present) AS available,
  CASE WHEN path NOT IN (SELECT path FROM present) THEN name || ': not available (' || path || ')' END AS warning FROM expected""",
)
def artifact_inventory(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    path = F.concat(F.lit("reports/"), F.col("source"), F.lit("/"), F.col("lang")).alias("path")
    expected = d.select(F.concat_ws("-", "source", "lang").alias("name"), path).distinct()
    toxic = load(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return fl.artifact_inventory(expected, d.join(toxic, "doc_id", "left_semi").select(path))
