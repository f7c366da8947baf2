"""Text extraction, cleaning and chunking."""

from pyspark.sql import functions as F

from filingloom import constants as C
from filingloom.functions import html as ht
from filingloom.functions import text as tx
from filingloom.operators import chunks, sections
from filingloom.plans.catalog import base as b
from filingloom.session import load

_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def _sql_unescape(t: str) -> str:
    for name, char in _ENTITIES:
        t = f"replace({t}, {b.sql_str(name)}, {b.sql_str(char)})"
    return t


_BARE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)', chr(10), 'g'), '(?is)<style\b[^>]*>.*?(?:</style\s*>|\z)', chr(10), 'g'),
  '(?s)<!--.*?-->', chr(10), 'g'), '<[!/?A-Za-z](?:[^>"'']|"[^"]*"|''[^'']*'')*>', chr(10), 'g'), '<[!/?A-Za-z][^>]*>', chr(10), 'g')"""

_HTML_SQL = rf"""
SELECT page_id, array_to_string(list_filter(list_transform(string_split({_sql_unescape(_BARE)}, chr(10)),
  lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text
FROM pages"""


@b.query("html_to_text", _HTML_SQL)
def html_to_text(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", ht.html_to_text(F.col("html")).alias("text"))


@b.query("html_to_text_parsed", _HTML_SQL)
def html_to_text_parsed(spark, sf_dir):
    return load(spark, sf_dir, "pages").select(
        "page_id", ht.html_to_text_parsed(F.col("html")).alias("text")
    )


_ITEM_SQL = """items AS (
  SELECT doc_id, 'Item 1. Business' || chr(10) || 'Item 1A. Risk' || chr(10) || 'ITEM 7. Discussion' || chr(10)
    || 'Item 7A. Market' || chr(10) || 'Item 8. Statements' || chr(10)
    || 'Item 1. ' || text || chr(10) || 'Item 1A. ' || lang || ' ' || replace(text, 'e', 'E') || chr(10)
    || 'see Item 1A above. ' || source || chr(10) || 'Item 1B. none' || chr(10)
    || 'Item 7. ' || text || chr(10) || 'item 7 a ' || reverse(source) || chr(10)
    || 'Item 8. ' || CAST(n_chars AS VARCHAR) || chr(10) || 'Item 7. short' AS text
  FROM documents)"""


def _items(spark, sf_dir):
    """Item-structured text around each document: contents list, sections, cross references."""
    d = b.documents(spark, sf_dir)
    text, lang, source = F.col("text"), F.col("lang"), F.col("source")
    return d.select(
        "doc_id",
        F.concat(
            F.lit("Item 1. Business\nItem 1A. Risk\nITEM 7. Discussion\nItem 7A. Market\n"),
            F.lit("Item 8. Statements\nItem 1. "), text, F.lit("\nItem 1A. "), lang, F.lit(" "),
            F.replace(text, F.lit("e"), F.lit("E")), F.lit("\nsee Item 1A above. "), source, F.lit("\nItem 1B. none\nItem 7. "),
            text, F.lit("\nitem 7 a "), F.reverse(source), F.lit("\nItem 8. "),
            F.col("n_chars").cast("string"), F.lit("\nItem 7. short"),
        ).alias("text"),
    )


_SEGMENTS_SQL = rf"""{_ITEM_SQL},
cut AS (SELECT doc_id, string_split(regexp_replace(text, '(?i)(\bitem\s+\d{{1,2}}\s*(?:[a-z]\b)?)\b', chr(1) || '\1', 'g'), chr(1)) AS parts FROM items),
seg AS (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS body FROM cut),
anchors AS (
  SELECT doc_id, i - 2 AS pos, body,
    lower(regexp_extract(body, '(?i)^item\s+(\d{{1,2}})\s*([a-z])?\b', 1)) || lower(regexp_extract(body, '(?i)^item\s+(\d{{1,2}})\s*([a-z])?\b', 2)) AS item_id,
    coalesce(sum(length(body)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM seg QUALIFY i > 1)"""


@b.query(
    "heading_anchors",
    f"WITH {_SEGMENTS_SQL} SELECT doc_id, CAST(pos AS BIGINT) AS pos, item_id, CAST(start AS BIGINT) AS \"offset\" FROM anchors",
)
def heading_anchors(spark, sf_dir):
    return sections.heading_anchors(_items(spark, sf_dir), ["doc_id"], "text")


_SPANS_SQL = f"""WITH {_SEGMENTS_SQL},
runs AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (
    SELECT *, CASE WHEN item_id = lag(item_id) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM anchors)),
bodies AS (
  SELECT doc_id, run, any_value(item_id) AS item, {b.sql_trim("string_agg(body, '' ORDER BY pos)")} AS text
  FROM runs GROUP BY doc_id, run),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item ORDER BY length(text) DESC, run) AS rn FROM bodies
  WHERE item IN ('1', '1a', '7', '7a', '8'))
SELECT doc_id, item, CASE item WHEN '1' THEN 'business' WHEN '1a' THEN 'risk_factors' WHEN '7' THEN 'mda'
  WHEN '7a' THEN 'market_risk' ELSE 'financial_statements' END AS section, text
FROM best WHERE rn = 1 AND text <> ''"""


@b.query("section_spans", _SPANS_SQL)
def section_spans(spark, sf_dir):
    return sections.section_spans(_items(spark, sf_dir), ["doc_id"], "text")


_MANIFEST_SQL = f"""manifest AS (
  SELECT source_url AS raw_path, section, cik, ticker, form, filing_date, accession_number,
    length(text) AS text_chars, len({b.sql_words('text')}) AS text_words
  FROM docs WHERE len({b.sql_words('text')}) >= 100)"""


def _manifest(spark, sf_dir):
    d = b.docs(spark, sf_dir).withColumnRenamed("source_url", "raw_path")
    return sections.section_manifest(d, "text", min_section_words=100).select(
        "raw_path", "section", "cik", "ticker", "form", "filing_date", "accession_number",
        "text_chars", "text_words",
    )


@b.query("section_manifest", f"WITH {b.DOCS_SQL}, {_MANIFEST_SQL} SELECT * FROM manifest")
def section_manifest(spark, sf_dir):
    return _manifest(spark, sf_dir)


@b.query(
    "extraction_summary",
    f"""WITH {b.DOCS_SQL}, {_MANIFEST_SQL}
SELECT count(DISTINCT raw_path) AS filings, count(*) AS sections, CAST(sum(text_words) AS BIGINT) AS total_words,
  count(DISTINCT section) AS distinct_sections, string_agg(DISTINCT section, ',' ORDER BY section) AS found_sections,
  5 - count(DISTINCT section) AS missing_section_types
FROM manifest WHERE section <> 'other'""",
)
def extraction_summary(spark, sf_dir):
    return sections.extraction_summary(_manifest(spark, sf_dir).where("section <> 'other'"))


@b.query(
    "normalize_whitespace",
    r"""SELECT doc_id, array_to_string(list_filter(list_transform(
  string_split(regexp_replace(replace(text, '. ', '.  ' || chr(9) || chr(10) || ' '), '[ \t\r\f]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text
FROM documents""",
)
def normalize_whitespace(spark, sf_dir):
    ragged = F.replace("text", F.lit(". "), F.lit(".  \t\n "))
    return b.documents(spark, sf_dir).select(
        "doc_id", tx.normalize_whitespace(ragged).alias("text")
    )


@b.query(
    "token_count",
    f"SELECT doc_id, CAST(len({b.sql_words('text')}) AS BIGINT) AS tokens FROM documents",
)
def token_count(spark, sf_dir):
    return b.documents(spark, sf_dir).select(
        "doc_id", tx.word_count(F.col("text")).alias("tokens")
    )


def chunk_sql(source: str, cols: str, max_tokens: int = 512, overlap: int = 64, min_tokens: int = 80) -> str:
    """CTEs ending in ``chunks``: windows generated one by one and filtered by rule."""
    stride = max_tokens - overlap
    return f"""toks AS (SELECT {cols}, {b.sql_words('text')} AS t FROM {source}),
starts AS (SELECT {cols}, t, unnest(range(0, len(t), {stride})) AS s FROM toks),
wins AS (SELECT *, least(s + {max_tokens}, len(t)) AS e FROM starts WHERE s = 0 OR s - {stride} + {max_tokens} < len(t)),
sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_win,
  count(*) FILTER (e - s >= {min_tokens}) OVER (PARTITION BY doc_id) AS n_big FROM wins),
kept AS (SELECT * FROM sized WHERE e - s >= {min_tokens} OR n_win = 1 OR (n_big = 0 AND s = 0)),
chunks AS (SELECT {cols}, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS BIGINT) AS chunk_id,
  array_to_string(t[s + 1:e], ' ') AS text, CAST(e - s AS BIGINT) AS token_count,
  CAST(s AS BIGINT) AS start_token, CAST(e AS BIGINT) AS end_token FROM kept)"""


@b.query("chunk_windows", f"WITH {chunk_sql('documents', 'doc_id, source')} SELECT * FROM chunks")
def chunk_windows(spark, sf_dir):
    return chunks.chunk_windows(b.documents(spark, sf_dir), "text", ["doc_id", "source"])


@b.query(
    "chunk_windows_small",
    f"WITH {chunk_sql('documents', 'doc_id', 60, 15, 50)} SELECT * FROM chunks",
)
def chunk_windows_small(spark, sf_dir):
    return chunks.chunk_windows(
        b.documents(spark, sf_dir), "text", ["doc_id"], max_tokens=60, overlap=15, min_tokens=50
    )


@b.query(
    "sentences",
    f"WITH s AS (SELECT doc_id, {b.sql_sentences('text')} AS s FROM documents) "
    "SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS BIGINT) AS pos, unnest(s) AS sentence FROM s",
)
def sentences(spark, sf_dir):
    return b.documents(spark, sf_dir).select(
        "doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence")
    )


@b.query(
    "extractive_summary",
    f"WITH s AS (SELECT doc_id, text, {b.sql_sentences('text')} AS s FROM documents) "
    f"SELECT doc_id, {b.sql_summary('s', 'text', 4)} AS summary FROM s",
)
def extractive_summary(spark, sf_dir):
    return b.documents(spark, sf_dir).select(
        "doc_id", tx.extractive_summary(F.col("text"), 4).alias("summary")
    )


_WORDS_BANK = ("the ", "les ", "nicht", "que ")


@b.query(
    "keyword_sentences",
    f"WITH s AS (SELECT doc_id, {b.sql_sentences('text')} AS s FROM documents) SELECT doc_id, "
    f"array_to_string(list_filter(s, lambda x: {b.sql_contains_any('lower(x)', _WORDS_BANK)})[1:5], ' | ') AS hits FROM s",
)
def keyword_sentences(spark, sf_dir):
    found = tx.keyword_sentences(tx.sentences(F.col("text")), _WORDS_BANK)
    return b.documents(spark, sf_dir).select("doc_id", b.joined(found).alias("hits"))


_MONEY = r"\$\s?\d[\d,]*(?:\.\d+)?"
_METRIC_LIST = (
    rf"list_concat(regexp_extract_all(sold, '{C.MONEY}'), regexp_extract_all(sold, '{C.PERCENT}'), "
    rf"regexp_extract_all(sold, '(?i){C.MAGNITUDE}'), regexp_extract_all(sold, '(?i){C.BASIS_POINTS}'))"
)


@b.query(
    "metric_mentions",
    f"WITH {b.FIGURES_SQL}, m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sold, "
    f"list_transform({_METRIC_LIST}, lambda x: trim(x)) AS m FROM figures) "
    f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, "
    f"array_to_string({b.sql_distinct_ordered('m')}, ' | ') AS metrics FROM m",
)
def metric_mentions(spark, sf_dir):
    return b.figures(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        b.joined(tx.metric_mentions(F.col("sold"))).alias("metrics"),
    )


@b.query(
    "bullets",
    "SELECT doc_id, '- ' || array_to_string(string_split(text, chr(10)), chr(10) || '- ') AS bullets FROM documents",
)
def bullets(spark, sf_dir):
    return b.documents(spark, sf_dir).select(
        "doc_id", tx.bullets(F.split("text", "\n")).alias("bullets")
    )
