"""Registration of queries with their SQL checks, and the shared inputs.

Every query reads whole driver tables. Records the tables do not hold as such
(filings, sections, prediction pairs) are derived from them row by row, in Spark
and in SQL with the same expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingloom.session import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Registers a query; integer results are widened to BIGINT."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(spark, sf_dir)
            narrow = [
                f.name
                for f in df.schema.fields
                if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType))
            ]
            return df.withColumns({c: F.col(c).cast("long") for c in narrow}) if narrow else df

        run.__doc__ = build.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return build

    return register


# ---- SQL fragments ---------------------------------------------------------
BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


def sql_str(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(sql_str(i) for i in items) + "]"


def sql_trim(t: str) -> str:
    return f"trim({t}, {BLANKS})"


def sql_words(t: str) -> str:
    return rf"list_filter(string_split_regex({t}, '\s+'), lambda w: w <> '')"


def sql_sentences(t: str, min_words: int = 3) -> str:
    cut = rf"string_split(regexp_replace({t}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    return (
        f"list_filter(list_transform({cut}, lambda p: {sql_trim('p')}), "
        f"lambda s: len({sql_words('s')}) >= {min_words})"
    )


def sql_summary(sents: str, t: str, k: int) -> str:
    return (
        f"CASE WHEN len({sents}) > 0 THEN array_to_string({sents}[1:{k}], ' ') "
        f"ELSE coalesce(nullif(substring({sql_trim(t)}, 1, 300), ''), "
        f"'(no extractable content in excerpt)') END"
    )


def sql_contains_any(t: str, terms) -> str:
    return "(" + " OR ".join(f"contains({t}, {sql_str(x)})" for x in terms) + ")"


def sql_round(x: str, digits: int) -> str:
    """Correctly rounded decimal, by C formatting; adding zero removes a minus zero."""
    return f"(CAST(printf('%.{digits}f', {x}) AS DOUBLE) + 0.0)"


def sql_distinct_ordered(items: str) -> str:
    """First-seen distinct values of a list expression."""
    return (
        f"list_filter({items}, lambda v, i: list_position({items}, v) = i)"
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


# ---- section rows from documents ------------------------------------------
DOCS_SQL = """docs AS (
  SELECT doc_id, text, lang, source AS origin, n_chars,
    CASE WHEN source = 'src3' THEN 'market_risk' WHEN source = 'src7' THEN 'other'
         WHEN lang = 'en' THEN 'risk_factors' WHEN lang = 'fr' THEN 'mda'
         WHEN lang = 'de' THEN 'business' ELSE 'financial_statements' END AS section,
    CASE WHEN source IN ('src5', 'src9') THEN '' ELSE source END AS ticker,
    CASE WHEN source = 'src9' THEN '' ELSE lpad(substring(source, 4), 10, '0') END AS cik,
    CASE WHEN lang = 'es' THEN '10-K/A' ELSE '10-K' END AS form,
    CASE WHEN length(text) < 200 THEN '' ELSE CAST(2010 + length(text) // 1000 AS VARCHAR) || '-03-31' END AS filing_date,
    '' AS report_date,
    lpad(substring(source, 4), 10, '0') || '-24-' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS accession_number,
    'https://archive.example.org/' || source || '/' || CAST(doc_id AS VARCHAR) AS source_url
  FROM documents)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as processed section rows; two sources lack a ticker, one also a CIK."""
    d = documents(spark, sf_dir)
    src, lang = F.col("source"), F.col("lang")
    number = F.lpad(F.substring(src, 4, 10), 10, "0")
    doc = F.col("doc_id").cast("string")
    year = F.floor(F.length("text") / 1000) + 2010
    return d.select(
        "doc_id",
        "text",
        "lang",
        src.alias("origin"),
        "n_chars",
        F.when(src == "src3", "market_risk")
        .when(src == "src7", "other")
        .when(lang == "en", "risk_factors")
        .when(lang == "fr", "mda")
        .when(lang == "de", "business")
        .otherwise("financial_statements")
        .alias("section"),
        F.when(src.isin("src5", "src9"), "").otherwise(src).alias("ticker"),
        F.when(src == "src9", "").otherwise(number).alias("cik"),
        F.when(lang == "es", "10-K/A").otherwise("10-K").alias("form"),
        F.when(F.length("text") < 200, "")
        .otherwise(F.concat(year.cast("string"), F.lit("-03-31")))
        .alias("filing_date"),
        F.lit("").alias("report_date"),
        F.concat(number, F.lit("-24-"), F.lpad(doc, 9, "0")).alias("accession_number"),
        F.concat(F.lit("https://archive.example.org/"), src, F.lit("/"), doc).alias("source_url"),
    )


# ---- question / answer pairs from conversations ---------------------------
PAIRS_SQL = """pairs AS (
  SELECT a.conv_id, a.turn, q.text AS question, a.text AS answer
  FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn - 1
  WHERE a.role = 'assistant')"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn with the turn before it."""
    c = load(spark, sf_dir, "conversations")
    answers = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    return answers.join(before, ["conv_id", "turn"])


# ---- figure-bearing text from line items -----------------------------------
FIGURES_SQL = """figures AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    'Item ' || CAST(l_linenumber AS VARCHAR) || ' sold for $' || CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR)
    || ' at ' || CAST(CAST(l_discount * 100 AS DECIMAL(5,1)) AS VARCHAR) || '% off, about '
    || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' million units or 25 basis points.' AS sold,
    'Price $' || CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) || ' and tax '
    || CAST(CAST(l_tax * 100 AS DECIMAL(5,1)) AS VARCHAR) || ' % for '
    || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' million' AS billed
  FROM lineitem)"""


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sentences with amounts per line item."""
    return figures_of(load(spark, sf_dir, "lineitem"))


def figures_of(li: DataFrame) -> DataFrame:
    """The two sentences of the line items given."""

    def txt(c: Column, kind: str) -> Column:
        return c.cast(kind).cast("string")

    price = txt(F.col("l_extendedprice"), "decimal(12,2)")
    qty = txt(F.col("l_quantity"), "int")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.concat(
            F.lit("Item "), F.col("l_linenumber").cast("string"), F.lit(" sold for $"), price,
            F.lit(" at "), txt(F.col("l_discount") * 100, "decimal(5,1)"), F.lit("% off, about "),
            qty, F.lit(" million units or 25 basis points."),
        ).alias("sold"),
        F.concat(
            F.lit("Price $"), price, F.lit(" and tax "),
            txt(F.col("l_tax") * 100, "decimal(5,1)"), F.lit(" % for "), qty, F.lit(" million"),
        ).alias("billed"),
    )


# ---- filings from orders ---------------------------------------------------
FILINGS_SQL = """filings AS (
  SELECT o_orderkey,
    lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, 'C' || CAST(o_custkey AS VARCHAR) AS ticker,
    lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '-' || strftime(o_orderdate, '%y') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS accession_number,
    CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS filing_date,
    CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-Q' ELSE '8-K/A' END AS form,
    'doc' || CAST(o_orderkey AS VARCHAR) || '.htm' AS primary_document
  FROM orders)"""


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings of their customers; low-priority ones lack a date."""
    o = load(spark, sf_dir, "orders")
    cust, order = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    cik = F.lpad(cust, 10, "0")
    return o.select(
        "o_orderkey",
        cik.alias("cik"),
        F.concat(F.lit("C"), cust).alias("ticker"),
        F.concat(
            cik, F.lit("-"), F.date_format("o_orderdate", "yy"), F.lit("-"), F.lpad(order, 9, "0")
        ).alias("accession_number"),
        F.when(F.col("o_orderpriority") == "5-LOW", "")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("filing_date"),
        F.when(F.col("o_orderstatus") == "F", "10-K")
        .when(F.col("o_orderstatus") == "O", "10-Q")
        .otherwise("8-K/A")
        .alias("form"),
        F.concat(F.lit("doc"), order, F.lit(".htm")).alias("primary_document"),
    )


def joined(col: Column, sep: str = " | ") -> Column:
    """An array as one text, so that results compare as plain values."""
    return F.array_join(col, sep)
