"""The registered queries of the operators, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.functions.text import let
from filingloom.llm import exact, language, lines, mixing, ngram_join, packing, pivots, quality, reconcile, runs, secrets, spelling, token_files
from filingloom.session import load, scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


@query(
    "op3_exact_dedup",
    f"""
WITH n AS (SELECT doc_id, {LOWERED.format("coalesce(text, '')")} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM n JOIN g USING (t)
""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents; the largest id of each stays."""
    return exact.exact_groups(load(spark, sf_dir, "documents"))


@query(
    "op8_line_dedup",
    f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT *, {LOWERED.format("trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))")} AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (f.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key
GROUP BY doc_id
""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share, dropped from all documents."""
    kept = lines.drop_frequent_lines(load(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written, read back and summed up per document."""
    docs = load(spark, sf_dir, "documents")
    back = token_files.token_files(spark, docs, scratch_dir(spark, "token-files"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(load(spark, sf_dir, "documents"))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from documents that are not held out."""
    docs = load(spark, sf_dir, "documents")
    held_out = F.coalesce(language.id_remainder("doc_id", 4) == 2, F.lit(False))
    samples = language.learn(docs.where(~held_out))
    found = language.identify(docs, samples)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learned from labelled ones that are not held out."""
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    held_out = F.coalesce(language.id_remainder("doc_id", 5) == 0, F.lit(False))
    forest = quality.learn(docs, labels.where(~held_out))
    scored = quality.score(docs, forest)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query("op2_embedding_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.93 within a label."""
    return pivots.near_vectors(load(spark, sf_dir, "embeddings"))


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def _secrets_sql() -> str:
    """The scan in SQL, from the same patterns."""
    parts = []
    for rank, part in enumerate(secrets.STRONG + secrets.WEAK, 1):
        whole = f"(?s)(.*?)({part.pattern})({part.value or ''})".replace("'", "''")
        gap, head, value = (f"regexp_extract_all(s, '{whole}', {g})" for g in (1, 2, 3))
        counted = "length(value)" if part.value else "length(head)"
        parts.append(
            f"""SELECT doc_id, kind, rank, pos, length(gap) AS gap, length(head) + length(value) AS size, {counted} >= {part.least} AS counts
  FROM (SELECT doc_id, '{part.kind}' AS kind, {rank} AS rank, unnest({gap}) AS gap, unnest({head}) AS head,
               unnest({value}) AS value, generate_subscripts({gap}, 1) AS pos FROM t)"""
        )
    strong = len(secrets.STRONG)
    fits = " OR ".join(
        f"(w.kind = '{kind}' AND r.kind IN ({', '.join(repr(k) for k in others)}))"
        for kind, others in secrets.COMPLEMENTS.items()
    )
    reach = secrets.REACH
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS s FROM documents),
m AS ({" UNION ALL ".join(parts)}),
e AS (SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, kind ORDER BY pos) AS stop FROM m),
p AS (SELECT doc_id, kind, rank, stop - size AS start, stop FROM e WHERE counts),
weak AS (
  SELECT * FROM p w WHERE rank > {strong} AND NOT EXISTS (
    SELECT 1 FROM p r WHERE r.doc_id = w.doc_id AND r.kind <> 'opaque' AND (r.kind <> w.kind OR r.start <> w.start)
      AND (w.kind = 'opaque' OR r.rank <= {strong}) AND w.start < r.stop AND r.start < w.stop)),
able AS (SELECT * FROM p WHERE rank <= {strong} UNION ALL SELECT * FROM weak),
found AS (
  SELECT * FROM p WHERE rank <= {strong}
  UNION ALL
  SELECT * FROM weak w WHERE EXISTS (
    SELECT 1 FROM able r WHERE r.doc_id = w.doc_id AND ({fits})
      AND w.start < r.stop + {reach} AND r.start < w.stop + {reach})),
named AS (SELECT *, concat_ws(':', kind, start::BIGINT, stop::BIGINT) AS span FROM found)
SELECT t.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (rank <= {strong}), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
FROM t LEFT JOIN named ON t.doc_id = named.doc_id
GROUP BY t.doc_id
"""


@query("op7_secret_scan", _secrets_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: strong forms, and weak parts beside their complement."""
    found = secrets.scan(load(spark, sf_dir, "documents"))
    strong = {p.kind: F.filter("spans", _of_kind(p.kind)) for p in secrets.STRONG}
    base = F.filter("spans", lambda s: s["rank"] <= len(secrets.STRONG))
    return found.select(
        "doc_id",
        *[F.size(spans).cast("long").alias(f"n_{kind}") for kind, spans in strong.items()],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


@query("op5_ngram_jaccard")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by the Jaccard similarity of their word shingles."""
    return ngram_join.similar_documents(load(spark, sf_dir, "documents"))


#: weights of the example tree; other nodes have weight 1
DOMAIN_WEIGHTS = {
    ("domain0",): 4,
    ("domain1",): 3,
    ("domain2",): 2,
    ("domain3",): 1,
    **{(f"domain{d}", lang): w for d in range(4) for lang, w in (("en", 5), ("de", 2), ("fr", 2))},
}


def domain_of(source: Column) -> Column:
    """Four domains by the number at the end of a source's name; other sources have none."""
    number = F.expr("try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) AS int)")
    return F.when(source.rlike("[0-9]$"), F.concat(F.lit("domain"), (number % 4).cast("string")))


@query("op6_source_mixing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn to the weights of domains, languages and sources: half of all tokens."""
    docs = load(spark, sf_dir, "documents")
    domain = domain_of(F.col("source"))
    leaves = mixing.plan(docs, DOMAIN_WEIGHTS, domain, share=0.5, max_epochs=2)
    drawn = mixing.select(docs, leaves, domain)
    return drawn.select("doc_id", domain.alias("domain"), "lang", "source", "mix_epoch", mixing.token_count(F.col("text")).alias("n_tokens"))


def _crc32_sql(points: str) -> str:
    """Unsigned crc32 of a list of byte values, bit by bit."""
    bits = f"flatten(list_transform({points}, lambda b: list_transform(range(8), lambda k: (b >> k) & 1)))"
    step = "xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}::BIGINT[]), lambda c, b: {step}), 4294967295::BIGINT)"


def _digits_sql(number: str) -> str:
    return f"list_transform(string_split({number}::VARCHAR, ''), lambda d: ord(d)::BIGINT)"


def _runs_sql(levels: int = 14) -> str:
    """Runs by the names of factors of 1, 2, 4 ... words; periods up to ``2 ** levels``."""
    blanks = r"[\x20\x09-\x0D]+"
    ctes = [
        f"""h AS (SELECT doc_id, {_crc32_sql(_digits_sql("doc_id"))} AS h,
  list_filter(string_split_regex(coalesce(text, ''), '{blanks}'), lambda w: w <> '') AS words FROM documents)""",
        """e AS (SELECT *, len(words) AS n, h // 10 AS g FROM h)""",
        """c AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM e)""",
        """p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM c)""",
        """raw AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM p)""",
        """w AS MATERIALIZED (SELECT r.doc_id, r.i, o.word FROM raw r JOIN p ON p.doc_id = r.doc_id
  JOIN raw o ON o.doc_id = r.doc_id AND o.i = CASE WHEN r.i < p.a THEN r.i ELSE p.a + (r.i - p.a) % p.p END)""",
        """l0 AS MATERIALIZED (SELECT doc_id, i, min(i) OVER f AS name, count(*) OVER f AS times,
  lead(i) OVER (PARTITION BY doc_id, word ORDER BY i) - i AS gap FROM w WINDOW f AS (PARTITION BY doc_id, word))""",
    ]
    for k in range(1, levels + 1):
        ctes.append(
            f"""l{k} AS MATERIALIZED (SELECT doc_id, i, min(i) OVER f AS name, count(*) OVER f AS times,
  lead(i) OVER (PARTITION BY doc_id, a, b ORDER BY i) - i AS gap
  FROM (SELECT x.doc_id, x.i, x.name AS a, y.name AS b FROM l{k - 1} x JOIN l{k - 1} y
        ON y.doc_id = x.doc_id AND y.i = x.i + {1 << (k - 1)} WHERE x.times > 1 AND y.times > 1)
  WINDOW f AS (PARTITION BY doc_id, a, b))"""
        )
    gaps = " UNION ALL ".join(
        f"SELECT doc_id, i, gap, {1 << k} AS size FROM l{k} WHERE gap > {(1 << k) // 2} AND gap <= {1 << k}"
        for k in range(levels + 1)
    )
    return f"""
WITH {", ".join(ctes)},
gaps AS ({gaps}),
isles AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, size, gap ORDER BY i) AS isle FROM gaps),
runs AS MATERIALIZED (
  SELECT doc_id, min(i) AS start, count(*) - 1 + gap + size AS length, gap AS period FROM isles
  GROUP BY doc_id, size, gap, isle HAVING count(*) - 1 + gap + size >= greatest(6, 4 * gap)),
dropped AS (SELECT DISTINCT w.doc_id, w.i FROM w JOIN runs r ON r.doc_id = w.doc_id
  AND w.i >= r.start + r.period AND w.i < r.start + r.length),
kept AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS words FROM w ANTI JOIN dropped d
  ON d.doc_id = w.doc_id AND d.i = w.i GROUP BY w.doc_id),
per AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS listed
  FROM runs GROUP BY doc_id),
top AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM documents d LEFT JOIN per ON per.doc_id = d.doc_id LEFT JOIN top ON top.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def repeated_tail(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten, by crc32 of its id, repeats a stretch of words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def edited(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.concat_ws(" ", F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))))

    blank = F.trim(F.lit(" \t\n\x0b\x0c\r"), F.coalesce("text", F.lit(""))) == ""
    return docs.select("doc_id", F.when((h % 10 == 0) & ~blank, let(words, edited)).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs", _runs_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, one in ten of them with a repeated tail."""
    found = runs.periodic_runs(repeated_tail(load(spark, sf_dir, "documents")))
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    listed = F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = found.withColumn("top", F.array_max(ranked))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def half_replaced(rows: DataFrame) -> DataFrame:
    """Adds the text whose last half is the beginning of the following one."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    return rows.withColumns({"n_chars": n.cast("long"), "edited": edited})


@query("op12_document_fingerprints")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, and how like they are to an edited text and to the next document."""

    def work(rows: DataFrame) -> DataFrame:
        texts = half_replaced(rows).withColumn("edited_sha256", F.sha2("edited", 256))
        keep = ["part", "edge", "edge_text", "id", "n_chars", "edited_sha256"]
        found = reconcile.compare_versions(texts, keep, "text", ["edited", "next_text"], digests=False)
        return found.select(
            *keep,
            F.unbase64("fingerprint").alias("fingerprint"),
            F.unbase64("edited_fingerprint").alias("edited_fingerprint"),
            F.col("edited_difference.likeness").alias("near_edited"),
            F.col("next_text_difference.likeness").alias("near_next"),
        )

    found = reconcile.with_following(load(spark, sf_dir, "documents"), work).withColumnRenamed("id", "doc_id")
    # base64() breaks its lines
    return found.withColumns({c: F.translate(F.base64(c), "\r\n", "") for c in ("fingerprint", "edited_fingerprint")})


def _spelling_sql() -> str:
    """The words, all pairs by their deletions, and the chains of forms."""
    run = LOWERED.format("coalesce(text, '')")
    bytes_of = (
        "flatten(list_transform(string_split(concat(doc_id, ':', run), ''), "
        "lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END))"
    )
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all({run}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS c FROM t WHERE length(run) >= 7 GROUP BY doc_id, run),
h AS (SELECT *, {_crc32_sql(bytes_of)} AS h FROM c),
w AS (SELECT CASE WHEN h % 31 = 0 THEN concat(left(run, (h % length(run))::INT), substr(run, (h % length(run))::INT + 2)) ELSE run END AS word, c FROM h),
words AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
less AS MATERIALIZED (
  SELECT word, n, i, concat(left(word, i::INT), substr(word, i::INT + 2)) AS d
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT x.word, y.word AS near FROM less x JOIN less y ON x.d = y.d AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, x.d FROM less x JOIN words y ON y.word = x.d
  UNION SELECT x.d, x.word FROM less x JOIN words y ON y.word = x.d),
best AS (
  SELECT p.word, p.near, f.n AS form_n, count(*) OVER (PARTITION BY p.word) AS n_near,
    row_number() OVER (PARTITION BY p.word ORDER BY f.n DESC, p.near) AS place
  FROM pairs p JOIN words f ON f.word = p.near),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.form_n >= 10 * w.n THEN b.near END AS form,
    CASE WHEN b.form_n >= 10 * w.n THEN b.form_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.place = 1),
chain AS (
  SELECT word, word AS root, form AS further FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.further)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word WHERE c.further IS NULL
"""


@query("op11_spelling_variants", _spelling_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of the words of all documents, after one run in 31 has lost a letter."""
    words = spelling.word_counts(load(spark, sf_dir, "documents"), rewrite=spelling.Drops(31))
    return spelling.spelling_variants(words)
