"""Per-row scores of a prediction against a reference or a source text."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingloom import constants as C
from filingloom.functions import text as tx
from filingloom.session import ship_package


def without_punctuation(col: Column) -> Column:
    return F.translate(F.lower(tx.text_or_empty(col)), C.PUNCTUATION, "")


def answer_tokens(col: Column) -> Column:
    """Lower-case words without punctuation and articles."""
    return tx.words(F.regexp_replace(without_punctuation(col), "(?U)" + C.ARTICLES, " "))


def norm_answer(col: Column) -> Column:
    return F.array_join(answer_tokens(col), " ")


def norm_keep_articles(col: Column) -> Column:
    return F.array_join(tx.words(without_punctuation(col)), " ")


def exact_match(prediction: Column, reference: Column) -> Column:
    return (norm_answer(prediction) == norm_answer(reference)).cast("double")


def occurrence_tags(tokens: Column) -> Column:
    """Tokens numbered within equal tokens (``x1 x2 y1``), so that a plain set
    intersection of two results has the size of the multiset intersection.

    Sorting first makes equal tokens neighbours; the cost is that of the sort
    instead of one scan per distinct token.
    """

    def tag(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )
        return tx.let(
            starts,
            lambda st: F.flatten(
                F.transform(
                    st,
                    lambda first, j: F.transform(
                        F.sequence(F.lit(1), F.coalesce(F.get(st, j + 1), F.size(s)) - first),
                        lambda k: F.concat(F.get(s, first), F.lit(" "), k.cast("string")),
                    ),
                )
            ),
        )

    return tx.let(
        F.sort_array(tokens),
        lambda s: F.when(F.size(s) == 0, F.array().cast("array<string>")).otherwise(tag(s)),
    )


def _f_measure(counts: Column) -> Column:
    """Precision, recall and F1 of a struct (overlap, n_pred, n_ref)."""

    def measure(c: Column) -> Column:
        p = c["overlap"] / F.greatest(c["n_pred"], F.lit(1))
        r = c["overlap"] / F.greatest(c["n_ref"], F.lit(1))
        zero = F.lit(0.0)
        hit = c["overlap"] > 0
        return F.struct(
            F.when(hit, p).otherwise(zero).alias("precision"),
            F.when(hit, r).otherwise(zero).alias("recall"),
            F.when(hit, F.lit(2.0) * p * r / (p + r)).otherwise(zero).alias("f1"),
        )

    return tx.let(counts, measure)


def token_overlap(prediction: Column, reference: Column) -> Column:
    """Precision, recall and F1 of the token multisets; two empty texts agree."""

    def score(t: Column) -> Column:
        overlap = F.size(F.array_intersect(occurrence_tags(t["p"]), occurrence_tags(t["r"])))
        both_empty = (F.size(t["p"]) == 0) & (F.size(t["r"]) == 0)
        one = F.lit(1.0)
        return F.when(
            both_empty, F.struct(one.alias("precision"), one.alias("recall"), one.alias("f1"))
        ).otherwise(
            _f_measure(
                F.struct(
                    overlap.alias("overlap"),
                    F.size(t["p"]).alias("n_pred"),
                    F.size(t["r"]).alias("n_ref"),
                )
            )
        )

    return tx.let(
        F.struct(answer_tokens(prediction).alias("p"), answer_tokens(reference).alias("r")), score
    )


def token_f1(prediction: Column, reference: Column) -> Column:
    return token_overlap(prediction, reference)["f1"]


def _lcs(a: list[str], b: list[str]) -> int:
    """Longest common subsequence, one bit per token of the shorter side."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    where: dict[str, int] = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    open_bits = full
    for token in b:
        if token in where:
            hit = open_bits & where[token]
            open_bits = ((open_bits + hit) | (open_bits ^ hit)) & full
    return len(a) - open_bits.bit_count()


_LCS_TYPE = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("overlap", "n_pred", "n_ref")]
)


@F.pandas_udf(_LCS_TYPE)
def lcs_counts(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    """LCS length and token counts of two space-joined token texts; null counts as empty."""
    rows = []
    for p, r in zip(pred, ref):
        a, b = (p or "").split(), (r or "").split()
        rows.append((_lcs(a, b), len(a), len(b)))
    return pd.DataFrame(rows, columns=["overlap", "n_pred", "n_ref"], dtype="int64")


def rouge_l(prediction: Column, reference: Column, needed: Column | None = None) -> Column:
    """F-measure of the longest common subsequence, zero if either text is empty.

    Rows where ``needed`` is false send no text to the Python worker and give null.
    """
    ship_package(SparkSession.active())
    p, r = norm_answer(prediction), norm_answer(reference)
    if needed is None:
        return _f_measure(lcs_counts(p, r))["f1"]
    counts = lcs_counts(F.when(needed, p), F.when(needed, r))
    return F.when(needed, _f_measure(counts)["f1"])


def _bare_numbers(col: Column) -> Column:
    """The distinct figures of a text, lower-cased and without signs and separators.

    All matches are cleaned as one text, so no expression is evaluated per element.
    """
    text = F.lower(tx.text_or_empty(col))
    patterns = ((C.MONEY, False), (C.PERCENT, False), (C.MAGNITUDE, True), (C.BARE_NUMBER, False))
    found = F.array_join(F.concat(*[tx.find_all(text, p, any_case) for p, any_case in patterns]), "|")
    return F.array_remove(F.array_distinct(F.split(F.translate(found, "$, ", ""), r"\|")), "")


def numeric_match(prediction: Column, reference: Column) -> Column:
    """Exact match, precision and recall of the two sets of figures."""
    p, r = _bare_numbers(prediction), _bare_numbers(reference)
    n_pred, n_ref, common = F.size(p), F.size(r), F.size(F.array_intersect(p, r))
    return F.struct(
        ((common == n_pred) & (common == n_ref)).cast("double").alias("numeric_exact_match"),
        F.when(n_pred > 0, common / F.greatest(n_pred, F.lit(1)))
        .when(n_ref == 0, 1.0)
        .otherwise(0.0)
        .alias("numeric_precision"),
        F.when(n_ref > 0, common / F.greatest(n_ref, F.lit(1)))
        .otherwise(1.0)
        .alias("numeric_recall"),
    )


def _label_in_json(stripped: Column) -> Column:
    """Label of a JSON object with ``label`` or ``supported``; null otherwise."""
    doc = F.try_parse_json(stripped)
    is_object = F.schema_of_variant(doc).startswith("OBJECT")
    label = F.try_variant_get(doc, "$.label", "variant")
    supported = F.try_variant_get(doc, "$.supported", "variant")
    kind = F.schema_of_variant(supported)
    plain = F.to_json(supported)
    truthy = (
        F.when(kind == "VOID", F.lit(False))
        .when(kind == "BOOLEAN", plain == "true")
        .when(kind == "STRING", plain != '""')
        .when(kind.startswith("ARRAY"), plain != "[]")
        .when(kind.startswith("OBJECT"), plain != "{}")
        .otherwise(F.try_variant_get(supported, "$", "double") != 0.0)
    )
    label_text = F.when(F.is_variant_null(label), F.lit("None")).otherwise(
        F.try_variant_get(label, "$", "string")
    )
    return F.when(
        is_object,
        F.when(label.isNotNull(), F.lower(tx.strip(label_text))).when(
            supported.isNotNull(), F.when(truthy, F.lit("supported")).otherwise("unsupported")
        ),
    )


def _label_in_words(low: Column) -> Column:
    def position(word: str) -> Column:
        return F.nullif(F.instr(low, word), F.lit(0))

    first = F.least(position("positive"), position("neutral"), position("negative"))
    return (
        F.when(F.contains(low, F.lit("unsupported")), "unsupported")
        .when(F.contains(low, F.lit("not supported")), "unsupported")
        .when(F.contains(low, F.lit("supported")), "supported")
        .when(first == position("positive"), "positive")
        .when(first == position("neutral"), "neutral")
        .when(first == position("negative"), "negative")
        .otherwise("unknown")
    )


def parse_label(col: Column) -> Column:
    """Label from a JSON object if there is one, else from the wording."""

    def parse(stripped: Column) -> Column:
        # only text that starts like an object can be one: other text skips the JSON parser
        from_object = F.when(stripped.startswith("{"), _label_in_json(stripped))
        return F.coalesce(from_object, tx.let(F.lower(stripped), _label_in_words))

    return tx.let(tx.strip(tx.text_or_empty(col)), parse)


def classification_accuracy(prediction: Column, reference: Column) -> Column:
    return tx.let(
        F.struct(parse_label(prediction).alias("p"), parse_label(reference).alias("r")),
        lambda t: ((t["p"] == t["r"]) & (t["p"] != "unknown")).cast("double"),
    )


def lexical_faithfulness(prediction: Column, source: Column) -> Column:
    """Share of distinct content words of the prediction that occur in the source."""
    stop = F.array(*[F.lit(w) for w in C.STOPWORDS])
    found = tx.words(without_punctuation(source))
    return tx.let(
        F.array_except(tx.words(without_punctuation(prediction)), stop),
        lambda content: F.when(F.size(content) == 0, F.lit(1.0)).otherwise(
            F.size(F.array_intersect(content, found)) / F.greatest(F.size(content), F.lit(1))
        ),
    )


def scored_faithfulness(
    prediction: Column, source: Column, scorer: Callable[[Column, Column], Column]
) -> Column:
    """Score by a caller's ``scorer(premise, hypothesis)``, clamped to [0, 1].

    ``scorer`` returns a column, so it may be a plain expression or an Arrow
    UDF around a model. Blank predictions score 1.0; the scorer sees null for
    them and need not be called.
    """
    blank = tx.is_blank(prediction)
    raw = scorer(F.when(~blank, source), F.when(~blank, prediction))
    return F.when(blank, F.lit(1.0)).otherwise(
        F.least(F.greatest(raw.cast("double"), F.lit(0.0)), F.lit(1.0))
    )
