import random
import re

import pytest
from pyspark.sql import functions as F

from filingloom.functions import html as ht
from filingloom.functions import numbers as nb
from filingloom.functions import text as tx


@pytest.mark.parametrize(
    "text, expected",
    [
        ("  a\tb \n\n c  d \r\n", "a b\nc d"),
        ("a  b\n　\nx", "a b\nx"),
        ("", ""),
        (" \n\t ", ""),
    ],
)
def test_normalize_whitespace(one, text, expected):
    assert one(tx.normalize_whitespace, text) == expected


@pytest.mark.parametrize("text", ["", " ", "a", " a b ", "a b c", "x\n\ny\tz", "a\x1cb\x85c"])
def test_words_follow_unicode_whitespace(one, text):
    assert one(tx.words, text) == text.split()
    assert one(tx.word_count, text) == len(text.split())


def test_sentences_drop_short_parts(one):
    text = "One two three. No. Is this fine? Yes it is!  Last one here"
    assert one(tx.sentences, text) == [
        "One two three.", "Is this fine?", "Yes it is!", "Last one here",
    ]
    assert one(tx.sentences, "Short. Two words.") == []


def test_summary_falls_back_to_prefix_and_notice(one):
    assert one(tx.extractive_summary, "Tiny text") == "Tiny text"
    assert one(tx.extractive_summary, "   ") == "(no extractable content in excerpt)"
    long = "x" * 400
    assert one(tx.extractive_summary, long) == "x" * 300
    five = " ".join(f"Sentence number {w} here." for w in ("a", "b", "c", "d", "e"))
    assert one(tx.extractive_summary, five) == " ".join(five.split(". ")[0:4]).replace(
        "here Sentence", "here. Sentence"
    ) + "."


def test_metric_mentions_in_pattern_order(one):
    text = "Sales of $81,462 million rose 5.5% and 5.5 % or 25 basis points; $ 3.50 and 25 Basis Points"
    assert one(tx.metric_mentions, text) == [
        "$81,462", "$ 3.50", "5.5%", "5.5 %", "81,462 million", "25 basis points", "25 Basis Points",
    ]


def test_numeric_values_include_bare_numbers(one):
    assert one(tx.numeric_values, "v2 has 10 of 1,000 items at 3% for $5") == ["$5", "3%", "10", "1,000", "3", "5"]


def test_keyword_sentences_match_substrings_and_stop_at_five(one):
    text = " ".join(f"The marketing item {i} grew." for i in range(7))
    found = one(lambda c: tx.keyword_sentences(tx.sentences(c), ["market"]), text)
    assert found == [f"The marketing item {i} grew." for i in range(5)]


def test_term_count_is_non_overlapping(one):
    assert one(lambda c: tx.term_count(c, ["aa", "b"]), "aaaa b") == 3
    assert one(lambda c: tx.term_count(c, ["aa", "b"]), "aaaab aaa") == 4


def test_append_notice_once(one):
    add = lambda c: tx.append_notice(c, "NOTE.")
    assert one(add, "Answer. NOTE.  \nNOTE.\n") == "Answer.\n\nNOTE."
    assert one(add, "NOTE.NOTE.") == "NOTE."


def test_truncation(one):
    assert one(lambda c: tx.truncate_ellipsis(c, 5), "abcdefgh") == "abcd…"
    assert one(lambda c: tx.truncate_ellipsis(c, 5), "abc  defgh") == "abc…"
    assert one(lambda c: tx.truncate_ellipsis(c, 5), None) == "N/A"
    assert one(lambda c: tx.truncate_line(c, 5), "ab\ncdef") == "ab cd…"


def test_rounding_is_exact_on_the_binary_value(spark):
    rng = random.Random(7)
    values = [0.125, 2.675, 1.005, 0.5, 1.5, -0.125, -2.675, 0.0, 1e-9, -1e-9, 1e17, 2.5e-5, 0.00015]
    values += [rng.uniform(-10, 10) for _ in range(2000)]
    values += [rng.randrange(-99999, 99999) / 100000 for _ in range(3000)]
    values += [rng.randrange(-9999, 9999) / 8 for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", *[nb.round_half_even(F.col("v"), d).alias(f"r{d}") for d in (0, 2, 4)]).collect()
    for row in got:
        for d in (0, 2, 4):
            assert row[f"r{d}"] == round(row["v"], d), (row["v"], d)


def test_rounding_keeps_values_that_are_not_numbers(one):
    assert one(lambda c: nb.round_half_even(c, 2), float("inf")) == float("inf")
    assert one(lambda c: nb.round_half_even(c, 2), float("nan")) != 0.0
    assert one(lambda c: nb.round_half_even(c.cast("double"), 2), None) is None
    assert one(nb.finite_or_zero, "nan") == 0.0
    assert one(nb.finite_or_zero, "abc") == 0.0
    assert one(nb.finite_or_zero, "1.5") == 1.5


def test_exact_mean_of_odd_values(spark):
    def mean(*values):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        return df.agg(nb.exact_mean(F.col("v"))).first()[0]

    assert mean(0.1, 0.2, 0.3, None) == pytest.approx(0.2, abs=1e-15)
    assert mean(1e20, 3e20) == 2e20
    assert mean(1.0, float("inf")) == float("inf")
    assert mean(None) is None


@pytest.mark.parametrize("v", [0.0625, 0.1235, -0.00001, 1.0, 2.0005, 123456.7895, -0.5])
def test_formatting_matches_c_style(one, v):
    assert one(nb.format_fixed, v) == f"{v:.3f}"
    sign = "+" if v >= 0 else ""
    assert one(nb.format_signed, v) == f"{sign}{v:.3f}"


def test_formatting_of_unusable_values(one):
    assert one(nb.format_fixed, float("nan")) == "N/A"
    assert one(lambda c: nb.format_signed(c.cast("double")), None) == "N/A"


PAGE = """<html><head><style>p{x}</style><script>var a="</p>";</script></head>
<body><!-- gone --><h2>Item&nbsp;1.  Business</h2><p>We sell   <b>R&amp;D</b> &#8212; &#x41; &copy; &unknown;
<p>next</body></html>"""


@pytest.mark.parametrize("form", [ht.html_to_text, ht.html_to_text_parsed])
def test_html_to_text(one, form):
    assert one(form, PAGE) == "Item 1. Business\nWe sell\nR&D\n— A © &unknown;\nnext"


@pytest.mark.parametrize("form", [ht.html_to_text, ht.html_to_text_parsed])
def test_html_with_open_ends(one, form):
    assert one(form, '<p title="a>b">kept</p>R&amp D<script>var x = "<b>never closed";') == "kept\nR&amp D"


def test_html_of_nothing(one):
    assert one(ht.html_to_text, None) == ""
    assert one(ht.html_to_text, "plain < text & more") == "plain < text & more"


def test_json_text_round_trip(one):
    import json

    for text in ('a "quoted" \\ back', "line\nbreak\ttab"):
        assert json.loads(one(tx.json_text, text)) == text
    assert re.match('^"', one(tx.json_text, ""))


@pytest.mark.parametrize("form", [ht.html_to_text, ht.html_to_text_parsed])
def test_numeric_references_with_leading_zeros(one, form):
    assert one(form, "&#00000065;&#x00000042; &#x1F600;") == "AB \U0001f600"


def test_sentences_need_their_words_whatever_stands_between(one):
    text = "One.  Two words. Now three\t words! A b  c d. 　 . x y?"
    assert [len(one(lambda c, k=k: tx.sentences(c, k), text)) for k in (0, 1, 2, 3, 4, 5)] == [6, 6, 4, 2, 1, 0]
    assert one(tx.normalize_whitespace, " a \t b c  d e \t\n\n \t \nf  ") == "a b c d e\nf"


@pytest.mark.parametrize("name", ["rouge_l_subsequence", "extractive_baseline_answer"])
def test_heavy_rows_of_one_row_group_are_dealt_over_tasks(spark, tmp_path, name):
    from filingloom.plans import catalog

    text = F.concat(F.lit("Sales grew again by 5%. Costs of unit "), F.col("id").cast("string"), F.lit(" fell."))
    docs = spark.range(200).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.length(text).cast("long").alias("n_chars"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES[name](spark, str(tmp_path))
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
