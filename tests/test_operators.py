import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from filingloom import constants as C
from filingloom.functions import banks, models
from filingloom.functions import labels as lb
from filingloom.functions import scores as sc
from filingloom.functions import text as tx
from filingloom.operators import audit, chunks, examples, ranking, safety, sections, splits

WORDS = [f"w{i}" for i in range(30)]


# ---- chunks ----------------------------------------------------------------


@pytest.mark.parametrize("size, overlap, least", [(10, 3, 4), (10, 0, 10), (5, 4, 0), (4, 1, 9), (512, 64, 80)])
def test_chunks_cover_texts_with_the_overlap(spark, size, overlap, least):
    texts = [(n, " ".join(f"t{i}" for i in range(n))) for n in (0, 1, 3, 4, 9, 10, 11, 14, 17, 60, 115, 600)]
    df = spark.createDataFrame(texts, "n int, text string")
    got = {n: [] for n, _ in texts}
    for r in chunks.chunk_windows(df, "text", ["n"], size, overlap, least).collect():
        got[r.n].append(r)
    assert got[0] == []
    for n, text in texts[1:]:
        rows = sorted(got[n], key=lambda r: r.chunk_id)
        assert [r.chunk_id for r in rows] == list(range(len(rows)))
        starts, ends = [r.start_token for r in rows], [r.end_token for r in rows]
        assert starts == [k * (size - overlap) for k in range(len(rows))]
        assert all(e == min(s + size, n) for s, e in zip(starts, ends))
        for r in rows:
            assert r.token_count == r.end_token - r.start_token
            assert r.text == " ".join(text.split()[r.start_token : r.end_token])
        # only a last window may be missing, and only if it is shorter than asked for
        after = starts[-1] + size - overlap
        assert ends[-1] == n or (n - after < least and after + size >= n) or all(min(size, n - s) < least for s in starts)
        assert len(rows) == 1 or all(r.token_count >= least for r in rows)


@pytest.mark.parametrize(
    "n, size, overlap, least, spans",
    [
        (10, 10, 3, 4, [(0, 10)]),
        (11, 10, 3, 4, [(0, 10), (7, 11)]),
        (11, 10, 3, 5, [(0, 10)]),
        (17, 10, 3, 4, [(0, 10), (7, 17)]),
        (3, 10, 3, 4, [(0, 3)]),
        (9, 4, 1, 9, [(0, 4)]),
    ],
)
def test_chunk_spans_by_hand(spark, n, size, overlap, least, spans):
    df = spark.createDataFrame([(" ".join(["t"] * n),)], "text string")
    rows = chunks.chunk_windows(df, "text", [], size, overlap, least).collect()
    assert sorted((r.start_token, r.end_token) for r in rows) == spans


@pytest.mark.parametrize("bad", [(0, 0, 0), (5, 5, 0), (5, -1, 0), (5, 1, -1)])
def test_chunk_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        chunks.check_window(*bad)


# ---- sections --------------------------------------------------------------


def spelled(rng, item):
    """A heading of an item in one of the ways it is written."""
    number, letter = item.rstrip("ab"), item[len(item.rstrip("ab")) :]
    mark = rng.choice(["Item", "ITEM", "item"]) + rng.choice([" ", "  ", "\n"]) + number
    return mark + (rng.choice(["", " "]) + rng.choice([letter, letter.upper()]) if letter else "") + rng.choice([".", ":", " -"])


def filing(rng):
    """A text put together from headed parts: its headings in order, and the body that each section must be.

    Every item is listed once, with a title; some have a long part of their own, which may
    go on behind a repeated heading. Neighbouring parts differ in their item otherwise.
    """
    names = {item: name for name, item in C.SECTION_ITEMS.items()}
    text, headings, bodies, n = rng.choice(["", "Cover page. ", "itemized 7 things "]), [], {}, 0

    def part(item, words):
        nonlocal text
        headings.append((item, len(text)))
        text += f"{spelled(rng, item)} {words}"

    def filler(count):
        nonlocal n
        n += count
        return " ".join(rng.choice([f"word{k}", f"items{k}", f"items {k},"]) for k in range(n - count, n)) + rng.choice([" ", "\n", ".\n"])

    for item in [*names, "12b", "3"]:
        begin = len(text)
        part(item, filler(3))
        bodies[item] = text[begin:].strip()
    for item in rng.sample([*names], rng.randint(0, 5)):
        part("9", filler(2))
        begin = len(text)
        part(item, filler(rng.randint(30, 60)))
        if rng.random() < 0.4:
            part(item, filler(rng.randint(1, 20)))
        bodies[item] = text[begin:].strip()
    return text, headings, {names[item]: body for item, body in bodies.items() if item in names}


def test_sections_of_texts_put_together_from_known_parts(spark):
    rng = random.Random(3)
    built = {i: filing(rng) for i in range(150)}
    df = spark.createDataFrame([(i, text) for i, (text, _, _) in built.items()], "id int, text string")
    got, anchors = {}, {}
    for r in sections.section_spans(df, ["id"], "text").collect():
        got.setdefault(r.id, {})[r.section] = r.text
    for r in sections.heading_anchors(df, ["id"], "text").collect():
        anchors.setdefault(r.id, []).append((r.pos, r.item_id, r.offset))
    for i, (text, headings, bodies) in built.items():
        assert got[i] == bodies, text
        assert sorted(anchors[i]) == [(n, item, at) for n, (item, at) in enumerate(headings)], text


def test_texts_without_headings_have_no_sections(spark):
    df = spark.createDataFrame([(1, "itemized 7 things"), (2, ""), (3, None), (4, "Item one")], "id int, text string")
    assert sections.section_spans(df, ["id"], "text").isEmpty()
    assert sections.heading_anchors(df, ["id"], "text").isEmpty()


def test_of_equally_long_bodies_the_first_counts(spark):
    df = spark.createDataFrame([("Item 7. aaaa Item 9. x Item 7. bbbb",)], "text string")
    assert sections.section_spans(df, [], "text").first().text == "Item 7. aaaa"


# ---- examples --------------------------------------------------------------

META = (
    "'AAPL' ticker, '0000320193' cik, '10-K/A' form, 'mda' section, '2022-10-28' filing_date, "
    "'' report_date, '0000320193-22-000108' accession_number, 'u' source_url"
)


def test_example_identity_and_source(spark):
    df = examples.filing_metadata(spark.sql(f"SELECT {META}"))
    row = df.select(
        examples.example_id(F.col("metadata"), F.lit(0), F.lit("filing_qa")).alias("id"),
        examples.source_label(F.col("metadata")).alias("source"),
    ).first()
    assert row.id == "AAPL-2022-10-K-A-000108-mda-0-filing_qa"
    assert row.source == "AAPL 2022 10-K/A mda"


def test_example_identity_without_company_and_year(spark):
    df = spark.sql("SELECT '' ticker, null cik, '10-K' form, 'mda' section, '' filing_date, null report_date, '' accession_number, '' source_url")
    row = examples.filing_metadata(df).select(
        examples.example_id(F.col("metadata"), F.lit(3), F.lit("filing_qa")).alias("id")
    ).first()
    assert row.id == "UNK-XXXX-10-K-mda-3-filing_qa"


def test_unknown_task_type_raises(spark):
    with pytest.raises(Exception, match="Unknown task_type"):
        spark.sql("SELECT 'dance' t").select(examples.check_task_type(F.col("t"))).collect()


def test_examples_for_unknown_sections_and_blank_texts_are_none(spark):
    df = spark.sql(f"SELECT {META.replace(chr(39) + 'mda', chr(39) + 'exhibits')}, 'some text here' text UNION ALL SELECT {META}, '  ' text")
    assert examples.build_examples(df).count() == 0


def test_build_has_one_row_per_task_and_even_odd_claims(spark):
    text = " ".join(f"Sentence {i} has risk words." for i in range(30))
    df = spark.sql(f"SELECT {META.replace('mda', 'risk_factors')}").withColumn("text", F.lit(text))
    rows = examples.build_examples(df, max_tokens=50, overlap=0, min_tokens=1).collect()
    tasks = Counter(r.task_type for r in rows)
    assert set(tasks) == set(C.SECTION_TASKS["risk_factors"]) and len(set(tasks.values())) == 1
    claims = {r.chunk_id: r for r in rows if r.task_type == "hallucination_detection"}
    assert claims[0].output.startswith('{"supported": true')
    assert claims[0].input.endswith("Proposed answer: Sentence 0 has risk words.")
    assert claims[1].output.startswith('{"supported": false')
    assert claims[1].input.endswith(C.FALSE_CLAIM)
    assert rows[0].metadata.generation_method == "template_extractive"


def test_claim_polarity_of_other_identifiers(one):
    drawn = lambda c: lb.claim_is_drawn(c, F.array(F.lit("s")))
    assert one(drawn, "abc") is True
    assert one(drawn, "-3") is False
    assert one(drawn, "4") is True


def test_outlook_label(one):
    import json

    got = json.loads(one(lb.outlook_label, "Strong growth, growth and risk."))
    assert got["label"] == "positive" and "Found 3 positive and 1 negative" in got["reason"]
    assert json.loads(one(lb.outlook_label, "nothing"))["label"] == "neutral"
    assert json.loads(one(lb.outlook_label, "a loss"))["label"] == "negative"


def test_baseline_answers(one):
    text = "Up 5% to $3,000 on 7 units. Second one is here. Third. Fourth."
    ask = lambda task, ext=False: one(lambda c: lb.baseline_answer(F.lit(task), c, ext), text)
    assert ask("metric_extraction") == "Reported metrics: 5%, $3,000, 7."
    assert ask("filing_qa") == "Up 5% to $3,000 on 7 units. Second one is here."
    assert ask("filing_qa", True) == "Up 5% to $3,000 on 7 units. Second one is here. Third."
    assert ask("outlook_classification") == C.BASELINE_OUTLOOK
    assert ask("hallucination_detection") == C.BASELINE_UNSUPPORTED
    assert one(lambda c: lb.baseline_answer(F.lit("x"), c), " ") == C.BASELINE_EMPTY


def test_clean_prediction(one):
    raw = "<s>[INST] Hello [/INST]\n\n  world <|im_end|>\nBot-1 is not a licensed financial advisor. Really.\nend</s>"
    assert one(lb.clean_prediction, raw) == "Hello\nworld\nend"


# ---- scores ----------------------------------------------------------------


def plain_tokens(text):
    import re
    import string

    bare = text.lower().translate(str.maketrans("", "", string.punctuation))
    return re.sub(r"\b(a|an|the)\b", " ", bare).split()


def plain_f1(p, r):
    p, r = plain_tokens(p), plain_tokens(r)
    if not p and not r:
        return 1.0
    same = sum((Counter(p) & Counter(r)).values())
    if not same:
        return 0.0
    return 2 * (same / len(p)) * (same / len(r)) / (same / len(p) + same / len(r))


def plain_rouge(p, r):
    p, r = plain_tokens(p), plain_tokens(r)
    table = [[0] * (len(r) + 1) for _ in range(len(p) + 1)]
    for i, x in enumerate(p):
        for j, y in enumerate(r):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    n = table[-1][-1]
    return 2 * (n / len(p)) * (n / len(r)) / (n / len(p) + n / len(r)) if n else 0.0


def test_overlap_scores_equal_plain_loops(spark):
    rng = random.Random(11)
    vocab = ["the", "a", "Alpha", "beta,", "é", "it's", "x", "y", "z", "An", "—a—", "l’a"]
    pairs = [
        (i, " ".join(rng.choices(vocab, k=rng.randrange(0, 30))), " ".join(rng.choices(vocab, k=rng.randrange(0, 30))))
        for i in range(300)
    ]
    df = spark.createDataFrame(pairs, "id int, p string, r string")
    p, r = F.col("p"), F.col("r")
    rows = df.select("id", sc.token_f1(p, r).alias("f"), sc.rouge_l(p, r).alias("l"), sc.norm_answer(p).alias("n")).collect()
    for row in rows:
        _, a, b = pairs[row.id]
        assert row.n == " ".join(plain_tokens(a))
        assert row.f == pytest.approx(plain_f1(a, b), abs=1e-15)
        assert row.l == pytest.approx(plain_rouge(a, b), abs=1e-15)


def test_empty_texts_differ_between_scores(one):
    assert one(sc.token_f1, "", "the") == 1.0
    assert one(sc.rouge_l, "", "the") == 0.0
    assert one(sc.token_f1, "", "x") == 0.0


@pytest.mark.parametrize(
    "p, r, want",
    [
        ("no figures", "none", (1.0, 1.0, 1.0)),
        ("none", "5%", (0.0, 0.0, 0.0)),
        ("5%", "none", (0.0, 0.0, 1.0)),
        ("$1,000", "1000", (0.0, 1.0, 1.0)),
    ],
)
def test_numeric_match(one, p, r, want):
    got = one(sc.numeric_match, p, r)
    if p == "$1,000":
        # "$1,000" also gives the bare number 1,000: both normalise to 1000
        want = (1.0, 1.0, 1.0)
    assert (got.numeric_exact_match, got.numeric_precision, got.numeric_recall) == want


@pytest.mark.parametrize(
    "text, label",
    [
        ('{"label": " Positive "}', "positive"),
        ('{"supported": false}', "unsupported"),
        ('{"supported": "false"}', "supported"),
        ('{"supported": ""}', "unsupported"),
        ('{"supported": []}', "unsupported"),
        ('{"supported": [0]}', "supported"),
        ('{"supported": 0.0}', "unsupported"),
        ('{"supported": null}', "unsupported"),
        ('{"label": null}', "none"),
        ('{"other": 1} negative', "negative"),
        ("It is not supported", "unsupported"),
        ("neutral, maybe positive", "neutral"),
        ('["positive"]', "positive"),
        ("", "unknown"),
    ],
)
def test_parse_label(one, text, label):
    assert one(sc.parse_label, text) == label


def test_accuracy_needs_known_labels(one):
    assert one(sc.classification_accuracy, "hmm", "hmm") == 0.0
    assert one(sc.classification_accuracy, "positive", '{"label": "positive"}') == 1.0


def test_faithfulness(one):
    assert one(sc.lexical_faithfulness, "the of", "x") == 1.0
    assert one(sc.lexical_faithfulness, "Revenue grew, fast", "revenue grew slowly") == pytest.approx(2 / 3)
    clamp = lambda p, s: sc.scored_faithfulness(p, s, lambda a, b: F.lit(7.0))
    assert one(clamp, "x", "y") == 1.0
    assert one(clamp, " ", "y") == 1.0


# ---- ranking ---------------------------------------------------------------


@pytest.mark.parametrize("small", [1, 50, 100_000])
def test_rank_values_equal_sorting(spark, small):
    rng = random.Random(5)
    rows = [("hot", rng.choice([1.0, 2.0, rng.random() * 1e6])) for _ in range(3000)]
    rows += [("tail", x) for x in [0.1, 0.2, 0.3, 1e9, 1e18, 1e300]]
    inf = float("inf")
    rows += [("odd", x) for x in [inf, inf, 5e-324, 0.0, -inf, 1.7e308, inf]]
    rows += [("one", 4.5), ("same", 1.0), ("same", 1.0), ("neg", -1e300), ("neg", 1e300)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {(k, r) for k, n in Counter(k for k, _ in rows).items() for r in {1, n, (n + 1) // 2, max(1, n - 7)}}
    ranks = spark.createDataFrame(sorted(want), "k string, rank long")
    got = ranking.rank_values(df, ["k"], "v", ranks, small=small, cells=64).collect()
    assert len(got) == len(want)
    for r in got:
        ordered = sorted(v for k, v in rows if k == r.k)
        assert r.value == ordered[r["rank"] - 1]
        assert r.below == sum(v < r.value for v in ordered)


def test_ordered_index_equals_row_number(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), ((F.col("id") * 37) % 101).alias("v"), "id")
    got = ranking.ordered_index(df, ["k"], [F.col("v"), F.col("id")], F.floor(F.col("v") / 10), "rn", "n")
    rows = got.collect()
    for k in range(3):
        mine = sorted((r for r in rows if r.k == k), key=lambda r: (r.v, r.id))
        assert [r.rn for r in mine] == list(range(1, len(mine) + 1))
        assert {r.n for r in mine} == {len(mine)}


def test_newest_per_group_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    out = ranking.newest_per_group(df, ["k"], [F.col("id").desc()], 3)
    assert sorted(r.id for r in out.collect()) == [994, 995, 996, 997, 998, 999]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_large_limits_are_salted(spark):
    df = spark.range(6000).select((F.col("id") % 2).alias("k"), "id")
    out = ranking.newest_per_group(df, ["k"], [F.col("id").desc()], 1500)
    rows = out.collect()
    assert len(rows) == 3000 and min(r.id for r in rows) == 3000


# ---- splits ----------------------------------------------------------------


@pytest.mark.parametrize("ratios", [(0.10, 0.05), (0.5, 0.5), (0.0, 0.9), (0.25, 0.25)])
def test_allocation_leaves_train_and_fills_the_rest(spark, ratios):
    df = spark.range(0, 70).select("id")
    test, validation = splits.allocation(F.col("id"), *ratios)
    for n, t, v in df.select("id", test, validation).collect():
        if n <= 1:
            assert (t, v) == (0, 0)
            continue
        # one each at least; with three groups or more one is left for training
        assert t >= 1 and v >= 1 and (t + v <= n - 1 or n == 2)
        wanted = max(1, round(n * ratios[1])), max(1, round(n * ratios[0]))
        if sum(wanted) <= n - 1:
            assert (t, v) == wanted
        else:
            # validation gives way first
            assert t + v == max(2, n - 1) and t <= wanted[0] and v <= wanted[1]
            assert v == 1 or t == wanted[0]


@pytest.mark.parametrize(
    "n, ratios, sizes",
    [(2, (0.1, 0.05), (1, 1)), (3, (0.1, 0.05), (1, 1)), (40, (0.1, 0.05), (2, 4)), (10, (0.5, 0.5), (5, 4)), (4, (0.0, 0.9), (2, 1))],
)
def test_allocation_by_hand(spark, n, ratios, sizes):
    test, validation = splits.allocation(F.lit(n).cast("long"), *ratios)
    assert tuple(spark.range(1).select(test, validation).first()) == sizes


def test_null_keys_get_a_split(spark):
    df = spark.createDataFrame([("A",), (None,), ("B",), (None,), ("C",)], "k string")
    rows = splits.split_examples(df, F.col("k")).collect()
    assert len(rows) == 5 and len({r.split for r in rows if r.k is None}) == 1


def test_ranks_of_whole_numbers_beyond_doubles(spark):
    big = 2**60
    df = spark.range(3000).select(F.lit(None).cast("string").alias("k"), (F.col("id") + big).alias("v"))
    wanted = spark.createDataFrame([(None, 1), (None, 1500), (None, 3000)], "k string, rank long")
    for small in (10, 10**6):
        got = ranking.rank_values(df, ["k"], "v", wanted, small=small, cells=16).collect()
        assert sorted((r.rank, r.value - big, r.below) for r in got) == [(1, 0, 0), (1500, 1499, 1499), (3000, 2999, 2999)]


def test_no_character_is_reserved_in_sections(spark):
    text = "Item 1. alpha\x01beta gamma Item 7. delta"
    df = spark.createDataFrame([(1, text)], "k int, text string")
    spans = {r.item: r.text for r in sections.section_spans(df, ["k"], "text", {"business": "1", "mda": "7"}).collect()}
    assert spans == {"1": "Item 1. alpha\x01beta gamma", "7": "Item 7. delta"}
    anchors = sections.heading_anchors(df, ["k"], "text").collect()
    assert [(r.pos, r.item_id, r.offset) for r in anchors] == [(0, "1", 0), (1, "7", text.index("Item 7"))]


def test_many_headings_take_time_in_proportion(spark):
    import time

    text = "".join(f"Item {i % 9 + 1}. words {i} " for i in range(32_000))
    df = spark.createDataFrame([(1, text)], "k int, text string")
    started = time.time()
    assert sections.section_spans(df, ["k"], "text", {"business": "1"}).count() == 1
    rows = sections.heading_anchors(df, ["k"], "text").collect()
    assert time.time() - started < 15
    assert len(rows) == 32_000 and all(text.startswith(f"Item {r.item_id}.", r.offset) for r in rows)


def test_two_groups(spark):
    df = spark.createDataFrame([("A",), ("B",), ("A",)], "k string")
    assert {r.split for r in splits.split_examples(df, F.col("k")).collect()} == {"test", "validation"}
    kept = splits.split_examples(df, F.col("k"), keep_train=True).collect()
    assert {r.split for r in kept} == {"test", "train"}


def test_company_split_does_not_leak_and_time_split_takes_newest(spark):
    rows = [(f"C{i % 25}", str(2000 + i % 12)) for i in range(600)]
    df = spark.createDataFrame(rows, "company string, year string")
    company = splits.split_examples(df, F.col("company"))
    assert splits.leakage_check(company, F.col("company")).first().passed
    assert company.count() == 600
    time = splits.split_examples(df, F.col("year"), "time_holdout")
    got = {r.year: r.split for r in time.collect()}
    assert got["2011"] == "test" and got["2010"] == "validation" and got["2009"] == "train"
    assert not splits.leakage_check(time, F.col("company")).first().passed
    assert splits.leakage_check(time, F.col("year")).first().passed
    with pytest.raises(ValueError):
        splits.split_examples(df, F.col("year"), "by_mood")


def test_stats_of_nothing(spark):
    empty = spark.createDataFrame([], "split string, task_type string, section string, input string, output string")
    rows = splits.dataset_stats(empty).collect()
    assert [(r.scope, r.examples, r.average_input_length) for r in rows] == [("total", 0, 0.0)]


# ---- audit -----------------------------------------------------------------

GOOD = '{"id": "x", "instruction": "i", "input": "a", "output": "b", "task_type": "filing_qa", "metadata": {}}'


@pytest.mark.parametrize(
    "line, errors",
    [
        (GOOD, []),
        (GOOD.replace('"id": "x", ', ""), ["missing field 'id'", "empty id"]),
        (GOOD.replace('"x"', "null"), ["null field 'id'"]),
        (GOOD.replace('"a"', '""'), ["empty input"]),
        (GOOD.replace("filing_qa", "poem"), ["invalid task_type 'poem'"]),
        (GOOD.replace("{}", "[]"), ["metadata is not an object"]),
        (GOOD.replace("{}", "null"), ["null field 'metadata'", "metadata is not an object"]),
        (GOOD.replace("{}}", '{}, "split": "dev"}'), ["invalid split 'dev'"]),
        (GOOD.replace("{}}", '{}, "split": null}'), []),
        (GOOD.replace('"i"', '"  "'), ["empty instruction"]),
        ("{", ["JSON parse error"]),
        ("[1]", ["example is not an object"]),
    ],
)
def test_example_errors(one, line, errors):
    assert one(audit.example_errors, line) == errors


def test_missing_file_passes_unless_strict(spark):
    rows = audit.validate_lines(spark.createDataFrame([("f", GOOD), ("f", " ")], "file string, line string"))
    expected = spark.createDataFrame([("f",), ("g",)], "file string")
    lax = {r.file: r for r in audit.file_report(rows, expected).collect()}
    assert lax["f"].total_examples == 1 and lax["f"].passed
    assert not lax["g"].found and lax["g"].passed
    strict = {r.file: r.passed for r in audit.file_report(rows, expected, strict=True).collect()}
    assert strict == {"f": True, "g": False}


def test_loss_history_keeps_last_seen(spark):
    rows = [("r", 1, 2.0, None), ("r", 2, None, 1.5), ("r", 3, 1.0, None), ("s", 1, float("nan"), None)]
    logs = spark.createDataFrame(rows, "run string, step int, loss double, eval_loss double")
    got = {r.run: r for r in audit.loss_history(logs).collect()}
    assert (got["r"].final_train_loss, got["r"].final_eval_loss, got["r"].has_bad_loss) == (1.0, 1.5, False)
    assert got["s"].has_bad_loss and got["s"].first_bad_step == 1


# ---- buckets, banks, models, markers ----------------------------------------


def test_ordered_buckets_give_exact_ranks(spark):
    rng = random.Random(4)
    rows = [(f"k{rng.randrange(4000):05d}",) for _ in range(3000)] + [(None,)]
    keys = spark.createDataFrame(rows, "k string").distinct()
    marked = ranking.with_ordered_buckets(keys, [F.col("k").desc()], "b", 7)
    assert marked.select("b").distinct().count() > 4
    ranked = ranking.ordered_index(marked, [], [F.col("k").desc()], F.col("b"))
    got = [r["k"] for r in ranked.orderBy("rn").collect()]
    assert got == [*sorted({k for (k,) in rows if k}, reverse=True), None]


def test_time_split_by_a_key_with_many_values(spark):
    rows = [(i, f"2020-{i:06d}") for i in range(1000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "id int, moment string")
    got = {r["id"]: r["split"] for r in splits.split_examples(df, F.col("moment"), "time_holdout").collect()}
    assert [got[i] for i in (999, 950, 949, 850, 849, 0)] == ["test", "test", "validation", "validation", "train", "train"]
    # no window of the plan takes all keys into one task
    plan = splits.assign_groups(df, "moment", "time_holdout")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan or "Scan parquet" in plan


@pytest.mark.parametrize("any_case", [True, False])
def test_bank_hits_equal_single_searches(spark, any_case):
    rng = random.Random(6)
    terms = sorted({"".join(rng.choice("abcÉ ") for _ in range(rng.randint(1, 4))) for _ in range(80)} | {"", "zz"})
    texts = [(i, "".join(rng.choice("abcABCéÉ ") for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(texts, "id int, text string")
    got = {r["id"]: r for r in banks.bank_hits(df, ["id"], "text", terms, any_case).collect()}
    for i, text in texts:
        body = (text or "").lower() if any_case else text or ""
        bank = {t.lower() if any_case else t for t in terms if t}
        found = sorted(t for t in bank if t in body)
        assert (i in got) == bool(found)
        if found:
            assert got[i]["terms"] == found
            assert got[i]["first_position"] == min(body.index(t) for t in found) + 1
            assert got[i]["n_hits"] == sum(body.startswith(t, k) for t in found for k in range(len(body)))


def test_banks_are_bounded(spark, monkeypatch):
    df = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("",)], "t string")
    assert banks.bank_of(df, "t") == ["a", "b"]
    assert banks.bank_hits(df, [], "t", []).isEmpty()
    monkeypatch.setattr(banks, "MAX_TERMS", 1)
    with pytest.raises(ValueError):
        banks.bank_of(df, "t")
    with pytest.raises(ValueError):
        banks.bank_hits(df, [], "t", ["a", "b"])


class Counted:
    """A model that tells how it was called."""

    def __init__(self):
        self.sizes = []

    def __call__(self, premises, hypotheses):
        self.sizes.append(sum(map(len, premises)) + sum(map(len, hypotheses)))
        return [float(len(h)) for h in hypotheses]


def test_models_see_bounded_slices_and_no_nulls():
    import pandas as pd

    model = Counted()
    premises = pd.Series(["p" * 30] * 10 + [None, "p"])
    hypotheses = pd.Series(["h" * k for k in range(10)] + ["h", None])
    got = models.score_pairs(model, premises, hypotheses, most=100)
    assert got[:10].tolist() == list(range(10)) and got[10:].tolist() != got[10:].tolist()
    assert len(model.sizes) == 3 and max(model.sizes) < 100 + 40
    assert models.score_pairs(model, pd.Series([None]), pd.Series(["x"]))[0] != 0


def test_a_model_file_reaches_the_workers(spark, tmp_path):
    path = tmp_path / "pair.json"
    path.write_text('{"bias": 0.25, "length": 0.0, "digits": 1.0, "quoted": 0.5}')
    df = spark.createDataFrame([(1, "it rose 5", "rose"), (2, "x", "5a"), (3, "x", " "), (4, None, "b")], "id int, source string, said string")
    score = sc.scored_faithfulness(F.col("said"), F.col("source"), models.model_scorer(spark, str(path)))
    got = {r["id"]: r["s"] for r in df.repartition(2).select("id", score.alias("s")).collect()}
    assert (got[1], got[2], got[3]) == (0.75, 0.75, 1.0)


def test_marker_rules(spark):
    rules = [
        safety.MarkerRule("either", texts=("Not Advice",), patterns=(r"(?m)^##? limits\b",)),
        safety.MarkerRule("loud", patterns=(r"\b[A-Z]{4,}\b",), any_case=False, required=False),
        safety.MarkerRule("flag", texts=("sample",), only_if="flagged"),
    ]
    rows = [
        (1, "this is NOT advice", False, []),
        (2, "x\n## Limits of it", True, ["flag"]),
        (3, "limits", None, ["either"]),
        (4, "not advice LOUD sample", True, ["loud"]),
        (5, None, True, ["either", "flag"]),
        (6, "  ", False, ["either"]),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "id int, text string, flagged boolean")
    got = {r["id"]: (r["broken_rules"], r["passed"]) for r in safety.marker_rules_audit(df, "text", rules).collect()}
    assert got == {i: (broken, not broken) for i, _, _, broken in rows}
    assert safety.marker_rules_audit(df, "text", []).where("passed").count() == 4
    with pytest.raises(ValueError):
        safety.marker_rules_audit(df, "text", [safety.MarkerRule("none")])
