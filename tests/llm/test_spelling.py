import random
import zlib
from collections import Counter

import numpy as np
import pytest

from filingloom.llm import queries, spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(counts, ratio=10):
    out = {}
    for word, n in counts.items():
        close = [w for w in counts if abs(len(w) - len(word)) <= 1 and one_edit(word, w)]
        best = min(close, key=lambda w: (-counts[w], w), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[word] = [form, None, n, len(close), counts[form] if form else None]
    for word in counts:
        root = word
        while out[root][0] is not None:
            root = out[root][0]
        out[word][1] = root
    return {w: tuple(v) for w, v in out.items()}


def vocabulary(seed, roots, letters="abcé"):
    rnd = random.Random(seed)
    counts = {}
    for _ in range(roots):
        word = "".join(rnd.choice(letters) for _ in range(rnd.randint(7, 12)))
        for k in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(word))
            c = rnd.choice(letters)
            new = rnd.choice([word[:at] + word[at + 1 :], word[:at] + c + word[at:], word[:at] + c + word[at + 1 :]])
            if len(new) >= 7:
                counts[new] = rnd.choice([2, 3, 40, 500])
            word = rnd.choice([word, new]) if len(new) >= 7 else word
        counts[word] = rnd.choice([2, 25, 25, 300, 4000])
    return counts


def result(spark, counts, **options):
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    rows = spelling.spelling_variants(words, **options).collect()
    assert len(rows) == len(counts)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("seed, shard_chars", [(1, 400_000), (2, 700), (3, 40)])
def test_variants_equal_brute_force(spark, seed, shard_chars):
    counts = vocabulary(seed, 150)
    assert result(spark, counts, shard_chars=shard_chars) == plain_variants(counts)


def test_one_family_in_many_blocks(spark):
    rnd = random.Random(4)
    counts = {"prefix" + "".join(rnd.choice("ab") for _ in range(rnd.randint(6, 9))): rnd.choice([2, 30, 700]) for _ in range(200)}
    assert result(spark, counts, shard_chars=300) == plain_variants(counts)
    assert result(spark, counts, ratio=2) == plain_variants(counts, 2)


def test_long_words_and_chains(spark):
    long = "ab" * 3000
    chain = {f"{'x' * k}{'y' * (12 - k)}": 3 * 10**k for k in range(12)}
    counts = {long: 20, long + "c": 2, "z" * 5000: 7, "z" * 5001: 70, **chain}
    got = result(spark, counts)
    assert got == plain_variants(counts)
    assert got["y" * 12][1] == "x" * 11 + "y"


def test_index_steps_are_suffix_ranks():
    rnd = random.Random(8)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 6))) for _ in range(30)})
    sizes = np.array([len(w) for w in words])
    index = spelling.Index(np.array([ord(c) - 96 for w in words for c in w]), sizes, 2)
    for pattern in {w[k:] for w in words for k in range(len(w))}:
        low, high = np.array([0]), np.array([index.block[1]])
        for c in pattern[::-1]:
            symbol = np.array([ord(c) - 96])
            low, high = index.step(symbol, low), index.step(symbol, high)
        assert high[0] - low[0] == sum(w.endswith(pattern) for w in words)
        low, high = index.step(np.array([0]), low), index.step(np.array([0]), high)
        assert [words[j] for j in range(low[0], high[0])] == [w for w in words if w == pattern]


def plain_counts(rows, rewrite=None, least=7, often=2):
    out = Counter()
    for i, text in rows:
        word, found = "", []
        for c in (text or "") + " ":
            c = c.lower() if "A" <= c <= "Z" else c
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                word += c
            elif word:
                found.append(word)
                word = ""
        for run in found:
            h = zlib.crc32(f"{i}:{run}".encode())
            if rewrite and i is not None and h % rewrite == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= least and n >= often}


def test_word_counts_of_rows_in_every_odd_form(awkward):
    rows = [tuple(r) for r in awkward.select("doc_id", "text").collect()]
    got = {r["word"]: r["n"] for r in spelling.word_counts(awkward, min_length=3).collect()}
    assert got == plain_counts(rows, None, 3)
    some = {r["word"]: r["n"] for r in spelling.word_counts(awkward, min_length=3, min_count=1, rewrite=spelling.Drops(2)).collect()}
    assert some == plain_counts(rows, 2, 3, 1)


def test_repeated_null_and_short_words(spark):
    rows = [("example", 5), ("example", None), ("examples", 70), ("examples", 30), (None, 3), ("short", 9), ("exampled", None)]
    got = spelling.spelling_variants(spark.createDataFrame(rows, "word string, n long")).collect()
    assert {r["word"]: (r["form"], r["n"], r["n_near"]) for r in got} == {
        "example": ("examples", 5, 2),
        "examples": (None, 100, 2),
        "exampled": ("examples", 0, 2),
    }


def test_empty_tables(nothing, spark):
    words = spelling.word_counts(nothing)
    assert words.collect() == []
    assert spelling.spelling_variants(words).collect() == []
    with pytest.raises(ValueError):
        spelling.spelling_variants(words, ratio=1)


def test_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(9)
    words = [w for w, n in vocabulary(10, 40).items()] + ["Déjàvues", "a", "it's"]
    rows = [(i, " ".join(rnd.choices(words, k=60)).title() if i % 3 else " ".join(rnd.choices(words[:9], k=200))) for i in range(60)]
    rows += [(99, None), (100, "")]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = queries.QUERIES["op11_spelling_variants"](spark, path).collect()
    counts = plain_counts(rows, 31)
    want = plain_variants(counts)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want
    assert sum(v[0] is not None for v in want.values()) > 5
