import random

import numpy as np
import pytest

from filingloom.llm import language, quality

from .conftest import AWKWARD, wide

WORDS = {"aa": "ona tion the re".split(), "bb": "sch ung der ein".split(), "cc": "éau que les ç".split()}


def speak(rng, lang, n):
    return " ".join("".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def plain_phrases(text, sample):
    """Greedy longest phrases of ``text`` within ``sample``, in stretches."""
    n = 0
    for low in range(0, len(text), language.STRETCH):
        part, at = text[low : low + language.STRETCH], 0
        while at < len(part):
            size = 1
            while at + size < len(part) and part[at : at + size + 1] in sample:
                size += 1
            n, at = n + 1, at + size
    return n


def test_phrases_are_the_longest_matches():
    rng = random.Random(1)
    samples = language.Samples(tuple((k, speak(rng, k, 120)) for k in sorted(WORDS)))
    model = language.Model(samples)
    texts = [speak(rng, rng.choice(list(WORDS)), rng.randint(1, 300)) for _ in range(25)]
    symbols = [model.symbols(t) for t in texts]
    found = model._phrases(symbols)
    for row, own in zip(found, symbols):
        text = "".join(chr(200 + s) for s in own)
        for count, (_, sample) in zip(row, samples.texts):
            plain = "".join(chr(200 + s) for s in model.symbols(sample))
            assert count == plain_phrases(text, plain)


def test_held_out_languages(spark):
    rng = random.Random(2)
    rows = [(i, speak(rng, "aabbcc"[2 * (i % 3) :][:2], 40)) for i in range(150)]
    docs = spark.createDataFrame([(i, t, "aabbcc"[2 * (i % 3) :][:2]) for i, t in rows], "doc_id long, text string, lang string")
    samples = language.learn(docs.where("doc_id % 5 != 0"))
    found = language.identify(docs.where("doc_id % 5 = 0"), samples).collect()
    assert len(found) == 30
    assert all(r["lang_pred"] == "aabbcc"[2 * (r["doc_id"] % 3) :][:2] and 0 <= r["score"] <= 1 for r in found)


def test_copies_do_not_thin_out_a_language(spark):
    texts = [f"page {i} of the small language" for i in range(300)]
    rows = [(t, "small") for t in texts] + [("copied page", "small")] * 30_000 + [("the one text", "single")] * 5_000
    docs = spark.createDataFrame(rows, "text string, lang string")
    found = dict(language.learn(docs, train_chars=1_000_000).texts)
    assert found["single"] == "the one text"
    assert len(found["small"]) == len(" ".join([*texts, "copied page"]))
    some = dict(language.learn(docs, train_chars=1_000_000, train_docs=40).texts)
    assert some["single"] == "the one text"
    assert some["small"].count("page") == 40


def test_no_language(spark, awkward, nothing):
    samples = language.learn(awkward)
    found = {str(r["doc_id"]): (r["lang_pred"], r["score"]) for r in language.identify(awkward, samples).collect()}
    for key in ("3", "4", "5", "7"):
        assert found[key] == ("und", 0.0)
    assert found["8"][0] in ("en", "fr")
    kept = language.keep_identified(awkward, samples)
    assert kept.schema.names == awkward.schema.names
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "None", "6", "6", "8", "9", "10", "11"])
    assert language.learn(nothing) == language.Samples(())
    assert {r["lang_pred"] for r in language.identify(awkward, language.Samples(())).collect()} == {"und"}
    assert language.identify(nothing, samples).count() == 0
    assert language.keep_identified(nothing, samples).count() == 0


def junk(rng):
    words = speak(rng, "aa", 40).split()
    how = rng.randrange(3)
    if how == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if how == 1:
        return " | ".join(words)
    return (" ".join(words[:3]) + " ") * 20


def test_held_out_quality(spark):
    rng = random.Random(3)
    rows = [(i, junk(rng) if i % 4 == 0 else speak(rng, "aabbcc"[2 * (i % 3) :][:2], rng.randint(5, 80)) + ".") for i in range(600)]
    docs = wide(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i, _ in rows], "doc_id long, quality int")
    forest = quality.learn(docs, labels.where("doc_id % 5 != 0"))
    found = quality.score(docs, forest).collect()
    assert len(found) == 600 and all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["doc_id"] % 5 == 0]
    assert np.mean([(r["score"] >= 0.3) == (r["doc_id"] % 4 != 0) for r in held]) >= 0.97


def test_quality_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame(
        [(1, 1), (2, 1), (3, 0), (4, 0), (6, 1), (7, None), (None, 1), (99, 0), (10, 1), (10, 0)], "doc_id long, quality int"
    )
    forest = quality.learn(awkward, labels)
    found = quality.score(awkward, forest).collect()
    assert len(found) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in found)
    untaught = quality.learn(awkward, labels.where("false"))
    assert {r["score"] for r in quality.score(awkward, untaught).collect()} == {0.5}
    assert quality.score(nothing, forest).count() == 0


def test_flat_trees_equal_walking():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    forest = quality.train(x, y, trees=10, depth=3)
    for row, score in zip(x[:50], forest.score(x[:50])):
        total = forest.base
        for f, c, leaf in zip(forest.features, forest.cuts, forest.leaves):
            node = 0
            while node < 7:
                node = 2 * node + (2 if row[f[node]] > c[node] else 1)
            total += leaf[node - 7]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.9


def _alphabet_texts(seed, base, letters, words, n):
    rnd = random.Random(seed)
    known = ["".join(chr(base + rnd.randrange(letters)) for _ in range(rnd.randint(2, 5))) for _ in range(words)]
    return [" ".join(rnd.choices(known, k=60)) for _ in range(n)]


def test_ten_languages_of_thousands_of_letters():
    """Languages that share most of 3,000 letters each and differ in their words."""
    texts = {f"l{k}": _alphabet_texts(k, 0x4E00 + 300 * k, 3000, 6000, 130) for k in range(10)}
    samples = language.Samples(tuple((k, " ".join(v[:-3])) for k, v in texts.items()))
    model = language.Model(samples)
    assert all(len(set(t)) > 2500 for _, t in samples.texts)
    size = sum(a.nbytes for a in (model.base, model.owner, model.value, model.restart, model.codes))
    assert size < 60 << 20
    assert len(model.codes) == 0x110000 and model.base.size > 400_000
    labels, scores = model.predict([t for v in texts.values() for t in v[-3:]] + ["123", None])
    assert labels == [k for k in texts for _ in range(3)] + ["und", "und"]
    assert min(scores[:-2]) > 0


def test_packed_rows_equal_plain_ones():
    rnd = random.Random(6)
    for width in (3, 40, 500):
        rows = [{c: rnd.randrange(9) for c in rnd.sample(range(width), min(width, rnd.choice([0, 1, 1, 1, 2, 5, width])))} for _ in range(200)]
        base, owner, value = language.packed(rows, width)
        for r, row in enumerate(rows):
            for c in range(width):
                cell = base[r] + c
                assert (owner[cell] == r) == (c in row) and (c not in row or value[cell] == row[c])


def test_sample_takes_stretches_of_all_drawn_texts(spark):
    rows = [(f"{k:03d}" * 2000, "a") for k in range(100, 140)] + [("short", "a"), ("x" * 9, "b")]
    sample = dict(language.learn(spark.createDataFrame(rows, "text string, lang string"), train_chars=8200, train_docs=400).texts)
    parts = sample["a"].split(" ")
    assert len(parts) == 41 and {len(p) for p in parts} == {200, 5}
    assert sample["b"] == "x" * 9
    few = dict(language.learn(spark.createDataFrame(rows, "text string, lang string"), train_chars=8000, train_docs=10).texts)
    assert len(few["a"].split(" ")) == 10 and len(few["a"]) <= 8010
