import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingloom.llm import queries, reconcile
from filingloom.llm.common import raw_bytes


def pieces(text: bytes) -> Counter:
    """Paragraphs, put together word by word."""
    out, own = Counter(), []
    for word in reconcile._words(text):
        own.append(word)
        h = reconcile.xxhash.xxh3_64_intdigest(word)  # bit 20 and up picks ends
        if word.endswith(b"\n") or (h >> 20) & reconcile.CUT_BITS == 0 or len(own) == reconcile.MOST_WORDS:
            out[tuple(own)] += 1
            own = []
    if own:
        out[tuple(own)] += 1
    return out


def likeness(a: bytes, b: bytes) -> float:
    x, y = pieces(a), pieces(b)
    either = sum((x | y).values())
    return sum((x & y).values()) / either if either else 1.0


def some_texts(seed, count):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["é", "x" * 70, "", "y\n", "\n"]
    return [" ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 3, 30, 400]))).encode() for _ in range(count)]


def changed(rnd, text):
    at = rnd.randint(0, len(text))
    return text[:at] + rnd.choice([b"", b" new words here", b"\n"]) + text[at + rnd.choice([0, 0, 9, 200]) :]


def test_words_tell_the_text():
    for text in some_texts(1, 200) + [b"a b", b"a  b", b"a\nb", b"a\n b", b"x" * 64, b"x" * 65, b"x" * 128 + b" y", b" ", b"\n"]:
        words = reconcile._words(text)
        joined = b" ".join(words).replace(reconcile._CUT_MARK + b" ", b"").replace(b"\n ", b"\n")
        assert joined == text
    assert reconcile._words(b"") == []


def test_differences_equal_plain_sets():
    rnd = random.Random(3)
    texts = some_texts(2, 150)
    pairs = [(t, changed(rnd, t)) for t in texts] + list(zip(texts, texts[1:])) + [(t, t) for t in texts[:9]]
    place = {t: k for k, t in enumerate(dict.fromkeys(x for p in pairs for x in p))}
    versions = reconcile.Versions(list(place))
    mine, other = (np.array([place[p[k]] for p in pairs]) for k in (0, 1))
    sets = [set(d.tolist()) for d in np.split(versions.digests, versions.stop[:-1])]
    retried = 0
    for (a, b), i, j, (gone, new, cells) in zip(pairs, mine, other, versions.differences(mine, other)):
        assert set(gone.tolist()) == sets[i] - sets[j] and len(gone) == len(sets[i] - sets[j])
        assert set(new.tolist()) == sets[j] - sets[i] and len(new) == len(sets[j] - sets[i])
        assert versions.likeness(i, j, len(gone), len(new)) == pytest.approx(likeness(a, b), abs=1e-12)
        retried += cells > 3 * reconcile.CELLS
    assert retried > 20


def test_small_differences_need_no_larger_sketch():
    text = " ".join(f"word{k}" for k in range(5000)).encode()
    versions = reconcile.Versions([text, text.replace(b"word777 ", b"other ")])
    (gone, new, cells), = versions.differences(np.array([0]), np.array([1]))
    assert 1 <= len(gone) <= 2 and 1 <= len(new) <= 2 and cells == 3 * reconcile.CELLS


def test_fingerprints_of_equal_texts_only_are_equal():
    texts = list(dict.fromkeys(some_texts(4, 300)))
    prints = reconcile.Versions(texts).fingerprints()
    assert len(set(prints)) == len(texts)
    assert reconcile.Versions(texts[::-1]).fingerprints()[::-1] == prints
    assert len({len(base64.b64decode(p)) for p in prints}) == 1


def test_rows_in_every_odd_form(awkward):
    rows = awkward.withColumn("other", F.concat("text", F.lit(" more")))
    rows = rows.withColumns({"content": F.col("text"), "label": F.col("other")})
    got = reconcile.compare_versions(rows, ["doc_id", "content", "label", "id", "hash"], "text", ["other"]).collect()
    assert sorted([(r[0], r[1]) for r in got], key=str) == sorted(map(tuple, awkward.select("doc_id", "text").collect()), key=str)
    for r in got:
        a, b = ((r[c] or "").encode() for c in ("content", "label"))
        assert r["id"] == 7 and r["hash"] == "h"
        found = r["other_difference"]
        assert found["likeness"] == pytest.approx(likeness(a, b))
        assert (found["n_removed"], found["n_added"]) == (len(found["removed"]), len(found["added"]))
        assert (r["fingerprint"] == r["other_fingerprint"]) == (a == b)


def test_empty_tables(nothing, spark):
    rows = nothing.withColumn("other", F.col("text"))
    assert reconcile.compare_versions(rows, ["doc_id"], "text", ["other"]).collect() == []
    assert reconcile.with_following(nothing, lambda rows: rows.select("part", "edge", "edge_text", "id", "next_text")).collect() == []


def test_options_are_checked(awkward):
    with pytest.raises(ValueError):
        reconcile.compare_versions(awkward, [], "text", ["lang"], cells=3)
    with pytest.raises(ValueError):
        reconcile.compare_versions(awkward, [], "text", [])


@pytest.mark.parametrize("chars", [1 << 26, 40])
def test_following_texts(awkward, monkeypatch, chars):
    monkeypatch.setattr(reconcile, "CHARS_PER_TASK", chars)
    rows = [(r["doc_id"], r["text"] or "") for r in awkward.where(F.length(F.coalesce("text", F.lit(""))) < 1000).collect()]
    docs = awkward.where(F.length(F.coalesce("text", F.lit(""))) < 1000)
    got = reconcile.with_following(docs, lambda rows: rows.select("part", "edge", "edge_text", "id", "text", "next_text")).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = [(i, t, u) for (i, t), (_, u) in zip(ordered, ordered[1:] + ordered[:1])]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reconcile, "CHARS_PER_TASK", 20_000)
    texts = [t.decode() for t in some_texts(6, 120)]
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, texts[4]), (1003, "🙂é")]
    random.Random(1).shuffle(rows)
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_document_fingerprints"](spark, path).collect()}
    ordered = [(i, t or "") for i, t in sorted(rows)]
    assert len(got) == len(rows)
    for (i, t), (_, u) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        row = got[i]
        assert row["n_chars"] == len(t)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["near_edited"] == pytest.approx(likeness(t.encode(), edited.encode()), abs=1e-12)
        assert row["near_next"] == pytest.approx(likeness(t.encode(), u.encode()), abs=1e-12)
        assert [row["fingerprint"], row["edited_fingerprint"]] == reconcile.Versions([t.encode(), edited.encode()]).fingerprints()[: 2] or t == edited
    assert got[1001]["fingerprint"] == got[12]["fingerprint"]


def test_null_counts_as_empty(spark):
    assert raw_bytes(reconcile.pa.array([None, "a"])) == [b"", b"a"]
