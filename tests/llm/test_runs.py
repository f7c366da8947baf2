import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from filingloom.llm import queries, runs


def plain_runs(words, least=6, repeats=4):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            size = i - start + q
            inner = words[start : start + size]
            smaller = any(inner[p:] == inner[: size - p] for p in range(1, q))
            if size >= max(least, repeats * q) and not smaller:
                out.append((start, size, q))
    return sorted(out)


def kept_words(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def some_texts(seed, count):
    rnd = random.Random(seed)
    for _ in range(count):
        words = [rnd.choice("abc"[: rnd.randint(1, 3)]) for _ in range(rnd.randint(0, 50))]
        if words and rnd.random() < 0.6:
            a, p = rnd.randrange(len(words)), rnd.randint(1, 9)
            words += [words[min(len(words) - 1, a + k % p)] for k in range(rnd.randint(0, 60))]
        yield words


@pytest.mark.parametrize("repeats", [3, 4, 6])
def test_runs_of_many_texts_at_once_equal_brute_force(repeats):
    texts = list(some_texts(repeats, 600))
    flat = np.array([ord(w) for t in texts for w in t], np.int64)
    got = runs.find_runs(flat, np.array([len(t) for t in texts]), 6, repeats).tolist()
    want, begin = [], 0
    for t in texts:
        want += [[s + begin, n, q] for s, n, q in plain_runs(t, 6, repeats)]
        begin += len(t)
    assert got == want


def test_a_text_of_one_word_and_a_long_period():
    ones = runs.find_runs(np.zeros(5000, np.int64), np.array([5000]))
    assert ones.tolist() == [[0, 5000, 1]]
    block = np.arange(777)
    tail = np.concatenate([np.arange(1000, 1013), np.tile(block, 4), [block[0], 9999]])
    assert runs.find_runs(tail, np.array([len(tail)])).tolist() == [[13, 4 * 777 + 1, 777]]
    short = np.concatenate([np.tile(block, 4)[:-1], [9999]])
    assert not len(runs.find_runs(short, np.array([len(short)])))


def test_runs_do_not_reach_over_texts():
    assert not len(runs.find_runs(np.zeros(10, np.int64), np.array([5, 5])))
    assert not len(runs.find_runs(np.zeros(0, np.int64), np.zeros(0, np.int64)))


def test_fewer_than_three_repeats_are_refused():
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(9, np.int64), np.array([9]), 2, 2)


def test_rows_in_every_odd_form(awkward):
    got = {(r["doc_id"], r["collapsed"]): r for r in runs.periodic_runs(awkward).collect()}
    plain = [r for r in awkward.select("doc_id", "text").collect()]
    assert runs.periodic_runs(awkward).count() == len(plain)
    for r in plain:
        words = [w.decode() for w in (r["text"] or "").encode().split()]
        found = plain_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
        row = got[(r["doc_id"], " ".join(kept_words(words, found)))]
        assert row["n_words"] == len(words)
        assert [tuple(x) for x in row["runs"]] == found


def test_empty_table(nothing):
    assert runs.periodic_runs(nothing).collect() == []


def test_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(5)
    rows = []
    for i in range(400):
        words = [rnd.choice(["a", "b", "C", "dé", "e,"]) for _ in range(rnd.choice([0, 1, 7, 60, 300]))]
        rows.append((i, rnd.choice([" ", "\n", "\t "]).join(words)))
    rows += [(1000, None), (1001, "x " * 500), (1002, " \n ")]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_periodic_runs"](spark, path).collect()}
    assert len(got) == len(rows)
    edited = 0
    for i, text in rows:
        words = (text or "").split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            edited += 1
        found = plain_runs(words)
        top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        row = got[i]
        assert row["n_runs"] == len(found)
        assert (row["start"], row["length"], row["period"]) == top
        assert row["exponent_milli"] == (None if top[0] is None else 1000 * top[1] // top[2])
        assert row["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(" ".join(kept_words(words, found)).encode()).hexdigest()
    assert edited > 20


def test_repeated_tail_leaves_other_rows_alone(spark):
    docs = spark.createDataFrame([(i, f"w{i}  x") for i in range(50)], "doc_id long, text string")
    same = queries.repeated_tail(docs).where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) != 0)
    assert same.exceptAll(docs).isEmpty()
