import random
from itertools import combinations

import numpy as np
import pytest

from filingloom.llm import graph, ngram_join, pivots
from filingloom.llm.shingles import shingles

from .conftest import AWKWARD, wide


def reach(nodes, links):
    """Least node reachable from each."""
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    out, word = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            out, word = (out + [word], "") if word else (out, "")
        else:
            word += c
    return out


def plain_set(text):
    words = words_of(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(rows):
    sets = [plain_set(t) for _, t in rows]
    links = [
        (rows[i][0], rows[j][0])
        for i, j in combinations(range(len(rows)), 2)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    least = reach([i for i, _ in rows], links)
    return sorted((i, len(s), least[i]) for (i, _), s in zip(rows, sets))


def variants(seed, n=160):
    """Texts of many lengths with copies, near copies at and around the limit, shared passages."""
    rng = random.Random(seed)
    rows, pool = [], []
    passage = [f"p{k}" for k in range(25)]
    for i in range(n):
        if pool and rng.random() < 0.6:
            words = list(rng.choice(pool))
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                at = rng.randrange(len(words) + 1)
                what = rng.random()
                if what < 0.4:
                    words.insert(at, f"n{rng.randrange(10**6)}")
                elif what < 0.7 and len(words) > 1:
                    words.pop(min(at, len(words) - 1))
                else:
                    words.append("tail")
        else:
            words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 3, 5, 6, 9, 14, 30, 60, 120]))]
            if rng.random() < 0.3:
                words += passage
        pool.append(words)
        rows.append((i + 1, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    rows = variants(seed)
    found = ngram_join.similar_documents(wide(spark, rows).repartition(4))
    assert sorted(tuple(r) for r in found.collect()) == plain_components(rows)


def test_shingles_are_sets_of_words():
    for _, text in AWKWARD:
        assert len(shingles((text or "").encode())) == len(plain_set(text))


@pytest.mark.parametrize("size", [1, 2, 4, 5, 9, 23, 80, 301])
def test_similar_sets_always_meet(size):
    """Pigeonhole: probes of the larger set and entries of the smaller one share a hash."""
    rng = np.random.default_rng(size)
    heavy = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for _ in range(60):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        gone = int(rng.integers(0, size // 5 + 1))
        most = (size - gone) * 100 // 80 - size
        new = int(rng.integers(0, max(0, most) + 1))
        other = np.concatenate([base[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64)])
        a, b = np.unique(base), np.unique(other)
        common = len(np.intersect1d(a, b))
        if 100 * common < 80 * (len(a) + len(b) - common):
            continue
        small, large = sorted((a, b), key=len)
        hs, rs = ngram_join.signatures(small, *heavy, 80)
        hl, rl = ngram_join.signatures(large, *heavy, 80)
        assert np.intersect1d(hs[rs & 1 > 0], hl[rl & 2 > 0]).size
        # choosing by cost must not lose them either
        every = np.unique(np.concatenate([a, b]))[::2], np.full(len(np.unique(np.concatenate([a, b]))[::2]), 10**6)
        hs, rs = ngram_join.signatures(small, *every, 80)
        hl, rl = ngram_join.signatures(large, *every, 80)
        assert np.intersect1d(hs[rs & 1 > 0], hl[rl & 2 > 0]).size


def test_sketches_differ_in_no_more_cells_than_sets_in_shingles():
    rng = np.random.default_rng(9)
    for _ in range(300):
        both, mine, yours = (rng.integers(0, 1 << 63, int(n), dtype=np.uint64) for n in rng.integers(0, 60, 3))
        a, b = np.unique(np.concatenate([both, mine])), np.unique(np.concatenate([both, yours]))
        if not len(a) or not len(b):
            continue
        x, y = (np.frombuffer(ngram_join.sketch(s), np.uint8) for s in (a, b))
        n = min(len(x), len(y))
        unlike = int((ngram_join.folded(x, n) != ngram_join.folded(y, n)).sum())
        assert unlike <= len(np.setxor1d(a, b))


def test_small_blocks_lose_no_link(spark, monkeypatch):
    """A crowd around one text: many share buckets, some are linked, most are not."""
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "CHUNK", 2)
    rng = random.Random(11)
    base = [f"b{k}" for k in range(70)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        rows.append((i + 1, " ".join(words)))
    found = ngram_join.similar_documents(wide(spark, rows).repartition(3))
    assert sorted(tuple(r) for r in found.collect()) == plain_components(rows)


def test_classes_whose_numbers_collide(spark):
    rows = variants(5, 90)
    found = ngram_join.similar_documents(wide(spark, rows), key_bits=4)
    assert sorted(tuple(r) for r in found.collect()) == plain_components(rows)


def _crowd(seed, members, edits):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    for k in range(members):
        own = base.copy()
        at = rng.choice(200, edits, replace=False)
        own[at] = rng.integers(0, 1 << 63, edits, dtype=np.uint64)
        yield np.unique(own)


@pytest.mark.parametrize("edits", [8, 12, 13, 14, 40])
def test_a_crowd_gives_no_more_rows_than_members(edits):
    """A bucket of like sets, all or some or none of them linked, hands on a forest."""
    sets = list(_crowd(edits, 150, edits))
    both = ngram_join._INDEX | ngram_join._PROBE
    members = [(7, 0, 0, both, k, k, len(s), 0) for k, s in enumerate(sets)]

    def fed(extra, kind):
        schema = ngram_join.pa.schema([(f"c{k}", ngram_join.pa.int64()) for k in range(8)] + [("x", kind)])
        columns = [list(c) for c in zip(*members)] + [extra]
        return iter([ngram_join.pa.RecordBatch.from_arrays([ngram_join.pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)])

    links = [
        (a, b) for a, b in combinations(range(len(sets)), 2)
        if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))
    ]
    kept = [r for b in ngram_join._promising(80)(fed([ngram_join.sketch(s) for s in sets], ngram_join.pa.binary())) for r in b.to_pylist()]
    assert len(kept) <= len(sets) and {x for ab in links for x in ab} <= {r["key"] for r in kept}
    found = [tuple(r.values()) for b in ngram_join._joining(80)(fed([s.tobytes() for s in sets], ngram_join.pa.binary())) for r in b.to_pylist()]
    assert len(found) < len(sets)
    assert reach(range(len(sets)), found) == reach(range(len(sets)), links)


def test_join_awkward_rows(awkward):
    found = {str(r["doc_id"]): (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_documents(awkward).collect()}
    assert found["3"] == (0, 3) and found["4"] == (0, 4) and found["5"] == (0, 5)
    assert found["1"][1] == found["2"][1] == 1
    assert found["6"] == (2, 6) and found["8"] == (1, 8) and found["9"] == (1, 9)
    assert found["10"][1] == 10 and found["11"][1] == 11
    assert found["None"] == (1, None)


def test_ids_with_several_texts(spark):
    rng = random.Random(12)
    a, b, c = ([f"{k}{n}" for n in range(60)] for k in "abc")
    near_b = [*b[:-1], "other"]
    rows = [(1, a), (7, a), (7, b), (9, near_b), (3, c), (3, []), (2, c)]
    rows = [(i, " ".join(words)) for i, words in rows] + [(i + 100, t) for i, t in variants(3, 80)]
    rows += [(100 + rng.randrange(1, 81), t) for _, t in variants(3, 80)[::4]]
    found = ngram_join.similar_documents(wide(spark, rows).repartition(4))
    assert sorted(tuple(r) for r in found.collect()) == plain_components(rows)


def test_join_empty(nothing):
    assert ngram_join.similar_documents(nothing).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100, k) for k in range(101, 160)]
    edges += [(k, k + 1) for k in range(200, 230)]
    found = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(3))
    nodes = {n for a, b in edges for n in (a, b) if a != b}
    want = reach(nodes, [(a, b) for a, b in edges if a != b])
    assert {r["node"]: r["component"] for r in found.collect()} == want


VECTORS = "vec_id long, embedding array<float>, label int, rep int, weight int, v int, near int"


def vector_rows(rows):
    return [(i, v, y, 1, 2, 3, 4) for i, v, y in rows]


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    rows = []
    for i in range(400):
        x = base[i % 60] + rng.normal(size=16) * rng.choice([0, 0.05, 0.1, 0.3])
        rows.append((i, [float(np.float32(c)) for c in x * (1 + i % 3)], i % 60 % 4))
    rows += [(400 + k, rows[0][1], 0) for k in range(40)]
    frame = spark.createDataFrame(vector_rows(rows), VECTORS).repartition(4)
    found = {r["vec_id"]: tuple(r)[1:] for r in pivots.near_vectors(frame).collect()}
    x = np.array([np.float32(v) for _, v, _ in rows]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([y for *_, y in rows])
    close = (x @ x.T >= pivots.THRESHOLD) & (label[:, None] == label)
    np.fill_diagonal(close, False)
    n = close.sum(axis=1)
    assert sum(f[0] for f in found.values()) >= 0.97 * n.sum()
    assert all(found[i][0] <= n[i] for i in range(len(rows)))
    least = reach(range(len(rows)), list(zip(*np.nonzero(close))))
    same = sum(found[i][1] == least[i] for i in range(len(rows)))
    assert same >= 0.97 * len(rows)
    assert all(f[2] == (f[1] == i) for i, f in found.items())


@pytest.mark.parametrize("count", [64, 453, 2048, 4096, 8192, 16_384])
def test_recall_at_the_threshold_for_every_number_of_pivots(count):
    """Pairs at cosine 0.93 exactly: at least 98 in 100 share two pivots of their prefixes."""
    rng = np.random.default_rng(7)

    def unit(n):
        x = rng.normal(size=(n, 64))
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    drawn, x, z = unit(count), unit(800), unit(800)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.93 * x + (1 - 0.93**2) ** 0.5 * z
    n = pivots.prefix_length(count)
    near = [np.argpartition(-(v @ drawn.T), n, axis=1)[:, :n] for v in (x, y)]
    shared = (near[0][:, :, None] == near[1][:, None, :]).any(axis=2).sum(axis=1)
    assert (shared >= pivots.MIN_SHARED).mean() >= 0.98


def test_long_lists_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 16)
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in np.eye(8)[0] + rng.normal(size=8) * 0.01], 1) for i in range(120)]
    found = pivots.near_vectors(spark.createDataFrame(vector_rows(rows), VECTORS)).collect()
    assert {(r["n_links"], r["component_id"]) for r in found} == {(119, 0)}


def test_unusable_vectors_link_with_nothing(spark):
    one = [1.0, 2.0]
    rows = [
        (1, one, 1),
        (2, [2.0, 4.0], 1),
        (3, one, 2),
        (4, one, None),
        (5, None, 1),
        (6, [], 1),
        (7, [0.0, 0.0], 1),
        (8, [1.0, None], 1),
        (9, [1.0, float("nan")], 1),
        (10, [1.0, float("inf")], 1),
        (11, [1.0, 2.0, 0.0], 1),
        (12, one, 1),
        (None, one, 1),
    ]
    found = pivots.near_vectors(spark.createDataFrame(vector_rows(rows), VECTORS)).collect()
    by_id = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found}
    assert len(found) == len(rows)
    assert by_id[1] == by_id[2] == by_id[12] == (2, 1)
    assert all(by_id[i] == (0, i) for i in range(3, 12))
    empty = spark.createDataFrame([], VECTORS)
    assert pivots.near_vectors(empty).count() == 0


def test_vectors_of_very_many_lengths(spark):
    from pyspark.sql import functions as F

    ids = spark.range(1, 1003).withColumn("size", F.least("id", F.lit(1001)).cast("int"))
    vectors = ids.select(F.col("id").alias("vec_id"), F.lit("x").alias("label"), "size")
    last = F.when(F.col("vec_id") == 1002, 0.5).otherwise(1.0).cast("float")
    value = F.concat(F.array_repeat(F.lit(1.0).cast("float"), F.col("size") - 1), F.array(last))
    found = pivots.near_vectors(vectors.select("vec_id", "label", value.alias("embedding"))).where("n_links > 0")
    assert sorted(tuple(r) for r in found.collect()) == [(1001, 1, 1001, True), (1002, 1, 1001, False)]
