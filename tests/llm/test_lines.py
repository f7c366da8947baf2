import random
from collections import Counter

import pytest

from filingloom.llm import lines
from filingloom.session import scratch_dir

from .conftest import AWKWARD, wide

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def plain(rows, min_docs, min_chars=1):
    counts = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if counts[key(x)] < min_docs]
        out.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("min_docs,min_chars", [(2, 1), (4, 1), (2, 5)])
def test_awkward_rows(awkward, min_docs, min_chars):
    found = lines.drop_frequent_lines(awkward, min_docs=min_docs, min_chars=min_chars)
    assert got(found) == plain(AWKWARD, min_docs, min_chars)


@pytest.mark.parametrize("batches,fanout", [(1, 4), (5, 2)])
def test_batches_and_levels_do_not_matter(spark, batches, fanout):
    rows = [(i, "\n".join(["hot"] * (i % 3 == 0) + [f"l{i % 40}", f"m{i}", f"n{i // 12}"])) for i in range(240)]
    found = lines.drop_frequent_lines(wide(spark, rows).repartition(4), min_docs=10, batches=batches, fanout=fanout)
    assert got(found) == plain(rows, 10)


def test_all_columns_stay(awkward):
    kept = lines.without_frequent_lines(awkward, chars_col="n_chars", min_docs=4)
    assert kept.schema.names == awkward.schema.names
    texts = {str(r["doc_id"]): (r["text"], r["n_chars"]) for r in kept.collect()}
    assert texts["1"] == ("Alpha beta gamma delta epsilon zeta\nend", 39)
    assert texts["3"] == (None, None)
    assert texts["None"][0] == "no id here"


def test_empty(nothing):
    assert lines.drop_frequent_lines(nothing).count() == 0
    assert lines.without_frequent_lines(nothing).count() == 0


def test_runs_settle_over_levels(spark):
    store = lines.LineRuns(spark, min_docs=3, fanout=2)
    for _ in range(4):
        store.add(spark.createDataFrame([(b"a",), (b"b",)], "hash binary"))
    store.add(spark.createDataFrame([(b"c",), (b"c",)], "hash binary"))
    assert {bytes(r["hash"]) for r in store.frequent().collect()} == {b"a", b"b"}
    assert max(store.levels) == 2
    store.close()
    assert not store.runs()


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange"), plan.count("SortMergeJoin"), plan.count("BroadcastHashJoin")


def test_a_batch_meets_the_runs_where_they_are(spark):
    """The batch is dealt out once; no run is, and all are met by merge joins."""
    store = lines.LineRuns(spark, min_docs=2, fanout=9)
    rows = [(bytes([k % 7]),) for k in range(30)]
    for _ in range(3):
        store.add(spark.createDataFrame(rows, "hash binary"))
    batch = store.unknown(spark.createDataFrame(rows, "hash binary"))
    assert _exchanges(batch) == (1, 3, 0)
    store.close()


def test_twenty_batches_in_a_store_that_is_opened_again(spark):
    rng = random.Random(3)
    root, counts = scratch_dir(spark, "kept-lines"), Counter()
    for batch in range(20):
        docs = [{f"line {rng.randrange(1, 90) ** 2 // 60}" for _ in range(4)} for _ in range(3)]
        counts.update(x for d in docs for x in d)
        store = lines.LineRuns(spark, min_docs=5, fanout=3, root=root, buckets=3)
        assert store.batches == batch
        store.add(spark.createDataFrame([(x.encode(),) for d in docs for x in d], "hash binary"))
        if batch % 6 == 5:
            found = {bytes(r["hash"]).decode() for r in store.frequent().collect()}
            assert found == {x for x, n in counts.items() if n >= 5} and found
        store.close()
    again = lines.LineRuns(spark, min_docs=5, fanout=3, root=root, buckets=99)
    assert again.buckets == 3 and max(again.levels) >= 2
    assert {bytes(r["hash"]).decode() for r in again.frequent().collect()} == {x for x, n in counts.items() if n >= 5}
    again.close()


def test_a_batch_that_fails_leaves_the_store_as_it_was(spark):
    root = scratch_dir(spark, "kept-lines")
    store = lines.LineRuns(spark, min_docs=1, root=root)
    store.add(spark.createDataFrame([(b"a",)], "hash binary"))
    broken = spark.createDataFrame([(b"b",)], "hash binary").withColumn("hash", lines.F.when(lines.F.raise_error(lines.F.lit("lost")).isNull(), b"x"))
    with pytest.raises(Exception, match="lost"):
        store.add(broken)
    again = lines.LineRuns(spark, min_docs=1, root=root)
    assert again.batches == 1 and [bytes(r["hash"]) for r in again.frequent().collect()] == [b"a"]
    store.close(), again.close()
