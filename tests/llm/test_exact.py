import hashlib
from collections import defaultdict

import pytest

from filingloom.llm import exact

from .conftest import AWKWARD, wide


def plain(rows):
    def lower(t):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")

    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for i, t in rows:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("bucket", [exact.BUCKET_BYTES, 400, 1])
@pytest.mark.parametrize("fold", [exact.FOLD_BYTES, 1])
def test_awkward_rows(awkward, bucket, fold):
    assert got(exact.exact_groups(awkward, bucket_bytes=bucket, fold_bytes=fold)) == plain(AWKWARD)


def test_recursion_over_many_texts_and_a_hot_one(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"text {i % 150}") for i in range(600)]
    found = exact.exact_groups(wide(spark, rows).repartition(5), bucket_bytes=1500, fold_bytes=2000)
    assert got(found) == plain(rows)


def test_empty(nothing):
    assert exact.exact_groups(nothing).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert exact.exact_groups(nothing).count() == 0


def test_table_compares_content():
    table = exact.ContentTable()
    assert table.find(5, b"a") == (0, True)
    assert table.find(5, b"b") == (1, True)
    assert table.find(5, b"a") == (0, False)
    for k in range(3000):
        table.find(k * 1024, str(k).encode())
    assert table.find(5, b"b") == (1, False)
    assert table.find(7 * 1024, b"7") == (9, False)
