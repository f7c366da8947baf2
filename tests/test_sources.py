import json
import random

import pytest
from pyspark.sql import functions as F

from filingloom.session import CHECKPOINT_SETTING, cut_lineage, scratch_dir
from filingloom.sources import filings as fl
from filingloom.sources import jsonl
from filingloom.sources.seen import SeenIds, keep_asked


@pytest.fixture
def lines_file(tmp_path):
    lines = ['{"id": 1, "t": "x"}', "", "not json", "[1, 2]", '{"id": 2}', "   ", '{"id": 3, "t": null}']
    path = tmp_path / "rows.jsonl"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_lenient_read_keeps_objects_only(spark, lines_file):
    rows = jsonl.read_objects(spark, lines_file, "id int, t string").collect()
    assert sorted((r.id, r.t) for r in rows) == [(1, "x"), (2, None), (3, None)]
    assert jsonl.read_objects(spark, lines_file, "id int").count() == 3
    assert jsonl.read_objects(spark, lines_file, "t int").count() == 3


def test_audit_counts_lines_with_blank_ones(spark, lines_file):
    rows = jsonl.read_audit(spark, lines_file).collect()
    assert sorted((r.line_no, r.kind) for r in rows) == [
        (1, "object"), (3, "bad"), (4, "other"), (5, "object"), (7, "object"),
    ]


def test_strict_read_names_file_and_line(spark, lines_file, tmp_path):
    with pytest.raises(Exception, match=r"rows\.jsonl:3: invalid JSON"):
        jsonl.read_strict(spark, lines_file, "id int").collect()
    good = tmp_path / "good.jsonl"
    good.write_text('{"id": 1}\n\n{"id": 2}\n')
    assert sorted(r.id for r in jsonl.read_strict(spark, str(good), "id int").collect()) == [1, 2]


def test_line_numbers_survive_file_splits(spark, tmp_path):
    for name, n in (("a", 400), ("b", 1)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name} line {i} {'x' * 40}\n" for i in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = jsonl.number_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 401
    assert all(int(r.line.split()[2]) == r.line_no for r in rows)


def test_optional_object(one):
    assert one(lambda c: jsonl.json_object(c, "a int")["a"], '{"a": 5}') == 5
    for bad in ("[1]", "{", "", None):
        assert one(lambda c: jsonl.json_object(c.cast("string"), "a int"), bad) is None
    assert one(lambda c: jsonl.object_warning(F.lit("x"), c), "[1]") == "x: not an object"


def test_split_folders_round_trip(spark):
    df = spark.createDataFrame([(1, "é\n", "train"), (2, None, "test")], "id int, t string, split string")
    for fmt in ("json", "parquet"):
        path = jsonl.write_splits(df, scratch_dir(spark, "t"), fmt)
        back = jsonl.read_splits(spark, path, df.schema, fmt)
        assert sorted(back.collect(), key=lambda r: r.id) == df.collect()
        assert jsonl.read_splits(spark, path, df.schema, fmt).where("split = 'test'").count() == 1


def test_scratch_follows_the_session_setting(spark):
    root = spark.conf.get(CHECKPOINT_SETTING)
    assert scratch_dir(spark, "x").startswith(root)
    df = cut_lineage(spark.range(3), "t")
    assert df.count() == 3 and root in df.inputFiles()[0]


def test_register_and_lookup(spark):
    text = json.dumps(
        {"0": {"cik_str": 320193, "ticker": "aapl", "title": "A"}, "1": {"cik_str": 789019, "ticker": "MSFT", "title": "M"}}
    )
    register = fl.company_register(spark.createDataFrame([(text,)], "j string"), "j")
    wanted = spark.createDataFrame([(" Aapl ",), ("ZZZ",), ("AAPL",)], "ticker string")
    rows = {r.ticker: (r.cik, r.known) for r in fl.resolve_tickers(wanted, register).collect()}
    assert rows == {"AAPL": ("0000320193", True), "ZZZ": (None, False)}


def test_cik(one, spark):
    assert one(fl.normalize_cik, "CIK 320-193") == "0000320193"
    assert one(fl.normalize_cik, "123456789012") == "123456789012"
    assert one(fl.normalize_cik, "none") is None
    assert one(fl.normalize_cik, 5) == "0000000005"
    with pytest.raises(Exception, match="Invalid CIK"):
        one(fl.require_cik, "none")


def test_history_fills_short_arrays(spark):
    df = spark.sql(
        "SELECT 1 k, array('a', 'b') accession_number, array('d1') filing_date, array() report_date, "
        "array('f1', 'f2', 'f3') form, array('p', null) primary_document"
    )
    rows = fl.filing_history(df.withColumn("report_date", F.col("report_date").cast("array<string>")), ["k"], "accession_number").collect()
    assert [tuple(r)[1:] for r in rows] == [(0, "a", "d1", "", "f1", "p"), (1, "b", "", "", "f2", "")]


def test_filter_drops_undated_rows_only_with_bounds(spark):
    df = spark.createDataFrame([("10-K", "2022-01-01"), ("10-k", ""), ("8-K", "2022"), ("10-K", "2019-05-05")], "form string, filing_date string")
    assert fl.filter_filings(df, ["10-k"]).count() == 3
    assert fl.filter_filings(df, ["10-k"], start_year=2019).count() == 2
    assert fl.filter_filings(df, None, 2020, 2022).count() == 2


def test_ticker_list_and_paths(one):
    assert one(fl.ticker_list, "aapl, MSFT,,aapl , x") == ["AAPL", "MSFT", "X"]
    ids = one(fl.path_identifiers, "/data/AAPL/10-K/2022/0001.v2.html")
    assert tuple(ids) == ("AAPL", "10-K", "2022", "0001.v2")
    assert tuple(one(fl.path_identifiers, "x.html")) == ("UNKNOWN", "UNKNOWN", "0000", "x")
    assert tuple(one(fl.path_identifiers, "/a/b.html")) == ("UNKNOWN", "/".replace("/", "-"), "a", "b")
    with_meta = one(
        lambda p: fl.path_identifiers(p, F.lit(""), F.lit("7"), F.lit("10-K/A"), F.lit("2021-02-03"), F.lit("")),
        "r/s/t/u.html",
    )
    assert tuple(with_meta) == ("7", "10-K-A", "2021", "u")


def test_storage_path(one):
    path = lambda *c: fl.storage_path(*c)
    assert one(path, "", "0001", "10-K/A", "", "acc") == "0001/10-K-A/0000/acc.html"
    assert one(path, "AAPL", "0001", "10-K", "2022-10-28", "acc") == "AAPL/10-K/2022/acc.html"


def test_whole_files_join_the_manifest(spark, tmp_path):
    (tmp_path / "a.html").write_bytes("café ".encode() + b"\xff\xfe<p>")
    files = fl.read_whole_files(spark, str(tmp_path))
    path = files.first().raw_path
    manifest = spark.createDataFrame([(path,), ("",), ("gone",), (None,)], "raw_path string")
    assert [r.content for r in fl.attach_files(manifest, files).collect()] == ["café <p>"]
    assert sorted(str(r.raw_path) for r in fl.missing_files(manifest, files).collect()) == ["", "None", "gone"]


def test_download_manifest_flags(spark):
    filings = spark.createDataFrame(
        [("0000000001", "1-22-1", "10-K", "2022-01-01", "d.htm"), ("0000000001", "1-22-2", "10-K", "2023-01-01", "e.htm"), ("0000000009", "9-1-1", "10-K", "2020-01-01", "z.htm")],
        "cik string, accession_number string, form string, filing_date string, primary_document string",
    )
    requested = spark.createDataFrame([("AAA", "0000000001"), ("NOPE", None)], "ticker string, cik string")
    fetched = spark.createDataFrame([("1-22-2",)], "accession_number string")
    rows = {r.accession_number: r for r in fl.download_manifest(requested, filings, fetched, 5).collect()}
    assert set(rows) == {"1-22-1", "1-22-2"}
    assert rows["1-22-2"].downloaded and rows["1-22-2"].raw_path == "AAA/10-K/2023/1222.html"
    assert not rows["1-22-1"].downloaded and rows["1-22-1"].raw_path == ""
    assert rows["1-22-1"].document_url.endswith("/data/1/1221/d.htm")


def test_ten_batches_of_ids_equal_a_full_join(spark):
    rng = random.Random(5)
    store = SeenIds(spark, scratch_dir(spark, "seen"), expected=400)
    seen, asked, unsure = set(), 0, 0
    for batch in range(10):
        ids = [f"a-{rng.randrange(700)}" for _ in range(120)] + [None, "same", "same"]
        rows = spark.createDataFrame([(i, batch) for i in ids], "key string, b int").repartition(3)
        answers = {r["key"]: r["seen"] for r in store.ask(rows, "key").collect()}
        assert all(answers[i] is None for i in ids if i in seen), "the filter lost an id"
        assert answers[None] is False
        asked += sum(i not in seen for i in ids)
        unsure += sum(i not in seen and answers[i] is None for i in ids)
        assert sorted(r["key"] for r in store.repeated(rows, "key").collect()) == sorted(i for i in ids if i in seen)
        fresh = [r["key"] for r in store.add(rows, "key").collect()]
        assert sorted(fresh, key=str) == sorted((i for i in ids if i is None or i not in seen), key=str)
        seen |= {i for i in ids if i is not None}
        assert store.batches() == batch + 1
    # few new ids are joined for nothing, though there are more than expected
    assert unsure < asked / 10
    again = SeenIds(spark, store.folder, expected=400)
    assert again.batches() == 10 and again.add(rows, "key").count() == 1


def test_a_store_needs_positive_numbers(spark):
    with pytest.raises(ValueError):
        SeenIds(spark, "x", expected=0)


def test_files_over_the_limit_are_listed_but_not_opened(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "small.html").write_bytes(b"ok \xff!")
    (tmp_path / "big.html").write_bytes(b"x" * 500)
    listed = {r["raw_path"].rsplit("/", 1)[1]: r["size"] for r in fl.list_files(spark, str(tmp_path)).collect()}
    assert listed == {"small.html": 5, "big.html": 500}
    got = {r["raw_path"].rsplit("/", 1)[1]: (r["size"], r["content"]) for r in fl.read_whole_files(spark, str(tmp_path), 100).collect()}
    assert got == {"small.html": (5, "ok !"), "big.html": (500, None)}
    below = {r["p"] for r in fl.list_files(spark, str(tmp_path)).select(fl.below(F.col("raw_path"), str(tmp_path)).alias("p")).collect()}
    assert below == {"a/small.html", "big.html"}


def test_files_are_written_by_tasks_and_read_back_whole(spark, tmp_path):
    folder = f"file://{tmp_path}/written"
    rows = spark.createDataFrame([("a=1", "one"), ("b", None), ("a=1", "two\n"), ("c", "d\u00e9j\u00e0")], "name string, body string").coalesce(1)
    assert fl.write_files(rows, folder, "name", "body") == 3
    got = {r["raw_path"].rsplit("/", 1)[1]: (r["size"], r["content"]) for r in fl.read_whole_files(spark, folder).collect()}
    assert got == {"a=1": (9, "one\ntwo\n\n"), "b": (1, "\n"), "c": (7, "d\u00e9j\u00e0\n")}
    assert fl.write_files(rows.where("false"), f"{folder}-none", "name", "body") == 0
    assert fl.list_files(spark, f"{folder}-none").count() == 0


def test_pages_as_files_need_no_folder_each(spark, tmp_path):
    from filingloom.plans.catalog import manifests

    html = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("<p>"), F.col("id").cast("string")).alias("html"))
    html.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    folder, manifest = manifests._page_files(spark, str(tmp_path))
    files = fl.list_files(spark, folder)
    # a folder per task that wrote, not per page
    assert files.select(F.regexp_extract("raw_path", "(.*)/", 1)).distinct().count() <= 3
    found = files.withColumn("raw_path", manifests._page_path(folder))
    assert {r["raw_path"] for r in found.collect()} == {f"page={i}" for i in range(400) if i % 7}
    assert {r["page_id"] for r in fl.missing_files(manifest, found).collect()} == {i for i in range(400) if i % 5 == 0 or i % 7 == 0}


def test_a_filter_keeps_all_rows_that_are_asked_for(spark):
    rows = spark.range(100_000).select((F.col("id") * 7919 - 5).alias("key"), "id").unionByName(spark.createDataFrame([(None, -1)], "key long, id long"))
    asked = spark.range(0, 100_000, 500).select((F.col("id") * 7919 - 5).cast("int").alias("k")).unionByName(spark.createDataFrame([(None,)], "k int"))
    kept = {r["id"] for r in keep_asked(rows, "key", asked, "k").collect()}
    assert kept >= set(range(0, 100_000, 500)) and len(kept) < 250 and -1 not in kept
    # a filter that is too small passes more and still drops none
    full = {r["id"] for r in keep_asked(rows, "key", asked, "k", words=2).collect()}
    assert full >= kept
    assert keep_asked(rows, "key", asked.where("false"), "k").count() == 0
