import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from filingloom.llm import common, packing, rans, token_files, tokens
from filingloom.session import scratch_dir

from .conftest import AWKWARD


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.default_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [tokens.END_ID]


def test_pieces_equal_whole_texts(tokenizer):
    encode = tokens.encoder(tokens.default_path())
    random.seed(1)
    alphabet = "ab1_ \n\t'.,²é½ªº \x1cćñß…“”’١東🙂​"
    texts = ["".join(random.choice(alphabet) for _ in range(60)) for _ in range(800)]
    texts += ["a  b", " a", "a ", "don't I'LL", "x<|endoftext|>y", "", "  ", " \n x", *[t for _, t in AWKWARD if t]]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == ids_of(tokenizer, text), repr(text)


def test_full_caches_change_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "PIECE_ENTRIES", 3)
    monkeypatch.setattr(tokens._Cache, "most", 2)
    monkeypatch.setattr(tokens, "STALE_MISSES", 5)
    monkeypatch.setattr(common, "_held", {})
    encode = tokens.encoder(tokens.default_path())
    text = " ".join(f"word{i % 7} more{i}, x" for i in range(60))
    assert np.frombuffer(encode(text), "<u4").tolist() == ids_of(tokenizer, text)


def test_line_breaks_between_words_need_no_pieces_of_their_own(tokenizer, monkeypatch):
    monkeypatch.setattr(common, "_held", {})
    merged = []
    merge = tokens._Words.merge
    monkeypatch.setattr(tokens._Words, "merge", lambda self, word: merged.append(word) or merge(self, word))
    encode = tokens.encoder(tokens.default_path())
    ends, starts = [f"end{'abcdefgh'[i]}" for i in range(8)], [f"Start{'abcdefgh'[i]}" for i in range(8)]
    for end in ends:
        for start in starts:
            text = f"some {end}.\n{start} more"
            assert np.frombuffer(encode(text), "<u4").tolist() == ids_of(tokenizer, text), text
    # a word before a line break and one behind it are met once each, not once per pair or form
    assert len(merged) == len(set(merged)) == 8 + 8 + len(("some", " more", ".", "\n"))


def test_line_breaks_beside_white_space(tokenizer):
    encode = tokens.encoder(tokens.default_path())
    random.seed(2)
    for _ in range(2000):
        text = "".join(random.choice(["\n", "\n", " ", "\t", "\r", "\x85", "\u2003", "a", "Bc", ".", "\u00e9", "'s"]) for _ in range(9))
        assert np.frombuffer(encode(text), "<u4").tolist() == ids_of(tokenizer, text), repr(text)


@pytest.mark.parametrize("n", [1, 255, 257, 65_537, 200_000])
def test_coding_round_trip_and_checkpoints(n):
    ids = (np.random.default_rng(n).zipf(1.4, n) % 50_257).astype("<u4")
    table = rans.Table.of(ids)
    assert int(table.shares.sum()) == 1 << rans.SCALE_BITS and table.shares.min() > 0
    blocks = rans.encode(ids, table)
    assert (np.concatenate(rans.decode(blocks, table)) == ids).all()
    block = blocks[0]
    for mark in range(len(block.positions)):
        (part,) = rans.decode([block], table, first=mark)
        assert (part == ids[: block.n][mark * rans.CHECKPOINT * rans.LANES :]).all()


def test_damage_is_noticed():
    ids = np.arange(5000, dtype="<u4") % 77
    table = rans.Table.of(ids)
    (block,) = rans.encode(ids, table)
    block.words = block.words.copy()
    block.words[3] ^= 1
    with pytest.raises(ValueError):
        rans.decode([block], table)


@pytest.mark.parametrize("shard", [token_files.SHARD_TOKENS, 10])
def test_files_hold_all_documents_in_order(spark, awkward, tokenizer, shard):
    back = token_files.token_files(spark, awkward, scratch_dir(spark, "t"), shard_tokens=shard).collect()
    want, at = [], 0
    for key, text in sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(tokenizer, text)
        want.append((key, at, len(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    found = sorted(((r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in back), key=lambda r: r[1])
    assert found == want


def test_no_documents(spark, nothing):
    assert token_files.token_files(spark, nothing, scratch_dir(spark, "t")).count() == 0
    assert packing.pack(nothing).count() == 0


def test_packing_places_every_piece(awkward, tokenizer):
    rows = packing.pack(awkward, capacity=256).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for key, text in AWKWARD:
        ids = ids_of(tokenizer, text)
        mine = sorted(by_doc[key], key=lambda r: r["piece"])
        if key == 6:  # two equal rows
            assert len(mine) % 2 == 0
            mine = mine[::2]
        at = 0
        for k, r in enumerate(mine):
            assert (r["piece"], r["start"]) == (k, at) and (r["length"] == 256 or k == 0)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for group in by_sequence.values():
        at = 0
        for r in sorted(group, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256


def fewest(items, capacity):
    """Least number of sequences, by trying everything."""
    best = len(items)

    def go(rest, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not rest:
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= rest[0]:
                go(rest[1:], rooms[:k] + (rooms[k] - rest[0],) + rooms[k + 1 :])
        go(rest[1:], (*rooms, capacity - rest[0]))

    go(sorted(items, reverse=True), ())
    return best


def test_reduction_keeps_an_optimum():
    random.seed(3)
    fixed_any = 0
    for _ in range(250):
        capacity = random.choice([10, 20, 50])
        items = [random.randint(1, capacity) for _ in range(random.randint(1, 8))]
        counts = {x: items.count(x) for x in set(items)}
        fixed, rest = packing.reduce_by_dominance(counts, capacity)
        left = [x for x, n in rest.items() for _ in range(n)]
        fixed_any += sum(b.count for b in fixed)
        assert sum(b.count for b in fixed) + fewest(left, capacity) == fewest(items, capacity), items
    assert fixed_any > 250


def test_runs_number_each_length_once():
    counts = {1: 7, 3: 5, 9: 4, 10: 2}
    runs = packing.plan(counts, 10)
    assert {r[0] for r in runs} == set(counts)
    for length in counts:
        firsts = [r[1] for r in runs if r[0] == length]
        assert firsts[0] == 0 and firsts == sorted(set(firsts))


def test_reduction_goes_on_below_a_length_without_a_sure_set():
    fixed, rest = packing.reduce_by_dominance({60: 1, 55: 3, 45: 3, 12: 1, 11: 1, 10: 1}, 100)
    assert (3, [45, 55]) in [(b.count, sorted(b.lengths)) for b in fixed]
    assert 55 not in rest and 45 not in rest


def test_files_are_decoded_by_many_tasks(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "READ_BYTES", 400)
    docs = spark.createDataFrame([(k, f"some text number {k} " * 20) for k in range(60)], "doc_id long, text string")
    manifest = token_files.write_tokens(docs, scratch_dir(spark, "t"), shard_tokens=200)
    back = token_files.read_tokens(manifest).select("doc_id", F.spark_partition_id().alias("task")).collect()
    assert manifest.count() > 12 and len(back) == 60
    assert len({r["task"] for r in back}) >= 8


def test_rows_of_one_id_have_one_layout(spark, tokenizer):
    rows = [(7 if k % 3 else None, f"text {k % 11} {'x' * (k % 5)}") for k in range(60)] + [(7, None), (7, "")]
    found = set()
    for parts in (1, 4, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        back = token_files.token_files(spark, docs, scratch_dir(spark, "t"), shard_tokens=40).collect()
        found.add(tuple(sorted(((r["start"], r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in back), key=lambda r: (r[0], str(r)))))
    assert len(found) == 1


def test_a_second_attempt_leaves_one_complete_file(tmp_path):
    store = token_files.fs.LocalFileSystem()
    final = str(tmp_path / "part.tok")
    for data in (b"same", b"same", b"longer bytes"):
        partial = str(tmp_path / "_partial")
        with store.open_output_stream(partial) as out:
            out.write(data)
        token_files._place(store, partial, final, len(data))
        assert store.open_input_stream(final).read() == data
        assert [f.base_name for f in store.get_file_info(token_files.fs.FileSelector(str(tmp_path)))] == ["part.tok"]


def test_tables_of_small_and_of_large_ids_agree(monkeypatch):
    ids = np.random.default_rng(3).integers(0, 900, 5000).astype("<u4")
    dense = rans.Table.of(ids)
    places = dense.places(ids)
    monkeypatch.setattr(rans, "DENSE", 0)
    searched = rans.Table.of(ids)
    assert (dense.symbols == searched.symbols).all() and (dense.shares == searched.shares).all()
    assert (places == searched.places(ids)).all()
