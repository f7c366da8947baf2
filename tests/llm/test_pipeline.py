"""The pipeline and the registered queries, against brute force on the smallest tables."""

from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from filingloom.llm.common import staged
from oracle_compare import differences, duck

from conftest import SF_DIR
from .conftest import AWKWARD, wide
from .test_lines import plain as plain_lines
from .test_near import plain_components

NAMES = (
    "op1_best_fit_packing op2_embedding_near_dedup op3_exact_dedup op4_token_files op5_ngram_jaccard "
    "op6_source_mixing op7_secret_scan op8_line_dedup op9_language_id op10_quality_classifier "
    "op11_spelling_variants op12_document_fingerprints op13_periodic_runs pipeline"
).split()


def test_all_are_registered():
    assert [n for n in entry.queries() if n in NAMES] and set(NAMES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op7_secret_scan", "op8_line_dedup", "op11_spelling_variants", "op13_periodic_runs"])
def test_query_matches_sql(name, spark):
    con = duck(SF_DIR)
    assert differences(name, entry.queries()[name], entry.oracle_sql()[name], spark, con, SF_DIR) is None


def test_stages_on_given_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(staged(stage(spark, seen[-1], SF_DIR), name))
    start, spoken, cleaned, single, mixed, packed = seen
    texts = {r["doc_id"]: r["text"] for r in start.collect()}
    with_letters = {i for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    assert {r["doc_id"] for r in spoken.collect()} == with_letters
    rows = [(r["doc_id"], r["text"]) for r in spoken.collect()]
    assert sorted((r["doc_id"], r["text"]) for r in cleaned.collect()) == sorted((i, t) for i, _, _, t in plain_lines(rows, 10))
    assert all(r["n_chars"] == len(r["text"]) for r in cleaned.collect())
    rows = [(r["doc_id"], r["text"]) for r in cleaned.collect()]
    first = {i for i, _, c in plain_components(rows) if i == c}
    assert {r["doc_id"] for r in single.collect()} == first
    chosen = {r["doc_id"] for r in mixed.collect()}
    assert chosen <= first and mixed.count() == len(chosen)
    total = {r["doc_id"]: len((r["text"] or "").split()) for r in single.collect()}
    share, supply = Counter(), Counter()
    for r in single.collect():
        name = f"domain{int(r['source'][3:]) % 4}"
        supply[name] += total[r["doc_id"]]
        share[name] += total[r["doc_id"]] if r["doc_id"] in chosen else 0
    # the weights hold, up to a document of each leaf, and the scarcest domain gives all it has
    unit = min(supply[f"domain{d}"] / (4 - d) for d in range(4))
    longest = max(total.values())
    for d in range(4):
        assert (4 - d) * unit - 40 * longest < share[f"domain{d}"] <= (4 - d) * unit + 1
    for before, after in zip(seen[:4], seen[1:5]):
        assert before.columns == after.columns
    assert {r["doc_id"] for r in packed.collect()} == chosen


def test_run_equals_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF_DIR), name)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    a = Counter(tuple(r) for r in docs.select(*key).collect())
    b = Counter(tuple(r) for r in corpus_pipeline.run(spark, SF_DIR).select(*key).collect())
    assert a == b


def test_one_row_of_each_group_stays(spark):
    a, b, c = (" ".join(f"{k}{n}" for n in range(60)) for k in "abc")
    rows = [(1, a), (1, a), (7, a), (7, b), (9, f"{b} more"), (4, c), (4, c), (5, ""), (8, ""), (8, a)]
    kept = corpus_pipeline.drop_near_copies(spark, wide(spark, rows).repartition(3), SF_DIR).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, a), (4, c), (5, "")]


@pytest.mark.parametrize("rows", [AWKWARD, []])
def test_stages_bear_awkward_rows(spark, rows):
    docs = wide(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = staged(stage(spark, docs, SF_DIR), name)
        assert after.columns == docs.columns
        assert after.count() <= docs.count()
        assert name != "language" or after.count() == (9 if rows else 0)
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() >= docs.count()
