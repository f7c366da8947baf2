"""Large banks of terms, looked up in one pass over each text.

A handful of terms is best tested by column functions, one search each. With thousands the
time of such a search is that of the text times the bank; an Aho-Corasick automaton of the
whole bank reads a text once, however many terms there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from filingloom.session import ship_package

#: bounds of a bank, which every worker holds
MAX_TERMS, MAX_CHARS = 1_000_000, 32 << 20
#: bytes of text in one result batch, about
BATCH_BYTES = 8 << 20

_built: dict[str, object] = {}


def _automaton(tag: str, broadcast):
    """The automaton of a broadcast bank, built once in each Python worker."""
    import ahocorasick

    if tag not in _built:
        found = ahocorasick.Automaton()
        for number, term in enumerate(broadcast.value):
            found.add_word(term, (number, len(term)))
        found.make_automaton()
        _built.clear()
        _built[tag] = found
    return _built[tag]


def bank_of(terms: DataFrame, column: str) -> list[str]:
    """The distinct terms of a table, sorted; more than the bounds are refused."""
    rows = terms.select(F.col(column).cast("string").alias("term")).where("term IS NOT NULL AND term != ''").distinct()
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("chars")).first()
    if size["n"] > MAX_TERMS or size["chars"] > MAX_CHARS:
        raise ValueError(f"a bank of {size['n']} terms and {size['chars']} characters is too large")
    return sorted(r["term"] for r in rows.collect())


def bank_hits(
    df: DataFrame, keys: Sequence[str], text: str, terms: Sequence[str], any_case: bool = True
) -> DataFrame:
    """(keys, n_hits, first_position, terms) of the texts that hold any term.

    ``terms`` lists the distinct terms found, sorted; ``n_hits`` counts all occurrences,
    overlapping ones too; ``first_position`` is the 1-based place of the first. With
    ``any_case`` texts and terms are compared in lower case. Empty terms are ignored.
    """
    spark = df.sparkSession
    ship_package(spark)
    bank = sorted({t.lower() if any_case else t for t in terms if t})
    if len(bank) > MAX_TERMS or sum(map(len, bank)) > MAX_CHARS:
        raise ValueError("the bank is too large")
    fields = [df.schema[k] for k in keys]
    fields += [
        T.StructField("n_hits", T.LongType()),
        T.StructField("first_position", T.LongType()),
        T.StructField("terms", T.ArrayType(T.StringType())),
    ]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)
    body = F.lower(text) if any_case else F.col(text)
    rows = df.select(*keys, body.alias("_body")).where("_body IS NOT NULL")
    if not bank:
        return spark.createDataFrame([], schema)
    shared, tag = spark.sparkContext.broadcast(bank), hashlib.sha256("\0".join(bank).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, names = _automaton(tag, shared), shared.value
        for batch in batches:
            kept, columns, held = [], [[], [], []], 0
            for place, body in enumerate(batch.column(len(keys))):
                first, count, seen = None, 0, set()
                for end, (number, size) in automaton.iter(body.as_py()):
                    count += 1
                    seen.add(number)
                    start = end - size + 2
                    first = start if first is None or start < first else first
                if count:
                    kept.append(place)
                    found = [names[k] for k in sorted(seen)]
                    for column, value in zip(columns, (count, first, found)):
                        column.append(value)
                    held += sum(map(len, found))
                if held >= BATCH_BYTES:
                    yield _table(batch, kept, columns)
                    kept, columns, held = [], [[], [], []], 0
            if kept:
                yield _table(batch, kept, columns)

    def _table(batch: pa.RecordBatch, kept: list[int], columns: list[list]) -> pa.RecordBatch:
        chosen = batch.take(pa.array(kept, pa.int64()))
        arrays = [chosen.column(k) for k in range(len(keys))]
        arrays += [pa.array(c, arrow.field(len(keys) + k).type) for k, c in enumerate(columns)]
        return pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return rows.mapInArrow(run, schema)
