"""Language identification by cross-parsing entropy.

Each language has the suffix automaton of a bounded sample of its labelled text. A text is
parsed greedily into the longest phrases that occur in that sample; the language that
needs the fewest phrases for the same letters wins. The transitions of all automata lie in
one pair of arrays, packed so that the rows of states fill each other's gaps; their size
follows the samples, not the alphabet. A missing transition ends the phrase and begins the
next, so many stretches of text and all languages advance side by side, one letter at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingloom.llm.common import Rows, arrow_schema, tidy, worker_cache

UNKNOWN = "und"
#: letters of labelled text that each language's automaton is built from
TRAIN_CHARS = 40_000
#: documents sampled per language at most; the letters are taken in equal stretches of them,
#: which are no shorter than this
TRAIN_DOCS = 400
LEAST_STRETCH = 100
#: drawn beyond twice the documents asked for, against the chance of the hash
SPARE_DOCS = 50
#: symbols parsed in one stretch; a phrase does not reach over its end
STRETCH = 512
#: symbols that advance side by side in one go
TOGETHER = 4_000_000
SLICE = 1 << 20

_SPACE, _OTHER = 0, 1


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in symbols:
        state = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = state
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if longest[p] + 1 == longest[q]:
                link[state] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return moves


@dataclass(frozen=True)
class Samples:
    """What a model is learned from: label and text, ascending by label."""

    texts: tuple[tuple[str, str], ...]


def packed(rows: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows in shared cells: ``base`` of each row, ``owner`` and ``value`` of each cell.

    Row ``r`` has ``value[base[r] + c]`` at ``c`` where ``owner[base[r] + c]`` is ``r``, and
    nothing elsewhere. Long rows are placed first, the search going on where the last one had
    to look far; rows of one then fill the gaps in order.
    """
    total = sum(map(len, rows))
    size = 2 * total + 2 * width + 2
    owner, value = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    base = np.zeros(len(rows), np.int32)
    free = bytearray(b"\x01") * size
    begin = gap = width
    for r in sorted(range(len(rows)), key=lambda r: -len(rows[r])):
        row = rows[r]
        if not row:
            continue
        columns = sorted(row)
        if len(columns) == 1:
            at = gap = free.index(1, gap)
        else:
            at, tried = free.index(1, begin), 0
            while not all(free[at - columns[0] + c] for c in columns):
                at, tried = free.index(1, at + 1), tried + 1
            if tried > 16:
                begin = at
        low = at - columns[0]
        if low + columns[-1] + 2 * width >= len(free):
            grown = len(free)
            free += b"\x01" * grown
            owner, value = np.append(owner, np.full(grown, -1, np.int32)), np.append(value, np.zeros(grown, np.int32))
        base[r] = low
        for c in columns:
            free[low + c] = 0
            owner[low + c], value[low + c] = r, row[c]
    used = int(base.max(initial=0)) + width + 1
    return base, owner[:used], value[:used]


class Model:
    def __init__(self, samples: Samples):
        self.labels = [label for label, _ in samples.texts]
        known = sorted({c for _, text in samples.texts for c in _single_lower(text) if c.isalpha()})
        self.codes = _code_table(known)
        width = len(known) + 2
        rows: list[dict[int, int]] = []
        starts = []
        self.restart = np.zeros((len(self.labels), width), np.int32)
        for k, (_, text) in enumerate(samples.texts):
            moves = automaton(self.symbols(text).tolist())
            begin = len(rows)
            starts.append(begin)
            # at the start, and behind a letter that the sample lacks, a phrase always begins
            self.restart[k] = begin
            for c, to in moves[0].items():
                self.restart[k, c] = begin + to
            rows.append({})
            rows += [{c: begin + to for c, to in row.items()} for row in moves[1:]]
        self.starts = np.array(starts, np.int32)
        self.base, self.owner, self.value = packed(rows, width)

    def symbols(self, text: str) -> np.ndarray:
        """Letters by code, lower-cased; any run of other characters is one space."""
        parts = []
        for low in range(0, len(text), SLICE):
            points = np.frombuffer(text[low : low + SLICE].encode("utf-32-le", "surrogatepass"), "<u4")
            parts.append(self.codes[points])
        codes = np.concatenate(parts) if parts else np.zeros(0, np.uint16)
        keep = codes != _SPACE
        keep[1:] |= codes[:-1] != _SPACE
        return codes[keep]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        pending: list[tuple[int, np.ndarray]] = []
        held = 0

        def settle() -> None:
            for i, phrases in zip((i for i, _ in pending), self._phrases([s for _, s in pending])):
                order = np.argsort(phrases, kind="stable")
                best = phrases[order[0]]
                labels[i] = self.labels[order[0]]
                scores[i] = float(1 - best / phrases[order[1]]) if len(order) > 1 else 1.0

        for i, text in enumerate(texts):
            if not text or not self.labels:
                continue
            symbols = self.symbols(text)
            if not symbols.any():
                continue
            pending.append((i, symbols))
            held += len(symbols)
            if held >= TOGETHER:
                settle()
                pending, held = [], 0
        if pending:
            settle()
        return labels, scores

    def _phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text under each language."""
        sizes = np.array([len(t) for t in texts])
        cuts = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(texts)), cuts)
        ends = np.cumsum(cuts)
        nth = np.arange(len(owner)) - np.repeat(ends - cuts, cuts)
        lengths = np.minimum(STRETCH, np.repeat(sizes, cuts) - nth * STRETCH)
        stream = np.concatenate(texts)
        begin = np.repeat(np.cumsum(sizes) - sizes, cuts) + nth * STRETCH
        order = np.argsort(-lengths, kind="stable")
        owner, lengths, begin = owner[order], lengths[order], begin[order]
        grid = np.zeros((STRETCH, len(owner)), np.int32)
        for step in range(STRETCH):
            n = int(np.searchsorted(-lengths, -step, "left"))
            grid[step, :n] = stream[begin[:n] + step]
        state = np.repeat(self.starts[:, None], len(owner), axis=1)
        phrases = np.zeros((len(self.labels), len(owner)), np.int64)
        for step in range(STRETCH):
            n = int(np.searchsorted(-lengths, -step, "left"))
            if not n:
                break
            now, symbol = state[:, :n], grid[step, :n]
            cell = self.base[now] + symbol
            ended = self.owner[cell] != now
            phrases[:, :n] += ended
            state[:, :n] = np.where(ended, self.restart[:, symbol], self.value[cell])
        return np.stack([np.bincount(owner, row, len(texts)) for row in phrases], axis=1)


def _single_lower(text: str) -> str:
    return "".join(low if len(low := c.lower()) == 1 else c for c in set(text))


def _code_table(known: list[str]) -> np.ndarray:
    codes = np.zeros(0x110000, np.uint16 if len(known) < 65_000 else np.uint32)
    place = {c: i + 2 for i, c in enumerate(known)}
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            codes[point] = place.get(low if len(low) == 1 else c, _OTHER)
    return codes


def _model(samples: Samples) -> Model:
    """The model of a Python worker, built from the samples on first use."""
    kept = worker_cache("language")
    if samples not in kept:
        kept.clear()
        kept[samples] = Model(samples)
    return kept[samples]


def learn(
    docs: DataFrame,
    text_col: str = "text",
    label_col: str = "lang",
    train_chars: int = TRAIN_CHARS,
    train_docs: int = TRAIN_DOCS,
    least_stretch: int = LEAST_STRETCH,
) -> Samples:
    """A bounded sample of labelled text: ``train_docs`` distinct texts a label, or all it has.

    Those with the least hashes are drawn, so copies count once, however many there are.
    Each gives a stretch of ``train_chars / train_docs`` letters (more where the label has
    fewer texts, ``least_stretch`` at least) from a place that its hash picks, or all of it.
    Rows without label or text teach nothing; without any labelled text, as in an empty
    table, nothing can be told apart and every prediction is ``und``. Other columns are not
    read.
    """
    rows = docs.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("content"))
    rows = rows.where("label IS NOT NULL AND content IS NOT NULL AND content != ''")
    rows = rows.withColumn("digest", F.xxhash64("content"))
    distinct = rows.select("label", "digest").distinct().groupBy("label").agg(F.count("*").alias("n"))
    counts = {r["label"]: r["n"] for r in distinct.collect()}
    if not counts:
        return Samples(())

    def of_label(value) -> Column:
        pairs = [F.lit(x) for label, n in counts.items() for x in (label, value(n))]
        return F.create_map(*pairs)[F.col("label")]

    # more than asked for, so that chance does not leave fewer; the driver keeps the least
    bound = of_label(lambda n: min(2**63 - 1, (2 * train_docs + SPARE_DOCS) * 2**64 // n - 2**63))
    stretch = of_label(lambda n: max(least_stretch, -(-train_chars // min(train_docs, n))))
    chosen = rows.where(F.col("digest") <= bound).withColumn("stretch", stretch)
    spare = F.greatest(F.length("content") - F.col("stretch"), F.lit(0))
    place = F.pmod(F.xxhash64("digest"), spare + 1).cast("int")
    chosen = chosen.select("label", "digest", F.substring("content", place + 1, F.col("stretch")).alias("content"))
    found = chosen.groupBy("label", "digest").agg(F.min("content").alias("content"))
    texts: dict[str, list[str]] = {}
    for r in found.orderBy("label", "digest").collect():
        drawn = texts.setdefault(r["label"], [])
        if len(drawn) < train_docs:
            drawn.append(r["content"])
    # stretches are no shorter than the least, so the sample may hold a little more
    most = max(train_chars, train_docs * least_stretch)
    return Samples(tuple((k, " ".join(v)[: most + len(v)]) for k, v in sorted(texts.items())))


def _identify(samples: Samples, schema: pa.Schema):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            labels, scores = _model(samples).predict(batch.column(1).to_pylist())
            for row in zip(batch.column(0).to_pylist(), labels, scores):
                out.add(*row)
            yield from out.take()

    return run


def identify(docs: DataFrame, samples: Samples, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``lang_pred``, ``score``.

    ``score`` is 1 minus the phrases of the winner over those of the runner-up, 0 to 1; of
    equal languages the first in order of their names wins, with score 0. Null texts and
    texts without a letter are ``und`` with score 0. Rows that repeat are judged alike; other
    columns are not read; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField(id_col, kind),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return docs.select(id_col, text_col).mapInArrow(_identify(samples, arrow_schema(schema)), schema)


def keep_identified(docs: DataFrame, samples: Samples, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text has a language."""
    at = docs.columns.index(text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, _ = _model(samples).predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array([label != UNKNOWN for label in labels]))

    return docs.mapInArrow(run, docs.schema)


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))
