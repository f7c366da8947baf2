"""Spelling variants: words one edit apart, found with FM-index search schemes.

Of two words with one inserted, deleted or replaced code point the edit lies in one half of
the shorter word, so they share its first half as a beginning or its second half as an end.
Words are dealt out by these halves; a part of the vocabulary that fits a task is indexed
there. Each half reaches to a delimiter of the indexed text, so the index of the text serves
the searches that match the second half and extend to the left, and the index of the
reversed words those that match the first half and extend to the right: no search turns
around. A search keeps an interval of suffix ranks, is exact over the half, and allows one
error on the way over the other half to the delimiter. All searches of a part advance side
by side in numpy.

A pair that shares both halves counts for the first only, so counts of near words just add
up and no list of pairs is ever written.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.llm.common import LOWER, Rows, arrow_schema, raw_bytes, staged, tidy

MIN_LENGTH, MIN_COUNT = 7, 2
#: a form is at least so many times as frequent as its variant
RATIO = 10
#: characters indexed together, about; words with one half beyond that are indexed in blocks
SHARD_CHARS = 400_000
#: searches that advance side by side, and the interval up to which its rows are listed
SEARCHES, LISTED = 4_096, 64
#: distinct words that a task adds up before it hands them on
HELD_WORDS = 200_000

_WORD = re.compile("[a-zÀ-ÿ]+")
_COUNTS = "word string, n long"


class Drops:
    """Rewrites one in ``every`` runs of letters of a document: one of its letters is left out."""

    def __init__(self, every: int):
        self.every = every

    def __call__(self, key: int | None, runs: Counter) -> Iterator[tuple[str, int]]:
        seed = zlib.crc32(f"{key}:".encode())
        for run, n in runs.items():
            h = zlib.crc32(run.encode(), seed)
            if key is not None and h % self.every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            yield run, n


def _counts(rewrite: Drops | None, min_length: int):
    schema = arrow_schema(_COUNTS)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def take() -> Iterator[pa.RecordBatch]:
            out = Rows(schema)
            for word, n in held.items():
                out.add(word, n, weight=len(word))
                if out.full():
                    yield from out.take()
            yield from out.take()
            held.clear()

        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1))):
                runs = Counter(_WORD.findall(raw.translate(LOWER).decode()))
                for word, n in rewrite(key, runs) if rewrite else runs.items():
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield from take()
        yield from take()

    return run


def word_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    rewrite: Drops | None = None,
) -> DataFrame:
    """``word`` and ``n`` of all words of whole texts that are long and frequent enough.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. A null text
    has none. Rows that repeat count each; ids only matter to ``rewrite``, which leaves
    rows without id as they are. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long"), text_col)
    counted = rows.mapInArrow(_counts(rewrite, min_length), _COUNTS)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# --- the index of a part of the vocabulary


class Index:
    """The FM-index of words, sorted and distinct, with a delimiter around each.

    The delimiter in front of word ``j`` has rank ``j``; symbols are numbers from 1.
    """

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, alphabet: int):
        count = len(sizes)
        self.rows = rows = len(symbols) + count + 1
        text = np.zeros(rows, np.int64)
        starts = np.cumsum(sizes + 1) - sizes
        inside = np.ones(rows, bool)
        inside[np.append(starts - 1, rows - 1)] = False
        text[inside] = symbols
        rank = np.empty(rows, np.int64)
        rank[inside] = text[inside] + count
        rank[~inside] = np.arange(count + 1)
        suffixes, reach = None, 1
        while suffixes is None:
            after = np.zeros(rows, np.int64)
            after[: max(0, rows - reach)] = rank[reach:] + 1
            keys = rank * (rows + alphabet + 2) + after
            order = np.argsort(keys, kind="stable")
            new = np.append(False, np.diff(keys[order]) != 0)
            rank[order] = np.cumsum(new)
            if rank[order[-1]] == rows - 1:
                suffixes = order
            reach *= 2
        before = text[suffixes - 1]
        before[suffixes == 0] = -1
        self.before = before
        # places of each symbol, ascending: a rank query is one binary search
        places = np.argsort(before, kind="stable")[1:]
        self.places = before[places] * (rows + 1) + places
        symbol = np.arange(alphabet + 2)
        self.first = np.searchsorted(self.places, symbol * (rows + 1))
        self.block = np.cumsum(np.append(0, np.bincount(text, minlength=alphabet + 2)))[: alphabet + 2]

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Where the suffixes that ``symbol`` precedes begin, of those from ``row`` on."""
        return self.block[symbol] + np.searchsorted(self.places, symbol * (self.rows + 1) + row) - self.first[symbol]

    def following(self, low: np.ndarray, high: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
        """Interval and symbol for every symbol but the delimiter that may precede an interval."""
        size = high - low
        few = np.flatnonzero(size <= LISTED)
        which = np.repeat(few, size[few])
        row = np.arange(len(which)) - np.repeat(np.cumsum(size[few]) - size[few], size[few]) + low[which]
        listed = np.unique(which * (alphabet + 2) + np.maximum(self.before[row], 0))
        many = np.flatnonzero(size > LISTED)
        tried = (many[:, None] * (alphabet + 2) + np.arange(1, alphabet + 1)).ravel()
        both = np.concatenate([listed, tried])
        which, symbol = both // (alphabet + 2), both % (alphabet + 2)
        return which[symbol > 0], symbol[symbol > 0]


def near(
    index: Index, alphabet: int, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, exact: np.ndarray, longer: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word of the index) of words one edit apart.

    A query's last ``exact`` symbols match as they are. In front of them one symbol is
    missing from the query or another one, or if it is the ``longer`` word one too many.
    """
    query = np.arange(len(starts))
    low, high = np.zeros(len(query), np.int64), np.full(len(query), index.block[1])
    step = 0
    while True:
        on = np.flatnonzero(exact[query] > step)
        if not len(on):
            break
        symbol = symbols[starts[query[on]] + sizes[query[on]] - 1 - step]
        low[on], high[on] = index.step(symbol, low[on]), index.step(symbol, high[on])
        alive = high > low
        query, low, high = query[alive], low[alive], high[alive]
        step += 1
    place = sizes[query] - exact[query] - 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    # states that have made their error: query, next place, interval
    spent = [np.zeros(0, np.int64)] * 4
    while len(query) or len(spent[0]):
        new = []
        if len(query):
            extra = longer[query] & (place >= 0)
            new.append((query[extra], place[extra] - 1, low[extra], high[extra]))
            short = np.flatnonzero(~longer[query])
            which, symbol = index.following(low[short], high[short], alphabet)
            which = short[which]
            to_low, to_high = index.step(symbol, low[which]), index.step(symbol, high[which])
            real = to_high > to_low
            which, symbol, to_low, to_high = which[real], symbol[real], to_low[real], to_high[real]
            new.append((query[which], place[which], to_low, to_high))
            other = (place[which] >= 0) & (symbol != symbols[starts[query[which]] + np.maximum(place[which], 0)])
            new.append((query[which][other], place[which][other] - 1, to_low[other], to_high[other]))
            on = place >= 0
            query, place, low, high = query[on], place[on], low[on], high[on]
            symbol = symbols[starts[query] + place]
            low, high = index.step(symbol, low), index.step(symbol, high)
            on = high > low
            query, place, low, high = query[on], place[on] - 1, low[on], high[on]
        done = spent[1] < 0
        if done.any():
            delimiter = np.zeros(int(done.sum()), np.int64)
            at, upto = index.step(delimiter, spent[2][done]), index.step(delimiter, spent[3][done])
            found.append((spent[0][done][upto > at], at[upto > at]))
        q, p, a, b = (s[~done] for s in spent)
        if len(q):
            symbol = symbols[starts[q] + p]
            a, b = index.step(symbol, a), index.step(symbol, b)
            on = b > a
            q, p, a, b = q[on], p[on] - 1, a[on], b[on]
        spent = [np.concatenate(c) for c in zip((q, p, a, b), *new)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    queries, words = (np.concatenate(c) for c in zip(*found))
    count = len(index.before)
    both = np.unique(queries * count + words)
    return both // count, both % count


_TASK = "shard int, side int, unit long, word string, n long, base int, indexed boolean"
_NEAR = "word string, near long, best_n long, best string"


def _search(schema: pa.Schema):
    def settle(side: int, rows: list[tuple]) -> Iterator[tuple]:
        backward = -1 if side == 0 else 1
        counts = {word[::backward]: n for word, n, _, indexed in rows if indexed}
        words = sorted(counts)
        asked = [word[::backward] for word, *_ in rows]
        if len(words) + len(asked) < 3:
            return
        points = np.frombuffer("".join(words + asked).encode("utf-32-le"), "<u4")
        letters, symbols = np.unique(points, return_inverse=True)
        symbols = symbols.astype(np.int64) + 1
        lengths = np.array([len(w) for w in words], np.int64)
        total = int(lengths.sum())
        index = Index(symbols[:total], lengths, len(letters))
        n = np.array([counts[w] for w in words], np.int64)
        # the order of the words as they are written
        rank = np.empty(len(words), np.int64)
        rank[np.array(sorted(range(len(words)), key=lambda j: words[j][::backward]), np.int64)] = np.arange(len(words))
        sizes = np.array([len(w) for w in asked], np.int64)
        starts = total + np.cumsum(sizes) - sizes
        base = np.array([r[2] for r in rows], np.int64)
        exact = base // 2 if side == 0 else base - base // 2
        for at in range(0, len(rows), SEARCHES):
            part = slice(at, at + SEARCHES)
            query, word = near(index, len(letters), symbols, starts[part], sizes[part], exact[part], (sizes > base)[part])
            query = query + at
            if side:
                # pairs with the same first half have been found there
                new = np.array(
                    [words[j][: b // 2] != asked[i][: b // 2] for i, j, b in zip(query.tolist(), word.tolist(), base[query].tolist())],
                    bool,
                )
                query, word = query[new], word[new]
            if not len(query):
                continue
            order = np.lexsort((rank[word], -n[word], query))
            query, word = query[order], word[order]
            first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
            for i, j, many in zip(query[first].tolist(), word[first].tolist(), np.diff(np.append(first, len(query))).tolist()):
                yield rows[i][0], many, int(n[j]), words[j][::backward]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, rows = Rows(schema), None, []

        def close() -> Iterator[pa.RecordBatch]:
            for row in settle(at[1], rows):
                out.add(*row, weight=len(row[0]) + len(row[3]))
                if out.full():
                    yield from out.take()

        for batch in batches:
            for shard, side, unit, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if (shard, side, unit) != at:
                    if rows:
                        yield from close()
                    at, rows = (shard, side, unit), []
                rows.append(tuple(row))
        if rows:
            yield from close()
        yield from out.take()

    return run


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """For distinct ``word, n``: the words with a near one, how many, and the most frequent of those.

    ``word``, ``near``, ``best_n``, ``best``; of equally frequent near words the smallest in
    code-point order is the best. Words shorter than ``min_length`` are not allowed for.
    """
    length = F.length("word")
    homes = F.array(
        *[F.struct(F.lit(side).alias("side"), (length - less).cast("int").alias("base")) for side in (0, 1) for less in (0, 1)]
    )
    rows = words.select("word", "n", F.explode(homes).alias("home")).select("word", "n", "home.*")
    rows = rows.where(F.col("base") >= min_length)
    half = F.floor(F.col("base") / 2).cast("int")
    part = F.when(F.col("side") == 0, F.left("word", half)).otherwise(F.right("word", F.col("base") - half))
    rows = rows.withColumns({"family": F.xxhash64("side", "base", part), "chars": F.length("word") + 1})
    # families of one have no near words; the others are cut into blocks that fit a task
    families = rows.groupBy("family").agg(F.count("*").alias("members"), F.sum("chars").alias("in_family"))
    families = families.where("members > 1").withColumn("blocks", F.ceil(F.col("in_family") / shard_chars).cast("int"))
    families = staged(families.select("family", "blocks", "in_family"), "spelling-families")
    size = families.agg(F.sum(F.col("in_family") * F.col("blocks"))).first()[0] or 0
    shards = max(1, -(-size // shard_chars))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    rows = rows.join(families, "family")
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        F.pmod(F.xxhash64("family", "block"), F.lit(shards)).cast("int").alias("shard"),
        "side",
        F.when(F.col("blocks") > 1, F.xxhash64("family", "block")).otherwise(F.lit(0)).cast("long").alias("unit"),
        "word", "n", "base",
        (own == F.col("block")).alias("indexed"),
    )
    rows = rows.repartition(shards, "shard").sortWithinPartitions("shard", "side", "unit")
    found = rows.mapInArrow(_search(arrow_schema(_NEAR)), _NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    grouped = found.groupBy("word").agg(F.sum("near").alias("near"), best.alias("top"))
    return grouped.select("word", "near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``, by jumps of doubling length. Forms grow in frequency, so none returns."""
    now = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        both = staged(now.join(ahead, "root", "left"), "spelling-roots")
        now = both.select("word", F.coalesce("further", "root").alias("root"))
        if both.where("further IS NOT NULL").isEmpty():
            return now


def spelling_variants(
    words: DataFrame, ratio: int = RATIO, min_length: int = MIN_LENGTH, shard_chars: int = SHARD_CHARS
) -> DataFrame:
    """One row per word of ``word, n``: ``word, form, root, n, n_near, form_n``.

    Two words are near if one inserted, deleted or replaced code point tells them apart.
    ``form`` is the most frequent near word (of several the smallest in code-point order)
    if it is at least ``ratio`` times as frequent, else null; ``root`` is reached from form
    to form. Rows that repeat a word are added up; null words, and those shorter than
    ``min_length``, are left out; a null ``n`` counts nothing. An empty table gives an empty
    result; other columns are not read.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its variants")
    usable = words.where(F.length("word") >= min_length)
    distinct = usable.groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    distinct = staged(distinct, "spelling-words")
    found = near_words(distinct, min_length, shard_chars)
    judged = distinct.join(found, "word", "left")
    takes = F.col("best_n") >= F.greatest(F.col("n") * ratio, F.lit(1))
    judged = staged(
        judged.select(
            "word",
            F.when(takes, F.col("best")).alias("form"),
            "n",
            F.coalesce("near", F.lit(0)).cast("long").alias("n_near"),
            F.when(takes, F.col("best_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = _roots(judged.where("form IS NOT NULL"))
    out = judged.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
