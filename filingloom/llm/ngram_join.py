"""Exact Jaccard self-join of shingle sets by universe partition and pigeonhole.

Sets are put into bands of size, so that two similar sets stand in one band or in
neighbouring ones. For each band the universe of shingles is hashed into segments. Two
sets of ``r <= s`` shingles with Jaccard 0.8 or more differ in at most ``(r + s) / 9``
shingles, so of one segment more than that, one is the same in both; a segment that also
counts when one shingle is missing makes up for two. Every set is indexed in its own band
under the hash of each segment's subset, and for a fixed share of the segments under all
subsets with one shingle deleted. A set probes its own band and the one below. Which
segments it probes is up to it, as long as their worth exceeds the bound: it leaves out
those that cost most (empty ones, those made of very frequent shingles only) and probes
deletions of cheap ones instead.

Probes and index entries travel packed, as arrays, and meet by hash. Within a bucket the
probes and entries are first compared with one leader; the links found join up most of the
bucket. Where a bucket still holds several components, sketches are compared block by
block inside a task: the cells in which two sketches differ are never more than the
shingles in which the sets do, so this leaves out only members that cannot be linked. The
others meet again with their shingles and are compared exactly. What a task has linked it
does not compare again, and it hands on only links that join two components, so a crowd of
like texts gives no more rows than it has members, whoever is linked to whom.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingloom.llm.common import Rows, arrow_schema, raw_bytes, remove, staged, tidy, write_scratch
from filingloom.llm.graph import components
from filingloom.llm.shingles import mixed, shingles

SHINGLE_WORDS = 5
#: similarity as a fraction of whole numbers: 100 * intersection >= 80 * union
PERCENT = 80
#: share of a band's segments with deletion neighbourhoods, and of segments beyond the bound
DELETION_SHARE = 0.04
SPARE_SHARE = 0.04
#: documents sampled to find very frequent shingles; these only steer the choice of segments
COST_SAMPLE = 2_000
COSTLY = 16
#: rows of a packed part, and the least number of parts
PART_ROWS = 400_000
MIN_PARTS = 256
#: compared with one leader by one task
CHUNK = 400
FLUSH_ROWS = 1_000_000
#: members of a bucket, and their shingles, that meet in one task; larger buckets are cut
#: into pairs of blocks
BLOCK, BLOCK_SHINGLES = 4_096, 2_000_000
#: bytes that a task should read, about
TASK_BYTES = 32 << 20
#: shingles whose frequency steers the choice of segments, at most
HEAVY = 20_000
#: bits of a class number; classes whose numbers collide get others
KEY_BITS = 62

_INDEX, _PROBE = 1, 2


@lru_cache(maxsize=8)
def bands(percent: int, most: int = 1 << 40) -> tuple[int, ...]:
    """The least size of each band: a set's partners are in its band and the next ones."""
    out, low = [1], 1
    while low < most:
        low = low * 100 // percent + 1
        out.append(low)
    return tuple(out)


def bound(r: int, s: int, percent: int) -> int:
    """The shingles in which similar sets of these sizes differ at most."""
    return (r + s) * (100 - percent) // (100 + percent)


@lru_cache(maxsize=256)
def layout(band: int, percent: int) -> tuple[int, int, int]:
    """Largest size of the band, its segments, and how many have deletion neighbourhoods."""
    top = bands(percent)[band + 1] - 1
    most = bound(top, top * 100 // percent, percent)
    spare = 1 + int(SPARE_SHARE * most)
    return top, most + 1 + spare, min(most + 1 + spare, 1 + int(DELETION_SHARE * most))


@lru_cache(maxsize=256)
def _salt(band: int, segments: int) -> np.ndarray:
    return mixed(np.arange(segments, dtype=np.uint64) + np.uint64(band << 40))


class Segments:
    """A set cut into the segments of a band."""

    def __init__(self, tokens: np.ndarray, value: np.ndarray, often: np.ndarray, band: int, percent: int):
        self.top, self.m, self.deletions = layout(band, percent)
        where = (tokens % np.uint64(self.m)).astype(np.int64)
        # small numbers are sorted digit by digit
        order = np.argsort(where.astype(np.uint16) if self.m < 1 << 16 else where, kind="stable")
        self.where, self.value = where[order], value[order]
        often = often[order]
        self.sizes = np.bincount(where, minlength=self.m)
        full = np.flatnonzero(self.sizes)
        starts = (np.cumsum(self.sizes) - self.sizes)[full]
        self.sums = np.zeros(self.m, np.uint64)
        self.cost = np.full(self.m, 1 << 60)
        self.light = np.zeros(self.m, np.int64)
        if len(full):
            self.sums[full] = np.add.reduceat(self.value, starts)
            self.cost[full] = np.minimum.reduceat(often, starts)
            self.light[full] = np.add.reduceat((often <= COSTLY).astype(np.int64), starts)
        self.salt = _salt(band, self.m)

    def whole(self) -> np.ndarray:
        return mixed(self.sums + self.salt)

    def without_one(self, segments: np.ndarray) -> np.ndarray:
        """Hashes of the subsets that lack one shingle, for the segments marked."""
        mine = segments[self.where]
        where = self.where[mine]
        return mixed(self.sums[where] - self.value[mine] + self.salt[where])

    def allocate(self, size: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Segments to probe, and those of them to probe with deletions too."""
        need = bound(min(size, self.top), size, percent) + 1
        spare = self.m - need
        order = np.argsort(-self.cost, kind="stable")
        probe = np.ones(self.m, bool)
        probe[order[:spare]] = False
        twice = np.zeros(self.m, bool)
        left = order[spare:]
        costly = left[self.cost[left] > COSTLY]
        if len(costly):
            d = slice(0, self.deletions)
            able = probe[d] & (self.cost[d] <= COSTLY) & (self.light[d] >= 2) & (self.sizes[d] <= 12)
            cheap = np.flatnonzero(able)[: len(costly)]
            probe[costly[: len(cheap)]] = False
            twice[cheap] = True
        return probe, twice


def signatures(tokens: np.ndarray, heavy: np.ndarray, heavy_count: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and roles under which a set is indexed and probes."""
    size = len(tokens)
    own = int(np.searchsorted(bands(percent), size, "right")) - 1
    often, value = np.ones(size, np.int64), mixed(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
        often = np.where(heavy[at] == tokens, heavy_count[at], 1)
    out, roles = [], []

    def add(hashes: np.ndarray, role) -> None:
        out.append(hashes)
        roles.append(np.full(len(hashes), role, np.uint8) if np.isscalar(role) else role)

    for band in (own, own - 1):
        if band < 0:
            continue
        cut = Segments(tokens, value, often, band, percent)
        probe, twice = cut.allocate(size, percent)
        if band == own:
            add(cut.whole(), np.where(probe, _INDEX | _PROBE, _INDEX).astype(np.uint8))
            indexed = np.arange(cut.m) < cut.deletions
            add(cut.without_one(indexed & ~twice), _INDEX)
            add(cut.without_one(twice), _INDEX | _PROBE)
        else:
            add(cut.whole()[probe], _PROBE)
            add(cut.without_one(twice), _PROBE)
    return np.concatenate(out), np.concatenate(roles)


# --- the sets of all documents


def sketch(tokens: np.ndarray) -> bytes:
    """Sums of hashes in as many cells as the largest power of two not above the set's size.

    Sketches of one set in half as many cells are the sums of the cells' pairs, so sets of
    unlike size can be compared in the cells of the smaller one.
    """
    if not len(tokens):
        return b""
    cells = 1 << (len(tokens).bit_length() - 1)
    where = (tokens & np.uint64(cells - 1)).astype(np.int64)
    worth = ((tokens >> np.uint64(40)) & np.uint64(0xFF)).astype(np.float64)
    return (np.bincount(where, worth, cells).astype(np.int64) & 0xFF).astype(np.uint8).tobytes()


def folded(cells: np.ndarray, n: int) -> np.ndarray:
    """A sketch in ``n`` cells."""
    while len(cells) > n:
        half = len(cells) // 2
        cells = cells[:half] + cells[half:]
    return cells


def _digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _tasks(size: int) -> int:
    return max(4, -(-size // TASK_BYTES))


@dataclass(frozen=True)
class Classes:
    """Numbers of sets, which travel in place of their documents' ids.

    A number is the beginning of the set's digest, with a mark above it. Where two digests
    begin alike, both have a small number without the mark instead.
    """

    bits: int = KEY_BITS
    renamed: tuple[bytes, ...] = ()

    def __call__(self, digest: bytes) -> int:
        if self.renamed:
            at = bisect_left(self.renamed, digest)
            if at < len(self.renamed) and self.renamed[at] == digest:
                return at
        return (1 << 62) | (int.from_bytes(digest[:8], "big") >> (64 - self.bits))

    def corrected(self, key: Column, digest: Column) -> Column:
        """Numbers given before the collisions were known."""
        for place, known in enumerate(self.renamed):
            key = F.when(digest == F.lit(known), F.lit(place).cast("long")).otherwise(key)
        return key


def _classes(sets: DataFrame, bits: int) -> Classes:
    """Numbers that tell all sets apart. Of 10^10 sets about five pairs begin alike."""
    digests = sets.where("key IS NOT NULL").groupBy("key").agg(F.min("digest").alias("least"), F.max("digest").alias("most"))
    twice = digests.where("least != most").select("key")
    found = sets.join(twice, "key", "left_semi").select("digest").distinct().collect()
    return Classes(bits, tuple(sorted(bytes(r["digest"]) for r in found)))


def _sets(schema: pa.Schema, words: int, sampled: float, number: Classes):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1))):
                tokens = shingles(raw, words)
                digest = _digest(tokens) if len(tokens) else None
                drawn = digest is not None and int.from_bytes(digest[8:12], "big") < sampled * (1 << 32)
                some = tokens[:20_000].tobytes() if drawn else None
                cells = sketch(tokens)
                own = None if digest is None else number(digest)
                out.add(key, len(tokens), own, digest, some, cells, weight=len(some or b"") + len(cells))
                if out.full():
                    yield from out.take()
        yield from out.take()

    return run


def _unpacked():
    schema = arrow_schema("token long")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, np.int64))], schema=schema)

    return run


def _heavy(sets: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles in most of the sampled sets (three at least), and about how many sets hold them."""
    drawn = sets.where("sample IS NOT NULL").groupBy("digest").agg(F.min("sample").alias("sample"))
    drawn, path = write_scratch(drawn, "shingle-sample")
    sampled = drawn.count()
    counts = drawn.select("sample").mapInArrow(_unpacked(), "token long").groupBy("token").agg(F.count("*").alias("n"))
    got = counts.where("n >= 3").orderBy(F.col("n").desc(), "token").limit(HEAVY).collect()
    remove(sets.sparkSession, path)
    tokens = np.array([r["token"] for r in got], np.int64).view(np.uint64)
    often = np.array([r["n"] for r in got], np.int64) * max(1, rows // max(1, sampled))
    order = np.argsort(tokens)
    return tokens[order], often[order]


# --- candidates

_PACKED = "part int, hashes binary, owners binary, roles binary, ids binary"
_PAIRS = "kind string, a long, b long, bucket long, role int"


def _pack(parts: int, words: int, percent: int, heavy: np.ndarray, heavy_count: np.ndarray, number: Classes):
    """One row per part: hashes, place of the owner in ``ids`` (of classes), roles. Copies in a task go once."""
    schema = arrow_schema(_PACKED)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        ids: list[int] = []
        hashes: list[np.ndarray] = []
        roles: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not ids:
                return
            sizes = [len(h) for h in hashes]
            owners = np.repeat(np.arange(len(ids), dtype=np.uint32), sizes)
            flat, role = np.concatenate(hashes), np.concatenate(roles)
            part = (flat >> np.uint64(32)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
            low = flat.astype(np.uint32)
            everyone = np.array(ids, np.int64)
            out = Rows(schema)
            for p in range(parts):
                own = order[cuts[p] : cuts[p + 1]]
                if len(own):
                    # only the owners that occur, so that a part carries no more than its own
                    used, place = np.unique(owners[own], return_inverse=True)
                    out.add(
                        p,
                        low[own].tobytes(),
                        place.astype(np.uint32).tobytes(),
                        role[own].tobytes(),
                        everyone[used].tobytes(),
                        weight=17 * len(own),
                    )
                    if out.full():
                        yield from out.take()
            yield from out.take()
            ids.clear(), hashes.clear(), roles.clear()
            held = 0

        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1))):
                tokens = shingles(raw, words)
                if key is None or not len(tokens):
                    continue
                digest = _digest(tokens)
                if digest in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(digest)
                found, role = signatures(tokens, heavy, heavy_count, percent)
                ids.append(number(digest))
                hashes.append(found)
                roles.append(role)
                held += len(found)
                if held >= FLUSH_ROWS:
                    yield from flush()
        yield from flush()

    return run


def _meet():
    """Rows of a part to ``pair`` rows (leader, member) and ``open`` rows (members of larger buckets)."""
    schema = arrow_schema(_PAIRS)

    def settle(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        low = np.concatenate([np.frombuffer(r[1], np.uint32) for r in rows])
        ids = np.concatenate([np.frombuffer(r[4], np.int64)[np.frombuffer(r[2], np.uint32)] for r in rows])
        role = np.concatenate([np.frombuffer(r[3], np.uint8) for r in rows])
        order = np.lexsort((ids, low))
        low, ids, role = low[order], ids[order], role[order]
        new = np.append(True, low[1:] != low[:-1])
        bucket = np.cumsum(new) - 1
        n = int(bucket[-1]) + 1
        probes = np.bincount(bucket, (role & _PROBE) > 0, n)
        entries = np.bincount(bucket, (role & _INDEX) > 0, n)
        sizes = np.bincount(bucket, minlength=n)
        live = ((probes > 0) & (entries > 0) & (sizes > 1))[bucket]
        low, ids, role, bucket = low[live], ids[live], role[live], bucket[live]
        if not len(ids):
            return
        # the leader is the least class that probes
        first = np.full(n, np.iinfo(np.int64).max)
        is_probe = (role & _PROBE) > 0
        np.minimum.at(first, bucket[is_probe], ids[is_probe])
        leader = first[bucket]
        other = ids != leader
        pairs = np.unique(
            np.stack([np.minimum(leader, ids)[other], np.maximum(leader, ids)[other]], axis=1), axis=0
        )
        yield from table("pair", pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int32))
        # with one probe, or two sets, the leader has met all
        larger = (probes[bucket] > 1) & (sizes[bucket] > 2)
        name = (np.int64(part) << np.int64(32)) | bucket[larger]
        yield from table("open", ids[larger], ids[larger], name, role[larger].astype(np.int32))

    def table(kind: str, a, b, bucket, role) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(a), 100_000):
            piece = slice(at, at + 100_000)
            columns = [pa.array([kind] * len(a[piece]), pa.string())]
            columns += [pa.array(np.ascontiguousarray(c[piece])) for c in (a, b, bucket, role)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[0] != part:
                    if rows:
                        yield from settle(part, rows)
                    part, rows = row[0], []
                rows.append(row)
        if rows:
            yield from settle(part, rows)

    return run


_MEMBERS = "bucket long, i int, j int, role int, key long, component long, n long, block int"


def _by_block(settle, columns: str):
    """Rows sorted by bucket and blocks, handed to ``settle`` group by group."""
    schema = arrow_schema(columns)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, group = Rows(schema), None, []

        def close() -> Iterator[pa.RecordBatch]:
            if len(group) > 1:
                for row in settle(at, group):
                    out.add(*row)
            if out.full():
                yield from out.take()

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:3] != at:
                    yield from close()
                    at, group = row[:3], []
                group.append(row[3:])
        yield from close()
        yield from out.take()

    return run


class _Block:
    """Members of a bucket (of one or two blocks of it) and which of them may be linked."""

    def __init__(self, at: tuple, group: list[tuple], sketches: list[bytes], percent: int):
        self.role, self.key, self.component, self.n, self.block = (np.array([r[k] for r in group], np.int64) for k in range(5))
        raw = [np.frombuffer(x, np.uint8) for x in sketches]
        width = min(map(len, raw))
        self.cells = np.stack([folded(x, width) for x in raw])
        self.entries = np.flatnonzero(self.role & _INDEX)
        self.probes = np.flatnonzero(self.role & _PROBE).tolist()
        self.apart, self.percent = at[1] != at[2], percent

    def partners(self, p: int, label: np.ndarray) -> np.ndarray:
        """Entries of other labels than the probe's whose sketches allow a link."""
        them, n = self.entries, self.n
        fit = label[them] != label[p]
        if self.apart:
            fit &= self.block[them] != self.block[p]
        them = them[fit]
        them = them[np.minimum(n[them], n[p]) * 100 >= self.percent * np.maximum(n[them], n[p])]
        unlike = (self.cells[them] != self.cells[p]).sum(axis=1)
        return them[unlike <= (n[them] + n[p]) * (100 - self.percent) // (100 + self.percent)]


def _promising(percent: int):
    """Of the rows with sketches those that may be linked to a member of another component."""

    def settle(at: tuple, group: list[tuple]) -> Iterator[tuple]:
        block = _Block(at, group, [r[5] for r in group], percent)
        wanted = np.zeros(len(group), bool)
        for p in block.probes:
            them = block.partners(p, block.component)
            wanted[them] = True
            wanted[p] |= len(them) > 0
        for k in np.flatnonzero(wanted).tolist():
            yield *at, *group[k][:5]

    return _by_block(settle, _MEMBERS)


def similar(mine: np.ndarray, other: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(mine, other, assume_unique=True))
    return 100 * common >= percent * (len(mine) + len(other) - common)


def _joining(percent: int):
    """Of the rows with shingles the links that join two components, as pairs of components."""

    def settle(at: tuple, group: list[tuple]) -> Iterator[tuple[int, int]]:
        tokens = [np.frombuffer(r[5], np.uint64) for r in group]
        block = _Block(at, group, [sketch(t) for t in tokens], percent)
        label = block.component.copy()
        for p in block.probes:
            for q in block.partners(p, label).tolist():
                if label[p] != label[q] and similar(tokens[p], tokens[q], percent):
                    yield int(block.component[p]), int(block.component[q])
                    label[label == label[q]] = label[p]

    return _by_block(settle, "a long, b long")


def _shingles_of(words: int, number: Classes):
    """Rows (class, id, text) to the shingles of the class; an id's texts of other classes are passed over."""
    schema = arrow_schema("key long, shingles binary")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for batch in batches:
            for need, raw in zip(batch.column(0).to_pylist(), raw_bytes(batch.column(1))):
                tokens = shingles(raw, words)
                if len(tokens) and number(_digest(tokens)) == need:
                    out.add(need, tokens.tobytes(), weight=8 * len(tokens))
                    if out.full():
                        yield from out.take()
        yield from out.take()

    return run


def _further_links(
    members: DataFrame, sets: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int, number: Classes
) -> DataFrame:
    """Pairs of components linked by a probe and an entry of one bucket that holds several components.

    ``members`` has (bucket, role, key, rep, component, n). Buckets with the same members in
    the same roles are settled once.
    """
    same = [F.bit_xor(F.xxhash64("key", "role")).alias("x"), F.bit_xor(F.xxhash64("role", "key")).alias("y")]
    buckets = members.groupBy("bucket").agg(
        F.count("*").alias("members"), F.sum("n").alias("in_bucket"), *same,
        F.min("component").alias("least"), F.max("component").alias("most"),
    )
    buckets = buckets.where("least != most").groupBy("members", "in_bucket", "x", "y").agg(F.min("bucket").alias("bucket"))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("in_bucket") / BLOCK_SHINGLES)).cast("int")
    buckets = staged(buckets.select("bucket", "in_bucket", blocks.alias("blocks")), "shingle-open")
    size = buckets.agg(F.sum(F.col("in_bucket") * F.col("blocks"))).first()[0] or 0
    rows = members.join(buckets.select("bucket", "blocks"), "bucket")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")})
    sketches = sets.where("key IS NOT NULL").select(F.col("id").alias("s_id"), F.col("key").alias("s_key"), "sketch")
    rows = rows.join(sketches, (F.col("key") == F.col("s_key")) & (F.col("rep") == F.col("s_id")))
    columns = ["bucket", "i", "j", "role", "key", "component", "n", "block"]
    rows = rows.select(*columns, "sketch").repartition(_tasks(size), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    left = staged(rows.mapInArrow(_promising(percent), _MEMBERS), "shingle-promising")

    needed = staged(left.select("key").distinct().join(classes.select("key", "rep"), "key"), "shingle-needed")
    texts = docs.join(needed, F.col("id") == F.col("rep")).select("key", "content")
    found = texts.mapInArrow(_shingles_of(words, number), "key long, shingles binary")
    found = staged(found.groupBy("key").agg(F.min("shingles").alias("shingles")), "shingle-arrays")
    size = left.agg(F.sum(8 * F.col("n"))).first()[0] or 0
    rows = left.join(found, "key").select(*columns, "shingles")
    rows = rows.repartition(_tasks(size), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return staged(rows.mapInArrow(_joining(percent), "a long, b long").distinct(), "shingle-links")


# --- verification


def _compare(schema: pa.Schema, words: int, percent: int, number: Classes):
    """Rows sorted by leader and chunk, the leader first, to pairs that are linked.

    An id may have texts of other classes than the one needed; these are passed over.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, own, own_id = Rows(schema), None, None, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:5]]
            for leader, chunk, member, need, key, raw in zip(*columns, raw_bytes(batch.column(5))):
                if (leader, chunk) != at:
                    at, own = (leader, chunk), None
                if not member and own is not None:
                    continue
                tokens = shingles(raw, words)
                if not len(tokens) or number(_digest(tokens)) != need:
                    continue
                if not member:
                    own, own_id = tokens, key
                elif own is not None and similar(own, tokens, percent):
                    out.add(own_id, key)
                if out.full():
                    yield from out.take()
        yield from out.take()

    return run


def _linked(
    pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int, number: Classes, bytes_each: int
) -> DataFrame:
    """Of the distinct pairs of classes ``a, b`` those whose sets are similar enough, as pairs of their least ids."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    member = pairs.join(degree, "a").select(
        F.col("b").alias("need"), F.col("a").alias("leader"), F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("member")
    )
    leader = degree.select(
        F.col("a").alias("need"), F.col("a").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("member")
    )
    needed = member.unionAll(leader).join(classes, F.col("need") == F.col("key"))
    rows = docs.join(needed, F.col("id") == F.col("rep"))
    rows = rows.select("leader", "chunk", "member", "need", "id", "content")
    rows = rows.repartition(_tasks(2 * bytes_each * pairs.count()), "leader", "chunk")
    rows = rows.sortWithinPartitions("leader", "chunk", "member")
    schema = "a long, b long"
    return rows.mapInArrow(_compare(arrow_schema(schema), words, percent, number), schema).where("a != b").distinct()


def similar_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    key_bits: int = KEY_BITS,
) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``.

    Sets are those of ``shingles``; two link when 100 times their intersection is at least
    ``percent`` times their union. ``component_id`` is the least id reachable by links. A
    document without words, or with a null text, has an empty set and links with nothing.
    Rows with equal sets are one class, compared once. Rows that repeat an id count as one
    document that has the links of each; a row without id gets the component of its class,
    null if no row of it has an id. Other columns are not read. Empty tables give empty
    results.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("content"))
    total = rows.count()
    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("key", T.LongType()),
            T.StructField("digest", T.BinaryType()),
            T.StructField("sample", T.BinaryType()),
            T.StructField("sketch", T.BinaryType()),
        ]
    )
    share = min(1.0, COST_SAMPLE / max(1, total))
    number = Classes(key_bits)
    sets = staged(rows.mapInArrow(_sets(arrow_schema(schema), words, share, number), schema), "shingle-sets")
    number = _classes(sets, key_bits)
    if number.renamed:
        sets = sets.withColumn("key", number.corrected(F.col("key"), F.col("digest")))
    heavy, heavy_count = _heavy(sets, total)
    size = sets.agg(F.sum("n")).first()[0] or 0
    each = 8 * size // max(1, total)
    parts = max(MIN_PARTS, -(-size // (2 * PART_ROWS)))

    packed = rows.mapInArrow(_pack(parts, words, percent, heavy, heavy_count, number), _PACKED)
    packed = packed.repartition(min(parts, _tasks(9 * size)), "part").sortWithinPartitions("part")
    met, met_path = write_scratch(packed.mapInArrow(_meet(), _PAIRS), "shingle-buckets")

    owned = sets.where("key IS NOT NULL AND id IS NOT NULL")
    classes = staged(owned.groupBy("key").agg(F.min("id").alias("rep"), F.min("n").alias("n")), "shingle-classes")
    # ids with several texts join up the classes of these
    named = owned.groupBy("id").agg(F.min("key").alias("least"), F.max("key").alias("most"))
    several = owned.select("id", "key").join(named.where("least != most").select("id"), "id").distinct()
    shared = several.join(classes, "key").selectExpr("id AS a", "rep AS b").where("a != b")
    shared = staged(shared, "shingle-ids")

    first, pairs_path = write_scratch(met.where("kind = 'pair'").select("a", "b").distinct(), "shingle-pairs")
    links = staged(_linked(first, rows, classes, words, percent, number, each).unionAll(shared), "shingle-links")
    joined = components(links)

    # what is left: probes and entries of one bucket whose components still differ
    members = met.where("kind = 'open'").select(F.col("a").alias("key"), "bucket", "role")
    members = members.join(classes, "key").join(joined, F.col("rep") == F.col("node"), "left").select(
        "bucket", "role", "key", "rep", F.coalesce("component", "rep").alias("component"), "n"
    )
    members, members_path = write_scratch(members.distinct(), "shingle-members")
    more = _further_links(members, sets, rows, classes, words, percent, number)
    for path in (met_path, pairs_path, members_path):
        remove(docs.sparkSession, path)

    edges = links.unionAll(more)
    final = components(edges).withColumnRenamed("node", "c_node")
    class_component = classes.join(final, F.col("rep") == F.col("c_node"), "left").select(
        F.col("key").alias("c_key"), F.coalesce("component", "rep").alias("component_id")
    )
    # a text without words has the class of another text of its id, if there is one
    blank = sets.where("key IS NULL").select("id", "n")
    blank = blank.join(named.select(F.col("id").alias("n_id"), F.col("least").alias("key")), F.col("id") == F.col("n_id"), "left")
    every = sets.where("key IS NOT NULL").select("id", "n", "key").unionAll(blank.select("id", "n", "key"))
    alone = F.when(F.col("key").isNull(), F.col("id"))
    return every.join(class_component, F.col("key") == F.col("c_key"), "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", alone).alias("component_id")
    )
