"""Request-log analytics: latency, budgets, validation, rollups."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom import constants as C
from filingloom.functions import text as tx
from filingloom.functions.numbers import exact_mean, round_half_even
from filingloom.operators.ranking import ordered_index, rank_values
from filingloom.session import cut_lineage, join_null_safe, ship_package

PERCENTILES = (50, 95, 99)


def nearest_rank(n: Column, pct: float) -> Column:
    """1-based rank of a percentile: rounded half to even, kept inside 1..n."""
    return F.greatest(
        F.least(F.rint(F.lit(pct / 100.0) * n).cast("long"), n), F.lit(1).cast("long")
    )


def latency_percentiles(
    requests: DataFrame, keys: Sequence[str], pcts: Sequence[int] = PERCENTILES
) -> DataFrame:
    """``p50_latency_s`` etc. of the successful requests per key, 0.0 if there are none.

    Needs (keys, ok, latency_s). Ranks are selected by counting, see
    :func:`rank_values`; no group is sorted or collected.
    """
    good = requests.where("ok").select(*keys, "latency_s")
    return _percentiles(requests.select(*keys).distinct(), good, keys, pcts, None)


def latency_counts(requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``latency_s, n`` per key: how often each latency occurred among the successful requests.

    The state behind exact percentiles. Counts of several days are added up by taking their
    rows together, so the log of a day can go once its counts are kept. A key without a
    successful request keeps a row without latency.
    """
    latency = F.when(F.col("ok"), F.col("latency_s"))
    return requests.groupBy(*keys, latency.alias("latency_s")).agg(F.count_if("ok").alias("n"))


def percentiles_of_counts(counts: DataFrame, keys: Sequence[str], pcts: Sequence[int] = PERCENTILES) -> DataFrame:
    """:func:`latency_percentiles` from the rows of :func:`latency_counts`, of any number of days."""
    known = counts.where("latency_s IS NOT NULL AND n > 0").select(*keys, "latency_s", "n")
    return _percentiles(counts.select(*keys).distinct(), known, keys, pcts, "n")


def _percentiles(
    everyone: DataFrame, good: DataFrame, keys: Sequence[str], pcts: Sequence[int], weight: str | None
) -> DataFrame:
    keys = list(keys)
    size = F.count("latency_s") if weight is None else F.sum(weight)
    sizes = good.groupBy(*keys).agg(size.alias("n"))
    wanted = F.array(
        *[
            F.struct(F.lit(p).alias("pct"), nearest_rank(F.col("n"), p).alias("rank"))
            for p in pcts
        ]
    )
    ranks = sizes.select(*keys, F.inline(wanted))
    # equal ranks of small groups are looked up once
    values = rank_values(good, keys, "latency_s", ranks.select(*keys, "rank").distinct(), weight=weight)
    found = join_null_safe(ranks, values, [*keys, "rank"]).groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("pct") == p, F.col("value"))).alias(f"_p{p}")
            for p in pcts
        ]
    )
    return join_null_safe(everyone, found, keys, "left").select(
        *keys,
        *[
            F.coalesce(round_half_even(F.col(f"_p{p}"), 4), F.lit(0.0)).alias(f"p{p}_latency_s")
            for p in pcts
        ],
    )


def request_summary(
    requests: DataFrame, keys: Sequence[str], wall_seconds: Column | None = None
) -> DataFrame:
    """Counts, mean, extremes, tokens and token rate per key.

    Needs (keys, ok, latency_s, tokens). ``wall_seconds`` is an aggregate
    expression for the elapsed time.
    """
    ok = F.col("ok")
    latency = F.when(ok, F.col("latency_s"))
    zero = F.lit(0.0)
    tokens = F.coalesce(F.sum(F.when(ok, F.col("tokens"))), F.lit(0))
    wall = F.lit(None).cast("double") if wall_seconds is None else wall_seconds
    out = requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_requests"),
        F.count_if(ok).alias("successful_requests"),
        F.count_if(~ok).alias("failed_requests"),
        F.coalesce(round_half_even(exact_mean(latency), 4), zero).alias("avg_latency_s"),
        F.coalesce(round_half_even(F.min(latency), 4), zero).alias("min_latency_s"),
        F.coalesce(round_half_even(F.max(latency), 4), zero).alias("max_latency_s"),
        tokens.cast("long").alias("total_completion_tokens"),
        wall.alias("_wall"),
    )
    rate = F.when(
        (F.col("_wall") > 0) & (F.col("total_completion_tokens") > 0),
        round_half_even(F.col("total_completion_tokens") / F.col("_wall"), 2),
    )
    return out.withColumn("approx_tokens_per_second", F.coalesce(rate, zero)).drop("_wall")


# ---- rolling budget --------------------------------------------------------

VERDICT_SCHEMA = (
    "client string, event_id bigint, ts_us bigint, allowed boolean, "
    "remaining bigint, reset_seconds bigint"
)
_STATE_SCHEMA = "client string, piece bigint, hits array<bigint>"
_OPENING = -(2**62)  # sorts before every real time


def _walk(times: np.ndarray, hits: deque, limit: int, window: int):
    """Runs ascending times of one client against the budget, updating ``hits``.

    Returns arrays (allowed, remaining, reset_seconds). While the budget is used
    up nothing can be admitted before the oldest hit expires, so that stretch is
    skipped with one binary search.
    """
    n = len(times)
    allowed = np.zeros(n, dtype=bool)
    remaining = np.zeros(n, dtype="int64")
    oldest = np.empty(n, dtype="int64")
    plain = times.tolist()
    i = 0
    while i < n:
        now = plain[i]
        while hits and hits[0] <= now - window:
            hits.popleft()
        if len(hits) < limit:
            hits.append(now)
            allowed[i], remaining[i], oldest[i] = True, limit - len(hits), hits[0]
            i += 1
        else:
            after = int(np.searchsorted(times, hits[0] + window))
            oldest[i:after] = hits[0]
            i = after
    reset = np.maximum(0, oldest + window - times) // 1_000_000 + 1
    return allowed, remaining, reset


def _replay(frames: Iterator[pd.DataFrame], limit: int, window: int, verdicts: bool):
    """Walks sorted rows, stretch by stretch; a row without event_id opens a stretch.

    Yields verdicts per frame, or the state at the end of every piece.
    """
    current, hits = None, deque()
    for frame in frames:
        clients, pieces = frame["client"].to_numpy(), frame["piece"].to_numpy()
        blocks, times = frame["block"].to_numpy(), frame["ts_us"].to_numpy()
        opening = frame["event_id"].to_numpy() < 0
        n = len(frame)
        allowed = np.zeros(n, dtype=bool)
        remaining = np.zeros(n, dtype="int64")
        reset = np.zeros(n, dtype="int64")
        turn = opening[1:] | opening[:-1] | (pieces[1:] != pieces[:-1])
        turn |= (blocks[1:] != blocks[:-1]) | (clients[1:] != clients[:-1])
        edges = [0, *(np.flatnonzero(turn) + 1).tolist(), n]
        ends = []
        for start, stop in zip(edges, edges[1:]):
            here = (clients[start], int(pieces[start]))
            if opening[start]:
                if current is not None:
                    ends.append((*current, list(hits)))
                hits = deque(int(h) for h in frame["hits"].iloc[start])
                current = None
                continue
            if current not in (None, here):
                ends.append((*current, list(hits)))
            current = here
            part = slice(start, stop)
            allowed[part], remaining[part], reset[part] = _walk(times[part], hits, limit, window)
        if not verdicts:
            if ends:
                yield pd.DataFrame(ends, columns=["client", "piece", "hits"])
            continue
        judged = frame[["client", "event_id", "ts_us"]].assign(
            allowed=allowed, remaining=remaining, reset_seconds=reset
        )
        yield judged[~opening]
    if current is not None and not verdicts:
        yield pd.DataFrame([(*current, list(hits))], columns=["client", "piece", "hits"])


def _run_stretches(
    events: DataFrame, openings: DataFrame, group: int, limit: int, window: int, verdicts: bool
) -> DataFrame:
    """Replays stretches of pieces from their opening states.

    A stretch is all of a client's pieces in one block of ``group`` pieces, from the
    opening piece on. Rows stream through sorted partitions; no stretch is held in
    memory.
    """
    block = F.floor(F.col("piece") / F.lit(group)).cast("long")
    opened = openings.select("client", "piece", "hits", block.alias("block"))
    starting = opened.select("client", "block", F.col("piece").alias("_from"))
    rows = (
        events.withColumn("block", block)
        .transform(join_null_safe, starting, ["client", "block"])
        .where(F.col("piece") >= F.col("_from"))
        .withColumn("hits", F.array().cast("array<bigint>"))
    )
    columns = ["client", "block", "piece", "event_id", "ts_us", "hits"]
    markers = opened.withColumns(
        {"event_id": F.lit(-1).cast("long"), "ts_us": F.lit(_OPENING)}
    )
    ordered = (
        markers.select(*columns)
        .unionByName(rows.select(*columns))
        .repartition("client", "block")
        .sortWithinPartitions("client", "block", "ts_us", "event_id")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _replay(frames, limit, window, verdicts)

    return ordered.mapInPandas(run, VERDICT_SCHEMA if verdicts else _STATE_SCHEMA)


def sliding_rate_limit(
    requests: DataFrame,
    limit: int = 60,
    window_seconds: int = C.WINDOW_SECONDS,
    windows_per_piece: int = 64,
    rows_per_task: int = 1_000_000,
) -> DataFrame:
    """Verdict of every request under a rolling per-client budget.

    Needs (client, event_id, ts); ties in time go by event_id. Requests without a client
    share one budget. A request without time has no verdict and is left out.
    The outcome of a request depends on earlier ones, so a client's timeline is a chain, walked in
    order. Clients with more than ``rows_per_task`` rows are cut into pieces that
    are walked in parallel, see :func:`_piece_starts`.
    """
    ship_package(requests.sparkSession)
    window = window_seconds * 1_000_000
    span = window * windows_per_piece
    none = F.array().cast("array<bigint>")
    events = requests.where("ts IS NOT NULL").select("client", "event_id", F.unix_micros("ts").alias("ts_us"))
    sizes = events.groupBy("client").agg(F.count(F.lit(1)).alias("_rows"))
    sizes = cut_lineage(sizes.withColumn("_hot", F.col("_rows") > rows_per_task), "limit-clients")
    hot = sizes.where("_hot").select("client", "_hot")
    starts = sizes.where("NOT _hot").select("client", F.lit(0).cast("long").alias("piece"), none.alias("hits"))
    pieced = F.floor(F.col("ts_us") / F.lit(span)).cast("long")
    if hot.isEmpty():
        events = events.withColumn("piece", F.lit(0).cast("long"))
    else:
        busy = join_null_safe(events, hot.select("client"), ["client"], "left_semi").withColumn("piece", pieced)
        starts = starts.unionByName(_piece_starts(busy, limit, window, span))
        events = join_null_safe(events, hot, ["client"], "left").withColumn(
            "piece", F.when(F.col("_hot"), pieced).otherwise(F.lit(0).cast("long"))
        )
    return _run_stretches(events, starts, 1, limit, window, verdicts=True).select(
        "client",
        "event_id",
        F.timestamp_micros("ts_us").alias("ts"),
        "allowed",
        "remaining",
        "reset_seconds",
    )


def _piece_starts(events: DataFrame, limit: int, window: int, span: int) -> DataFrame:
    """Exact start state (client, piece, hits) of every piece of ``span`` microseconds.

    A piece needs only the accepted hits of the last window of the piece before it.
    All pieces first run from an empty state, then those whose true start state
    turns out different run again, until none changes. Clients with pauses settle
    at once. A client that is always at its limit passes its phase on from piece to
    piece, so each round also joins more pieces to one stretch and the number of
    rounds stays logarithmic.
    """
    keys = ["client", "piece"]
    none = F.array().cast("array<bigint>")
    starts = cut_lineage(events.select(*keys).distinct().withColumn("hits", none), "limit-start")
    openings, ends, group = starts, None, 1
    while True:
        fresh = cut_lineage(
            _run_stretches(events, openings, group, limit, window, verdicts=False), "limit-fresh"
        )
        if ends is not None:
            fresh_and_old = fresh.unionByName(join_null_safe(ends, fresh.select(*keys), keys, "left_anti"))
            ends = cut_lineage(fresh_and_old, "limit-end")
        else:
            ends = fresh
        # the next piece starts at (piece + 1) * span; hits a window older have expired by then
        carried = ends.withColumn("_since", (F.col("piece") + 1) * span - window).select(
            "client",
            (F.col("piece") + 1).alias("piece"),
            F.filter("hits", lambda h: h > F.col("_since")).alias("_carried"),
        )
        # pieces inside a stretch were run from exactly the state that is carried to them
        inside = join_null_safe(fresh, openings.select(*keys), keys, "left_anti").select(*keys, F.lit(True).alias("_inside"))
        moved = join_null_safe(join_null_safe(starts, carried, keys, "left"), inside, keys, "left")
        moved = moved.withColumn("_new", F.coalesce("_carried", none))
        differs = F.col("_inside").isNull() & (F.col("_new") != F.col("hits"))
        moved = cut_lineage(
            moved.select(*keys, F.col("_new").alias("hits"), differs.alias("_changed")), "limit-start"
        )
        starts = moved.drop("_changed")
        changed = moved.where("_changed")
        if changed.isEmpty():
            return starts
        group *= 8
        first = changed.groupBy("client", F.floor(F.col("piece") / F.lit(group)).alias("_block"))
        openings = cut_lineage(
            first.agg(F.min("piece").alias("piece"), F.min_by("hits", "piece").alias("hits")).drop(
                "_block"
            ),
            "limit-open",
        )


def fixed_window_limit(
    requests: DataFrame, limit: int = 60, window_seconds: int = C.WINDOW_SECONDS
) -> DataFrame:
    """Verdict of every request under a per-client counter that restarts each window.

    The count is the row's position in its (client, window); windows are cut into
    64 time slices so that a crowded window is not ranked by one task. The counter lives
    for a window from the first hit in it: ``reset_seconds`` is what is left of that, in
    rounded seconds, or a whole window where nothing is left. Requests without a client
    share one counter; those without a time are left out.
    """
    window = window_seconds * 1_000_000
    micros = F.unix_micros("ts")
    number = F.floor(micros / F.lit(window)).cast("long")
    timed = requests.where("ts IS NOT NULL").withColumn("window_no", number)
    slice_no = F.floor((micros - F.col("window_no") * window) * 64 / F.lit(window)).cast("int")
    timed = timed.withColumn("_us", micros)
    ranked = ordered_index(
        timed, ["client", "window_no"], [F.col("ts"), F.col("event_id")], slice_no, "hit_no"
    )
    firsts = timed.groupBy("client", "window_no").agg(F.min("_us").alias("_first_us"))
    ranked = join_null_safe(ranked, firsts, ["client", "window_no"])
    left = F.col("_first_us") + window - F.col("_us")
    rounded = F.floor((left + 500_000) / 1_000_000).cast("long")
    reset = F.when(rounded > 0, rounded).otherwise(F.lit(window_seconds)).cast("long")
    return ranked.withColumns(
        {
            "allowed": F.col("hit_no") <= limit,
            "remaining": F.greatest(F.lit(limit) - F.col("hit_no"), F.lit(0)).cast("long"),
            "reset_seconds": reset,
        }
    ).drop("_us", "_first_us")


# ---- records, identities, validation ---------------------------------------


def request_log(df: DataFrame) -> DataFrame:
    """Shape of a logged request: sizes only, never text. Works on streams as well.

    Needs request_id, method, path, status_code, latency_s, client_host, user_agent
    and content_length (text, may be absent).
    """
    return df.select(
        "request_id",
        "method",
        "path",
        F.col("status_code").cast("long").alias("status_code"),
        round_half_even(F.col("latency_s") * 1000.0, 2).alias("latency_ms"),
        "client_host",
        "user_agent",
        F.nullif(F.col("content_length"), F.lit("")).try_cast("bigint").alias("input_chars"),
    )


def api_key(key_header: Column, authorization: Column) -> Column:
    """The key header if filled, else the token of a bearer header."""
    bearer = F.when(
        F.lower(authorization).startswith("bearer "),
        F.nullif(tx.strip(F.substring(authorization, 8, 1 << 30)), F.lit("")),
    )
    return F.when(F.coalesce(key_header, F.lit("")) != "", tx.strip(key_header)).otherwise(bearer)


def client_pseudonym(key: Column, host: Column) -> Column:
    """Opaque client id: a hash prefix of the key, else the host."""
    return F.when(
        F.coalesce(key, F.lit("")) != "",
        F.concat(F.lit("key:"), F.substring(F.sha2(key, 256), 1, 16)),
    ).otherwise(F.concat(F.lit("ip:"), F.coalesce(host, F.lit("unknown"))))


def request_errors(df: DataFrame) -> DataFrame:
    """Adds ``errors`` for the bounds of an analysis request.

    Needs question, filing_excerpt, task_type, max_tokens and temperature.
    """

    def text_rule(name: str, longest: int) -> list[Column]:
        c = F.col(name)
        return [
            F.when(c.isNull(), f"{name}: missing")
            .when(c == "", f"{name}: too short")
            .when(F.length(c) > longest, f"{name}: too long")
            .when(tx.is_blank(c), f"{name}: blank")
        ]

    def range_rule(name: str, low: float, high: float) -> Column:
        c = F.col(name)
        return F.when(c.isNull() | ~c.between(low, high), F.lit(f"{name}: out of range"))

    checks = [
        *text_rule("question", C.MAX_QUESTION_CHARS),
        *text_rule("filing_excerpt", C.MAX_EXCERPT_CHARS),
        F.when(
            F.col("task_type").isNotNull() & ~F.col("task_type").isin(*C.TASK_TYPES),
            F.lit("task_type: unknown"),
        ),
        range_rule("max_tokens", 1, C.MAX_NEW_TOKENS),
        range_rule("temperature", 0.0, C.MAX_TEMPERATURE),
    ]
    return df.withColumn("errors", F.filter(F.array(*checks), lambda e: e.isNotNull()))


def valid_requests(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") == 0).drop("errors")


def quarantined_requests(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("errors") > 0)


def status_rollup(
    checks: DataFrame, keys: Sequence[str], skipped: Sequence[str] = ()
) -> DataFrame:
    """Per key: number of checks, failures and whether all are fine.

    Needs (keys, check, ok). Checks named in ``skipped`` count as fine.
    """
    ok = F.coalesce("ok", F.lit(False))
    if skipped:
        ok = ok | F.col("check").isin(*skipped)
    return checks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(~ok).alias("failed"),
        F.bool_and(ok).alias("all_ok"),
    )
