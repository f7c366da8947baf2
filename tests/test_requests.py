import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from filingloom.operators import requests as rq
from filingloom.operators import safety
from filingloom.session import scratch_dir
from filingloom.streaming import limits

from conftest import SF_DIR

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def make_requests(seed, n=600, clients=3, spread=4000.0):
    """A hot client owns most rows; some times coincide."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        client = "hot" if rng.random() < 0.6 else f"c{rng.randrange(clients)}"
        rows.append((client, i, T0 + timedelta(seconds=round(rng.uniform(0, spread), rng.choice([0, 3])))))
    return rows


def assert_sliding(got, rows, limit, window):
    """Every window holds at most ``limit`` accepted requests, and a rejected one sees it full."""
    span = timedelta(seconds=window)
    times = {i: (client, ts) for client, i, ts in rows}
    assert sorted(r.event_id for r in got) == sorted(times)
    accepted = defaultdict(list)
    for r in got:
        if r.allowed:
            accepted[r.client].append((times[r.event_id][1], r.event_id))
    for hits in accepted.values():
        hits.sort()
    for r in got:
        client, ts = times[r.event_id]
        inside = [h for h in accepted[client] if ts - span < h[0] and h <= (ts, r.event_id)]
        assert len(inside) <= limit
        assert r.allowed == ((ts, r.event_id) in inside)
        assert r.allowed or len(inside) == limit
        assert r.remaining == (limit - len(inside) if r.allowed else 0)
        assert r.reset_seconds == (inside[0][0] + span - ts) // timedelta(seconds=1) + 1


@pytest.mark.parametrize(
    "seed, limit, window, pieces, per_task",
    [(1, 3, 60, 1, 0), (2, 5, 60, 2, 200), (3, 1, 30, 1, 200), (4, 8, 60, 64, 10**6), (5, 2, 7, 1, 0)],
)
def test_sliding_limit_holds_in_every_window(spark, seed, limit, window, pieces, per_task):
    rows = make_requests(seed)
    df = spark.createDataFrame(rows, "client string, event_id long, ts timestamp")
    got = rq.sliding_rate_limit(df, limit, window, pieces, per_task).collect()
    assert_sliding(got, rows, limit, window)


def assert_fixed(got, rows, limit, window):
    """Within a client and window the hits are 1..n in time order; the counter lives from the first."""
    times = {i: (client, ts) for client, i, ts in rows}
    groups = defaultdict(list)
    for r in got:
        client, ts = times[r.event_id]
        assert r.window_no == int(ts.timestamp() // window)
        groups[client, r.window_no].append((ts, r.event_id, r))
    assert sum(map(len, groups.values())) == len(rows)
    for group in groups.values():
        group.sort(key=lambda g: g[:2])
        assert [r.hit_no for *_, r in group] == list(range(1, len(group) + 1))
        for ts, _, r in group:
            left = window - (ts - group[0][0]).total_seconds()
            assert r.allowed == (r.hit_no <= limit) and r.remaining == max(0, limit - r.hit_no)
            assert r.reset_seconds == (int(left + 0.5) or window)


def test_fixed_limit_numbers_each_window(spark):
    rows = make_requests(9)
    df = spark.createDataFrame(rows, "client string, event_id long, ts timestamp")
    assert_fixed(rq.fixed_window_limit(df, 2, 60).collect(), rows, 2, 60)


def test_requests_without_client_share_a_budget(spark):
    rows = [(None if i % 2 else "a", i, T0 + timedelta(seconds=i)) for i in range(40)]
    df = spark.createDataFrame(rows, "client string, event_id long, ts timestamp")
    assert_fixed(rq.fixed_window_limit(df, 2, 60).collect(), rows, 2, 60)
    for per_task in (10**6, 5):
        assert_sliding(rq.sliding_rate_limit(df, 3, 10, 1, per_task).collect(), rows, 3, 10)
    timed = df.selectExpr("client", "true AS ok", "CAST(event_id AS double) AS latency_s")
    found = {r.client: r.p50_latency_s for r in rq.latency_percentiles(timed, ["client"]).collect()}
    assert found == {"a": 18.0, None: 19.0}


def write_batches(spark, rows, n, shuffled=False):
    """One file per future micro-batch, in time order or not."""
    path = scratch_dir(spark, "stream-in")
    ordered = sorted(rows, key=lambda r: (r[2], r[1]))
    if shuffled:
        random.Random(n).shuffle(ordered)
    step = -(-len(ordered) // n)
    for k in range(n):
        part = spark.createDataFrame(ordered[k * step : (k + 1) * step], "client string, event_id long, ts timestamp")
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("client string, event_id long, ts timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    return stream


def drain(df, spark, name):
    q = (
        df.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", scratch_dir(spark, "stream-cp")).start()
    )
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


def run_budget(spark, arriving, judge, per_trigger=None):
    """Verdicts and late rows of rounds of requests; the query starts anew for each round."""
    path, out, state = (scratch_dir(spark, f"budget-{k}") for k in "abc")
    schema = "client string, event_id long, ts timestamp"
    end = [(None, None, T0 + timedelta(days=9000))]
    for rows in [*arriving, end]:
        df = spark.createDataFrame(rows, schema)
        df.repartition(per_trigger * 4 if per_trigger and len(rows) > 1 else 1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema)
        if per_trigger:
            stream = stream.option("maxFilesPerTrigger", per_trigger)
        judged = judge(stream.parquet(path))
        limits.start_budget(judged, out, state, availableNow=True).awaitTermination(300)
    verdicts, late = limits.read_budget(spark, out, judged)
    return verdicts.collect(), {r.event_id for r in late.collect()}


def in_rounds(rows, jitter, n):
    rnd = random.Random(n)
    arrived = sorted(rows, key=lambda r: r[2].timestamp() + rnd.random() * jitter)
    step = -(-len(rows) // n)
    return [arrived[k : k + step] for k in range(0, len(arrived), step)]


def test_streams_judge_requests_that_arrive_out_of_order(spark):
    rows = make_requests(21, n=160, spread=900.0)
    rows += [(None, 1000 + i, T0 + timedelta(seconds=40 * i)) for i in range(20)]
    got, late = run_budget(spark, in_rounds(rows, 100, 3), lambda s: limits.sliding_limit_stream(s, "101 seconds", 3, 60))
    assert_sliding(got, rows, 3, 60)
    assert not late
    got, late = run_budget(spark, in_rounds(rows, 100, 2), lambda s: limits.fixed_limit_stream(s, "101 seconds", 2, 60))
    assert_fixed(got, rows, 2, 60)
    assert not late


def test_late_requests_are_told_apart(spark):
    rows = make_requests(22, n=90, spread=3000.0)
    arriving = in_rounds(rows, 3000, 2)
    got, late = run_budget(spark, arriving, lambda s: limits.sliding_limit_stream(s, "5 seconds", 3, 60))
    mark = max(t for _, _, t in arriving[0]) - timedelta(seconds=5)
    assert late == {i for _, i, t in arriving[1] if t <= mark} and late
    assert_sliding(got, [r for r in rows if r[1] not in late], 3, 60)


def test_many_shuffled_files_in_one_lateness(spark):
    """Two hundred files in any order, fifty at a time."""
    rows = make_requests(23, n=400, spread=900.0)
    random.Random(2).shuffle(rows)
    got, late = run_budget(spark, [rows], lambda s: limits.fixed_limit_stream(s, "20 minutes", 2, 60), per_trigger=50)
    assert_fixed(got, rows, 2, 60)
    assert not late


def test_state_does_not_grow_with_the_age_of_a_stream(spark):
    """Once the watermark has passed, neither requests nor hits are kept."""
    path, out, state = (scratch_dir(spark, f"aged-{k}") for k in "abc")
    schema = "client string, event_id long, ts timestamp"
    sizes = []
    for day in range(4):
        rows = [(f"c{k % 5}", 100 * day + k, T0 + timedelta(days=day, seconds=7 * k)) for k in range(40)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        judged = limits.sliding_limit_stream(spark.readStream.schema(schema).parquet(path), "1 minute", 3, 60)
        query = limits.start_budget(judged, out, state, availableNow=True)
        query.awaitTermination(300)
        sizes.append([p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress][-1])
    assert max(sizes[1:]) <= sizes[0] + 5


def test_many_clients_share_calls_to_the_state_store(spark):
    """The entries of a state follow the buckets, not the clients."""
    rows = [(f"c{k}", k, T0 + timedelta(seconds=k % 50)) for k in range(600)]
    path, out, state = (scratch_dir(spark, f"shared-{k}") for k in "abc")
    schema = "client string, event_id long, ts timestamp"
    for part in (rows, [(None, None, T0 + timedelta(days=9000))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        judged = limits.fixed_limit_stream(spark.readStream.schema(schema).parquet(path), "1 hour", 2, 60)
        query = limits.start_budget(judged, out, state, availableNow=True)
        query.awaitTermination(300)
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) < 600
    verdicts, late = limits.read_budget(spark, out, judged)
    assert_fixed(verdicts.collect(), rows, 2, 60)
    assert not late.count()


def test_window_counts_stream_closes_windows(spark):
    rows = [("a", i, T0 + timedelta(seconds=10 * i)) for i in range(8)] + [("a", 99, T0 + timedelta(hours=2)), ("a", 100, T0 + timedelta(hours=4))]
    stream = write_batches(spark, rows, 5)
    got = drain(limits.window_counts_stream(stream, 60, "10 minutes", limit=5), spark, "counts_out").collect()
    first = {r.window_start.replace(tzinfo=None): (r.requests, r.over_limit) for r in got}
    assert first[datetime(2024, 1, 1, 0, 0)] == (6, 1)
    assert first[datetime(2024, 1, 1, 0, 1)] == (2, 0)


def test_request_log_stream_keeps_sizes_only(spark):
    src = scratch_dir(spark, "log-in")
    schema = "request_id string, method string, path string, status_code int, latency_s double, client_host string, user_agent string, content_length string"
    spark.createDataFrame([("r1", "POST", "/v1", 200, 0.0123456, "h", None, "12"), ("r2", "GET", "/v1", 500, 1.0, "h", "ua", "")], schema).write.parquet(src)
    out = scratch_dir(spark, "log-out")
    q = limits.write_request_log(spark.readStream.schema(schema).parquet(src), out, scratch_dir(spark, "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = {r.request_id: r for r in spark.read.parquet(out).collect()}
    assert (rows["r1"].latency_ms, rows["r1"].input_chars) == (12.35, 12)
    assert rows["r2"].input_chars is None


def test_percentiles_and_summary(spark):
    rows = [("a", True, float(i), 10) for i in range(1, 79)] + [("a", False, 500.0, 7), ("b", False, 1.0, 1), ("c", True, 2.0, None)]
    df = spark.createDataFrame(rows, "k string, ok boolean, latency_s double, tokens long")
    got = {r.k: r for r in rq.latency_percentiles(df, ["k"]).collect()}
    # 0.95 * 78 = 74.1 -> rank 74; 0.5 * 78 = 39; 0.99 * 78 = 77.22 -> 77
    assert tuple(got["a"])[1:] == (39.0, 74.0, 77.0)
    assert tuple(got["b"])[1:] == (0.0, 0.0, 0.0)
    assert tuple(got["c"])[1:] == (2.0, 2.0, 2.0)
    total = {r.k: r for r in rq.request_summary(df, ["k"], F.lit(10.0)).collect()}
    assert (total["a"].num_requests, total["a"].failed_requests, total["a"].avg_latency_s) == (79, 1, 39.5)
    assert total["a"].approx_tokens_per_second == 78.0
    assert (total["b"].avg_latency_s, total["b"].approx_tokens_per_second) == (0.0, 0.0)


def test_identities(one):
    both = lambda k, a: rq.client_pseudonym(rq.api_key(k, a), F.lit("1.2.3.4"))
    import hashlib

    def digest(key):
        return "key:" + hashlib.sha256(key.encode()).hexdigest()[:16]

    assert one(both, "secret", "Bearer x") == digest("secret")
    assert one(both, "", "bearer  tok ") == digest("tok")
    assert one(both, "  ", "Bearer x") == "ip:1.2.3.4"
    assert one(both, "", "Basic x") == "ip:1.2.3.4"
    assert one(lambda k: rq.client_pseudonym(k, F.lit(None).cast("string")), "") == "ip:unknown"


@pytest.mark.parametrize(
    "value, real",
    [
        ("abcdef123456", True), ("short1", False), ("your-key-1234", False), ("process1234", False), ("a.b.c12345", False),
        ("$SECRET1234", False), ("MY_TOKEN_NAME", False), ("MY_TOKEN_1234", True), ("onlyletters", False),
        ("x" * 24, False), ("onlyletterswithoutdigitsabc", True), ('"abcdef123456"', True),
    ],
)
def test_secret_values(one, value, real):
    assert one(safety.looks_like_secret, value) is real


def test_path_policy(one):
    assert one(safety.path_policy, "checkpoints/run/model.PT") == ["model_weights", "checkpoint_file"]
    assert one(safety.path_policy, "data/raw/x/.gitkeep") == []
    assert one(safety.path_policy, ".env") == ["env_file"]
    assert one(safety.path_policy, "src/.bin") == []


def test_marker_audit(spark):
    df = spark.createDataFrame([("# A\n# B", False), ("# A TODO", True), ("  ", False)], "t string, flagged boolean")
    rows = safety.required_marker_audit(df, "t", ["# A", "# B"], ["TODO"], "flagged", "mock").collect()
    assert [r.passed for r in rows] == [True, False, False]
    assert rows[1].missing_markers == ["# B"] and rows[1].forbidden_markers == ["TODO"] and rows[1].label_missing
