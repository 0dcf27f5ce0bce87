"""Exact admission against a plain simulation, on dense, hot and tied traffic."""

import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crivo.operators import requests as Q
from crivo.session import scratch_path
from crivo.streaming import streams

BASE = 1_704_067_200 * Q.SECOND
ENDPOINTS = ("/api/v1/predict", "/api/v1/predict/batch", "/api/v1/auth/login", "/api/v1/metrics")


def simulate(events, limits):
    """Requests one by one in time order, as the service decides them."""
    recorded, until, out = defaultdict(list), {}, {}
    for event_id, us, ip, endpoint in sorted(events, key=lambda e: (e[1], e[0])):
        if ip in limits.whitelist:
            out[event_id] = ("whitelist", None)
            continue
        if us <= until.get(ip, -1):
            out[event_id] = ("blocked", None)
            continue
        most, window, block = limits.match(endpoint)
        count = sum(t > us - window * Q.SECOND for t in recorded[ip, endpoint])
        if count >= most:
            until[ip] = us + block * 60 * Q.SECOND
            out[event_id] = ("limit", 0)
            continue
        recorded[ip, endpoint].append(us)
        out[event_id] = ("admitted", max(0, most - count - 1))
    return out


def traffic(n, span, seed, hot=0.0, step=1):
    draw = random.Random(seed)
    return [
        (i, BASE + draw.randrange(0, span // step) * step,
         "10.0.0.1" if draw.random() < hot else f"10.0.1.{draw.randrange(4)}",
         draw.choice(ENDPOINTS))
        for i in range(n)
    ]


def table(spark, events):
    df = spark.createDataFrame(events, "event_id bigint, us bigint, ip string, endpoint string")
    return df.select("event_id", F.timestamp_micros("us").alias("ts"), "ip", "endpoint")


SMALL = Q.Limits(
    rules=(("/api/v1/predict", 6, 60, 2), ("/api/v1/predict/batch", 2, 60, 3),
           ("/api/v1/auth", 3, 90, 5)),
    default=(8, 30, 2), whitelist=("10.0.1.3",),
)


@pytest.mark.parametrize(
    "events",
    [
        traffic(1500, 3600 * Q.SECOND, 1),
        traffic(1500, 3600 * Q.SECOND, 2, hot=0.8),
        traffic(800, 1200 * Q.SECOND, 3, hot=0.5, step=5 * Q.SECOND),
    ],
    ids=["spread", "hot", "tied"],
)
def test_admission_equals_simulation(spark, events):
    df = table(spark, events)
    expected = simulate(events, SMALL)
    for ranges in (1, 5, 40):
        blocks = Q.block_intervals(df, SMALL, ranges)
        got = {
            r.event_id: (r.decision, r.remaining)
            for r in Q.admit_requests(df, SMALL, blocks).collect()
        }
        assert got == expected
    assert {d for d, _ in expected.values()} == {"admitted", "limit", "blocked", "whitelist"}


def test_steady_attack(spark):
    """One address at a constant rate: every entry state leads to another block time."""
    events = [(i, BASE + i * 700_000, "10.0.0.9", ENDPOINTS[i % 2]) for i in range(6000)]
    df = table(spark, events)
    blocks = Q.block_intervals(df, SMALL, 300)  # two levels above the chunks
    got = {r.event_id: (r.decision, r.remaining) for r in Q.admit_requests(df, SMALL, blocks).collect()}
    assert got == simulate(events, SMALL)


def test_step_functions_compose(spark):
    """Chunks in a row act as their composition does on every entry state."""
    draw = random.Random(4)
    for _ in range(60):
        chunks, at = [], 0
        for _ in range(draw.randint(2, 5)):
            n = draw.randint(1, 6)
            us = np.array(sorted(draw.randrange(at, at + 50) for _ in range(n)))
            since = np.sort(us - np.array([draw.randrange(1, 12) for _ in range(n)]))
            chunks.append(Q._steps_of(since, us + 15))
            at += 50
        whole = chunks[0]
        for steps in chunks[1:]:
            whole = Q._composed(whole, steps)
        states = np.array([Q.NEVER, *range(-20, at + 40)])
        one_by_one = states
        for steps in chunks:
            one_by_one = Q._applied(steps, one_by_one)
        assert (Q._applied(whole, states) == one_by_one).all()


def test_a_hot_address_spreads_over_ranges_of_equal_size(spark):
    """Half the candidates of one address: no chunk has over twice the median of the candidates."""
    events = traffic(6000, 3600 * Q.SECOND, 21, hot=0.6)
    order = ("ip", "us", "event_id")
    rows = Q.violation_candidates(table(spark, events), SMALL)
    parts = rows.repartitionByRange(12, *order).groupBy(F.spark_partition_id().alias("chunk")).count()
    counts = sorted(r["count"] for r in parts.collect())
    assert len(counts) == 12 and counts[-1] <= 2 * counts[len(counts) // 2]
    hot = rows.filter("ip = '10.0.0.1'").count()
    assert hot > 0.5 * sum(counts)


def test_look_back_reads_no_more_rows_than_the_limit(spark):
    """A dense address: remaining counts come from a bounded number of rows, not from a range of time."""
    events = traffic(3000, 600 * Q.SECOND, 23, hot=0.9, step=Q.SECOND // 4)
    decided = Q.admit_requests(table(spark, events), SMALL)
    frames = decided._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame" not in frames and "collect_list" in frames
    assert {r.event_id: (r.decision, r.remaining) for r in decided.collect()} == simulate(events, SMALL)


def test_standard_limits_reject_the_request_over_sixty(spark):
    events = [(i, BASE + i * 100_000, "10.0.0.2", "/api/v1/predict") for i in range(65)]
    got = {r.event_id: r.decision for r in Q.admit_requests(table(spark, events)).collect()}
    assert [got[i] for i in (59, 60, 61, 64)] == ["admitted", "limit", "blocked", "blocked"]


def test_blocks_shorter_than_windows(spark):
    """Requests recorded before a block can count after it; these limits are decided in order."""
    limits = Q.Limits(rules=(("/api/v1/predict", 4, 600, 2),), default=(6, 300, 1), whitelist=())
    assert not limits.blocks_outlast_windows and SMALL.blocks_outlast_windows
    events = traffic(1200, 3600 * Q.SECOND, 5, hot=0.6)
    df, expected = table(spark, events), simulate(events, limits)
    got = {r.event_id: (r.decision, r.remaining) for r in Q.admit_requests(df, limits).collect()}
    assert got == expected
    blocks = {r.event_id for r in Q.block_intervals(df, limits).collect()}
    assert blocks == {i for i, (d, _) in expected.items() if d == "limit"}


def test_old_requests_leave_the_window(spark):
    events = [(0, BASE, "ip", "/x"), (1, BASE + 7200 * Q.SECOND, "ip", "/x")]
    got = Q.sliding_request_counts(table(spark, events), 60).collect()
    assert {r.event_id: r.n_in_window for r in got} == {0: 1, 1: 1}


def test_window_is_open_on_the_left(spark):
    events = [(0, BASE, "ip", "/x"), (1, BASE + 60 * Q.SECOND, "ip", "/x"),
              (2, BASE + 60 * Q.SECOND + 1, "ip", "/x"), (3, BASE + 119_999_999, "ip", "/x")]
    got = Q.sliding_request_counts(table(spark, events), 60).collect()
    assert {r.event_id: r.n_in_window for r in got} == {0: 1, 1: 1, 2: 2, 3: 3}


def test_slices_do_not_change_counts(spark):
    events = traffic(2000, 4 * 3600 * Q.SECOND, 7, hot=0.7)
    got = Q.sliding_request_counts(table(spark, events), 45).collect()
    times = defaultdict(list)
    for _, us, ip, endpoint in events:
        times[ip, endpoint].append(us)
    expected = {
        i: sum(us - 45 * Q.SECOND < t <= us for t in times[ip, endpoint])
        for i, us, ip, endpoint in events
    }
    assert {r.event_id: r.n_in_window for r in got} == expected


def test_dense_seconds_of_one_key_and_rows_without_key_or_time(spark):
    """Half of the rows in a few seconds of one key, ties, null keys, clashing column names."""
    draw = random.Random(3)
    events = [
        (i, None if i % 97 == 0 else BASE + draw.randrange(5 * Q.SECOND) // 250_000 * 250_000, "hot" if i % 2 else None, "/x")
        for i in range(1500)
    ] + [(2000 + i, BASE + draw.randrange(20 * Q.SECOND), "hot", "/x") for i in range(500)]
    df = spark.createDataFrame(events, "event_id long, us long, ip string, endpoint string")
    df = df.select("event_id", "ip", "endpoint", F.timestamp_micros("us").alias("ts"), F.lit(7).alias("second"))
    got = Q.sliding_request_counts(df, 2).collect()
    times = defaultdict(list)
    for _, us, ip, _ in events:
        if us is not None:
            times[ip].append(us)
    expected = {
        i: sum(us - 2 * Q.SECOND < t <= us for t in times[ip]) for i, us, ip, _ in events if us is not None
    }
    assert {r.event_id: r.n_in_window for r in got} == expected
    assert {r.second for r in got} == {7} and len(got) == len(expected)


def test_longest_pattern_or_first_match(spark):
    df = spark.createDataFrame([("/api/v1/predict/batch",)], "endpoint string")
    assert Q.endpoint_limits(df).first().max_requests == 10
    assert Q.endpoint_limits(df, Q.Limits(first_match=True)).first().max_requests == 60


def test_admission_stream_in_many_batches(spark):
    """State carried over micro-batches gives the batch answer."""
    events = sorted(traffic(900, 1800 * Q.SECOND, 11, hot=0.5), key=lambda e: e[1])
    source = scratch_path(spark, "in")
    for i in range(0, len(events), 300):
        table(spark, events[i:i + 300]).coalesce(1).write.mode("append").parquet(source)
    stream = streams.read_files(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
    out = scratch_path(spark, "out")
    streams.admission_stream(stream, SMALL).writeStream.format("parquet").option(
        "checkpointLocation", scratch_path(spark, "cp")
    ).trigger(availableNow=True).start(out).awaitTermination()
    got = {r.event_id: (r.decision, r.remaining) for r in spark.read.parquet(out).collect()}
    assert got == simulate(events, SMALL)


def test_idle_state_is_dropped(spark):
    """An address that stays away longer than its block and the retention leaves no state."""
    source, late = scratch_path(spark, "in"), 6 * 3600 * Q.SECOND
    for event_id, us, ip in ((0, BASE, "a"), (1, BASE + late, "b"), (2, BASE + late + 1, "b")):
        table(spark, [(event_id, us, ip, "/x")]).coalesce(1).write.mode("append").parquet(source)
    stream = streams.read_files(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
    query = streams.admission_stream(stream, SMALL).writeStream.format("noop").option(
        "checkpointLocation", scratch_path(spark, "cp")
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
    assert max(sizes) == 2 and sizes[-1] == 1


def test_late_requests_go_to_a_table_of_their_own(spark):
    """Decided and late requests are the input, row by row; late ones change no decision."""
    events = traffic(900, 4 * 3600 * Q.SECOND, 13, hot=0.4)
    events += [(2000 + k, BASE + k, "10.0.7.7", "/x") for k in range(3)]  # an address only seen behind the watermark
    arrivals = [[e for e in events if e[0] % 4 == k or e[0] >= 2000 and k == 2] for k in range(3)]
    arrivals = [[e for e in a if e[0] < 2000 or k == 2] for k, a in enumerate(arrivals)]
    source, path, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "cp"))
    known, late, decided = {}, set(), []
    top = 0
    for k, arrival in enumerate(arrivals):
        table(spark, arrival).coalesce(1).write.mode("append").parquet(source)
        stream = streams.read_files(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
        decisions = streams.admission_stream(stream, SMALL, "90 minutes")
        streams.admission_sink(decisions, path, checkpoint, True).awaitTermination()  # a restart each time
        behind = top // 1000 * 1000 - 5400 * Q.SECOND
        for event in sorted(arrival, key=lambda e: (e[1], e[0])):
            if event[2] not in SMALL.whitelist and event[1] < max(behind, known.get(event[2], (k, 0))[1] if known.get(event[2], (k, 0))[0] < k else 0):
                late.add(event[0])
            else:
                decided.append(event)
        for event in decided:
            known[event[2]] = (k, max(known.get(event[2], (k, 0))[1], event[1]))
        top = max(top, *(e[1] for e in arrival))
    kept = streams.scan_admissions(spark, path, False).collect()
    side = streams.scan_admissions(spark, path, True).collect()
    assert {r.event_id for r in side} == late and {2000, 2001, 2002} <= late and len(side) == len(late)
    assert sorted((r.event_id, r.us, r.ip, r.endpoint) for r in kept + side) == sorted(e for a in arrivals for e in a)
    assert {r.event_id: (r.decision, r.remaining) for r in kept} == simulate(decided, SMALL)


def test_addresses_share_state_rows(spark):
    """Many addresses cost no state row and call each, and are decided as ever."""
    draw = random.Random(17)
    ips = [*(f"10.1.{i // 250}.{i % 250}" for i in range(2500)), "10.0.1.3"]
    events = sorted(
        ((i, BASE + draw.randrange(900) * Q.SECOND, ips[i % len(ips)] if i % 3 else ips[i % 7], draw.choice(ENDPOINTS))
         for i in range(9000)), key=lambda e: (e[1], e[0]),
    )
    source = scratch_path(spark, "in")
    for i in range(0, len(events), 4500):
        table(spark, events[i:i + 4500]).coalesce(1).write.mode("append").parquet(source)
    stream = streams.read_files(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
    out = scratch_path(spark, "out")
    query = streams.admission_stream(stream, SMALL).writeStream.format("parquet").option(
        "checkpointLocation", scratch_path(spark, "cp")
    ).trigger(availableNow=True).start(out)
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 1024
    got = {r.event_id: (r.decision, r.remaining) for r in spark.read.parquet(out).collect()}
    assert got == simulate(events, SMALL)


class Held:
    """State of a group between calls of the state function."""

    exists, get, hasTimedOut, watermark, timeout = False, None, False, 0, None

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists, self.get = False, None

    def setTimeoutTimestamp(self, timeout):
        assert timeout > self.watermark
        self.timeout = timeout


def test_addresses_of_one_group_leave_the_state_one_by_one():
    """An idle address goes while another stays; a missing address is one like any other."""
    def rows(*events):
        return iter([pd.DataFrame([e], columns=["event_id", "us", "ip", "endpoint"]) for e in events])

    run, state, hour = streams.admission_step(SMALL), Held(), 3600 * Q.SECOND
    first = list(run((0,), rows((2, BASE + hour, None, "/x"), (1, BASE, "a", "/x"), (0, BASE, "10.0.1.3", "/x")), state))
    got = {r.event_id: r.decision for r in pd.concat(first).itertuples()}
    assert got == {0: "whitelist", 1: "admitted", 2: "admitted"}
    assert set(state.get[0]) == {"a", None} and state.timeout == (BASE + hour) // 1000
    state.watermark, state.hasTimedOut = (BASE + hour) // 1000 + 1, True
    assert list(run((0,), iter([]), state)) == []
    assert state.get[0] == [None] and state.timeout == (BASE + 2 * hour) // 1000
    state.hasTimedOut = False
    out = pd.concat(run((0,), rows((3, BASE + hour, None, "/x"), (4, BASE + hour + Q.SECOND, None, "/x")), state))
    assert list(out["decision"]) == ["late", "admitted"] and list(out["remaining"])[1:] == [6]
    assert list(out["remaining"].isna()) == [True, False] and out["ip"].isna().all()
    state.watermark, state.hasTimedOut = (BASE + 3 * hour) // 1000, True
    assert list(run((0,), iter([]), state)) == [] and not state.exists
