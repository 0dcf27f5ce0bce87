"""Audit sink, windowed counts, stateful admission and progressive scoring on streams."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from crivo.operators.requests import (
    DECISION_SCHEMA,
    LIMITS,
    SECOND,
    Gate,
    Limits,
    micros,
    windowed_request_counts,
)
from crivo.operators.validation import normalize_aliases, validate_proposals
from crivo.sources.files import LOG_TIME, log_rows


def read_files(
    spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = 1000
) -> DataFrame:
    """File stream with a fixed schema and a bounded batch."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
        .format(fmt).load(path)
    )


def _start(writer, path: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def audit_sink(
    events: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Appends every event to the JSON partition of its day, exactly once per checkpoint."""
    writer = (
        log_rows(events).writeStream.format("json").option("timestampFormat", LOG_TIME)
        .partitionBy("event_date").outputMode("append")
    )
    return _start(writer, path, checkpoint, available_now)


def request_count_stream(
    requests: DataFrame, window: str = "60 seconds", slide: str = "10 seconds",
    watermark: str = "65 minutes",
) -> DataFrame:
    """Sliding-window request counts on event time.

    Late rows are dropped at the watermark and counted by ``dropped_rows``.
    """
    return windowed_request_counts(requests, window, slide, watermark)


def dropped_rows(query: StreamingQuery) -> int:
    """Rows the watermark kept from the state, over the batches the query reports.

    ``spark.sql.streaming.numRecentProgressUpdates`` says how many batches that are. Windowed counts
    are summed before they meet the watermark, so there a dropped row stands for a partial count.
    """
    return sum(
        operator["numRowsDroppedByWatermark"]
        for report in query.recentProgress for operator in report["stateOperators"]
    )


def score_stream(
    proposals: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Validated proposals scored as their files arrive.

    ``score`` is a stateless column job, so each slice is one narrow stage. Invalid rows are
    written as well, without a probability and with their error codes.
    """
    checked = validate_proposals(normalize_aliases(proposals))
    scored = score(checked.withColumn("valid", F.size("errors") == 0))
    writer = scored.writeStream.format("parquet").outputMode("append")
    return _start(writer, path, checkpoint, available_now)


# --- stateful admission -----------------------------------------------------------------------
ERA = "36500 days"
#: Addresses are dealt by hash into groups with one state row each: calling the state function and moving its
#: row costs milliseconds whatever they hold. Fixed for the life of a checkpoint.
GROUPS = 1024
#: State of a group. Per address: last time decided, end of its block; per address (as its place) and
#: endpoint: the times recorded.
STATE_SCHEMA = (
    "ips array<string>, seen array<long>, until array<long>, "
    "owners array<int>, endpoints array<string>, times array<array<long>>"
)
#: Rows of an output frame.
FRAME_ROWS = 20_000


def _restored(limits: Limits, value: tuple) -> dict[str | None, tuple[int, Gate]]:
    """Last time decided and gate of every address in a group's state."""
    ips, seen, until, owners, endpoints, times = value
    gates = [Gate(limits, u) for u in until]
    for owner, endpoint, recorded in zip(owners, endpoints, times):
        gates[owner].recorded[endpoint] = list(recorded)
    return dict(zip(ips, zip(seen, gates)))


def _flat(known: dict[str | None, tuple[int, Gate]]) -> tuple:
    """The inverse of `_restored`."""
    seen, gates = [s for s, _ in known.values()], [g for _, g in known.values()]
    recorded = [(i, e, list(ts)) for i, gate in enumerate(gates) for e, ts in gate.recorded.items()]
    owners, endpoints, times = ([r[k] for r in recorded] for k in range(3))
    return list(known), seen, [g.until for g in gates], owners, endpoints, times


def _decided(
    rows: pd.DataFrame, known: dict[str | None, tuple[int, Gate]], behind: int, limits: Limits
) -> pd.DataFrame:
    """Decisions on a group's rows; ``known`` moves on to the state after them.

    Rows go by address and time, so late rows come first in their address, and a block is passed
    over in one step.
    """
    codes, ips = pd.factorize(rows["ip"])
    ips = [*ips, None]  # a missing address has code -1
    order = np.lexsort((rows["event_id"], rows["us"], codes))
    rows, codes = rows.take(order), codes[order]
    us, endpoint, n = rows["us"].to_numpy(), rows["endpoint"].to_numpy(), len(rows)
    decision, none = np.full(n, "late", dtype=object), np.ones((2, n), dtype=bool)
    remaining, retry_after = np.zeros((2, n), dtype=np.int32)
    edges = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), n]
    for start, end in zip(edges, edges[1:]):
        ip = ips[codes[start]]
        if ip in limits.whitelist:
            decision[start:end] = "whitelist"
            continue
        seen, gate = known.get(ip) or (-1, Gate(limits))
        first = at = bisect_left(us, max(seen, behind), start, end)
        while at < end:
            now = int(us[at])
            if now <= gate.until:
                stop = bisect_right(us, gate.until, at, end)
                decision[at:stop], none[1, at:stop] = "blocked", False
                retry_after[at:stop] = np.maximum(0, (gate.until - us[at:stop]) // SECOND)
                at = stop
                continue
            decision[at], *values = gate.decide(ip, now, endpoint[at])
            for value, column, empty in zip(values, (remaining, retry_after), none):
                if value is not None:
                    column[at], empty[at] = value, False
            at += 1
        if first < end:
            seen = int(us[end - 1])
            gate.forget(seen)
            known[ip] = seen, gate
    return rows.assign(
        decision=decision, remaining=pd.arrays.IntegerArray(remaining, none[0]),
        retry_after=pd.arrays.IntegerArray(retry_after, none[1]),
    )


def admission_step(limits: Limits) -> Callable:
    """State function of a group of addresses: their gates as bounded lists, and the last times seen.

    A row behind the watermark or behind its address's last time seen is late: it comes back as such
    and changes nothing. An endpoint's list holds no more times than its limit. An address leaves the
    state when it is idle, whatever the others of its group do.
    """

    def run(
        key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        known = _restored(limits, state.get) if state.exists else {}
        out = None
        if not state.hasTimedOut:
            # A trigger's rows of a group: bounded by the source's files-per-batch setting.
            rows = pd.concat([batch[["event_id", "us", "ip", "endpoint"]] for batch in batches])
            out = _decided(rows, known, watermark * 1000, limits)
        idle = {ip: max(gate.until, seen + limits.retention) // 1000 for ip, (seen, gate) in known.items()}
        known = {ip: held for ip, held in known.items() if idle[ip] >= watermark}
        if known:
            state.update(_flat(known))
            state.setTimeoutTimestamp(max(min(idle[ip] for ip in known), watermark + 1))
        elif state.exists:
            state.remove()
        if out is not None:
            for start in range(0, len(out), FRAME_ROWS):
                yield out.iloc[start:start + FRAME_ROWS]

    return run


def admission_stream(
    requests: DataFrame, limits: Limits = LIMITS, watermark: str = "65 minutes"
) -> DataFrame:
    """Admission decisions on a request stream, state kept per address and dropped when idle.

    Addresses share the state rows and calls of `GROUPS` groups, so a trigger costs by its rows and
    the addresses it meets, not some milliseconds for each address.

    Every request comes back once. Requests older than the watermark, or than the last one decided
    for their address, are marked ``late`` and leave the state as it is. The state operator would
    drop rows behind the watermark unseen by their event time, so they reach it with the end of
    the century they fall into. ``admission_sink`` puts late rows apart.
    """
    rows = (
        requests.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", watermark)
        .withColumn("era", F.window("ts", ERA))
        .select(
            F.pmod(F.xxhash64("ip"), F.lit(GROUPS)).alias("group"), "event_id",
            F.window_time("era").alias("era"), micros("ts").alias("us"), "ip", "endpoint",
        )
    )
    return rows.groupBy("group").applyInPandasWithState(
        admission_step(limits), DECISION_SCHEMA, STATE_SCHEMA, "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def admission_sink(
    decisions: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Writes decided and late requests to tables of their own under one folder, exactly once.

    Both belong to one commit of a batch, so together they are the input after any number of
    batches, restarts included. ``scan_admissions`` reads either.
    """
    writer = (
        decisions.withColumn("late", F.col("decision") == "late")
        .writeStream.format("parquet").partitionBy("late").outputMode("append")
    )
    return _start(writer, path, checkpoint, available_now)


def scan_admissions(spark: SparkSession, path: str, late: bool) -> DataFrame:
    """The decided requests of `admission_sink`, or the late ones."""
    rows = spark.read.schema(f"{DECISION_SCHEMA}, late boolean").parquet(path)
    return rows.filter(F.col("late") == late).drop("late")
