"""Request limits: rules, sliding counts, exact admission, block intervals, statistics.

Requests of one address are never gathered in one task. Sliding counts look back a fixed time
only, so an address is split into time slices, each with a copy of the rows its first moments
look back on. Admission is sequential per address, but a block lasts at least as long as every
counting window: when it ends, nothing recorded before it counts any more. The only state that
crosses time is therefore the end of the last block, which lets slices be solved in parallel for
every possible entry state and chained afterwards (see ``block_intervals``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crivo import constants as K
from crivo.functions.common import ColumnLike, as_col
from crivo.session import ship_package, stored

SECOND = 1_000_000
NEVER = -(1 << 62)
# Fixed value: recorded requests are kept for an hour, or for the longest window if that is more.
RETENTION = 3600 * SECOND
#: Step functions composed at a time, as a power of two.
FAN_BITS = 4
DECISION_COLUMNS = ["event_id", "us", "ip", "endpoint", "decision", "remaining", "retry_after"]
DECISION_SCHEMA = (
    "event_id bigint, us bigint, ip string, endpoint string, decision string, remaining int, "
    "retry_after int"
)


@dataclass(frozen=True)
class Limits:
    """Endpoint rules (pattern, requests, window seconds, block minutes) and the default."""

    rules: tuple[tuple[str, int, int, int], ...] = K.ENDPOINT_LIMITS
    default: tuple[int, int, int] = K.DEFAULT_LIMIT
    whitelist: tuple[str, ...] = K.WHITELIST
    first_match: bool = False

    def ordered(self) -> list[tuple[str, int, int, int]]:
        """Longest pattern first, or the given order where the first match has to win."""
        if self.first_match:
            return list(self.rules)
        return sorted(self.rules, key=lambda r: -len(r[0]))

    def choices(self) -> list[tuple[int, int, int]]:
        return sorted({(n, w, b) for _, n, w, b in self.rules} | {self.default})

    @property
    def longest_window(self) -> int:
        return max(w for _, w, _ in self.choices())

    @property
    def longest_block(self) -> int:
        return max(b * 60 for _, _, b in self.choices())

    @property
    def blocks_outlast_windows(self) -> bool:
        """True when nothing recorded before a block still counts after it."""
        return min(b * 60 for _, _, b in self.choices()) >= self.longest_window

    @property
    def retention(self) -> int:
        """How long a recorded request is kept, in microseconds."""
        return max(RETENTION, self.longest_window * SECOND)

    def match(self, endpoint: tuple[str, ...] | str) -> tuple[int, int, int]:
        """The rule of one endpoint, for the sequential decisions."""
        for pattern, n, window, block in self.ordered():
            if pattern in endpoint:
                return n, window, block
        return self.default


LIMITS = Limits()


class Gate:
    """One address, decided request by request in time order.

    It stays small whatever the traffic: an endpoint keeps no more times than its limit, because
    requests over the limit are rejected and not recorded.
    """

    def __init__(self, limits: Limits, until: int = -1, recorded: dict | None = None):
        self.limits, self.until, self.recorded = limits, until, recorded or {}

    def decide(self, ip: str, us: int, endpoint: str) -> tuple[str, int | None, int | None]:
        """(decision, remaining, retry after)."""
        if ip in self.limits.whitelist:
            return "whitelist", None, None
        if us <= self.until:
            return "blocked", None, max(0, (self.until - us) // SECOND)
        most, window, block = self.limits.match(endpoint)
        times = [t for t in self.recorded.get(endpoint, ()) if t > us - window * SECOND]
        if len(times) >= most:
            self.until = us + block * 60 * SECOND
            return "limit", 0, window
        self.recorded[endpoint] = [*times, us]
        return "admitted", max(0, most - len(times) - 1), None

    def forget(self, now: int) -> None:
        """Drops what is past the retention."""
        limit = now - self.limits.retention
        kept = {e: [t for t in times if t > limit] for e, times in self.recorded.items()}
        self.recorded = {e: times for e, times in kept.items() if times}


def decision_frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=DECISION_COLUMNS)
    return frame.astype({"remaining": "Int32", "retry_after": "Int32"})


def endpoint_limits(df: DataFrame, limits: Limits = LIMITS, endpoint: str = "endpoint") -> DataFrame:
    """Adds ``max_requests``, ``window_seconds`` and ``block_minutes`` of the matching rule."""
    path, out = F.col(endpoint), {}
    for i, name in enumerate(("max_requests", "window_seconds", "block_minutes")):
        choice = None
        for pattern, *values in limits.ordered():
            hit = path.contains(pattern)
            value = F.lit(values[i]).cast("bigint")
            choice = F.when(hit, value) if choice is None else choice.when(hit, value)
        rest = F.lit(limits.default[i]).cast("bigint")
        out[name] = rest if choice is None else choice.otherwise(rest)
    return df.withColumns(out)


def client_ip(forwarded: ColumnLike, real_ip: ColumnLike, host: ColumnLike) -> Column:
    """First forwarded address, else the proxy's real address, else the peer."""
    forwarded, real_ip = as_col(forwarded), as_col(real_ip)
    first = F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))
    return (
        F.when(forwarded != "", first).when(real_ip != "", real_ip).otherwise(as_col(host))
    )


def micros(ts: ColumnLike) -> Column:
    return F.unix_micros(as_col(ts).cast("timestamp"))


def time_slices(df: DataFrame, us: str, width: int, reach: int) -> DataFrame:
    """Adds ``home`` (the row's slice) and ``slice``, repeating rows the next slice looks back on.

    ``reach`` must not exceed ``width``; both are in microseconds. At most ``reach / width`` of
    the rows are repeated.
    """
    home = F.floor(F.col(us) / F.lit(width)).cast("bigint")
    near_end = (home + 1) * width - F.col(us) <= reach
    return df.withColumn("home", home).withColumn(
        "slice", F.explode(F.array_compact(F.array(home, F.when(near_end, home + 1))))
    )


def _slice_width(window_seconds: int) -> int:
    return max(window_seconds * 8, 900) * SECOND


def _whole_seconds(rows: DataFrame, keys: tuple[str, ...], window_seconds: int) -> DataFrame:
    """Per key and second with requests: ``change``, the requests of the `window_seconds` seconds before.

    Requests are summed by second before they move, and seconds are cut into slices, so no task
    holds more than a slice's seconds of one key, however many requests they stand for.
    """
    per_second = rows.groupBy(*keys, "second").agg(F.count(F.lit(1)).alias("n"))
    cut = time_slices(per_second, "second", max(window_seconds * 8, 900), window_seconds)
    before = Window.partitionBy(*keys, "slice").orderBy("second").rangeBetween(-window_seconds, -1)
    return (
        cut.withColumn("change", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .filter((F.col("slice") == F.col("home")) & (F.col("change") > 0))
        .select(*keys, "second", F.lit(-1).cast("bigint").alias("offset"), "change")
    )


def sliding_request_counts(
    df: DataFrame, window_seconds: int, keys: tuple[str, ...] = ("ip", "endpoint"),
    ts: str = "ts",
) -> DataFrame:
    """Adds ``n_in_window``: requests of the key in (now - window, now], the request included.

    Counts of whole seconds are exact but for the second the window begins in. Within its second a
    request adds one from its own time on, and one window later it takes one away again; the running
    sum of these changes is the answer. A task therefore holds two seconds of a key, not a slice of
    its traffic. Requests without a time are left out; a null in a key is a value like any other.
    """
    columns = df.columns
    timed = df.select(F.struct("*").alias("row"), *keys, micros(ts).alias("us")).filter("us is not null")
    timed = timed.withColumns({
        "second": F.floor(F.col("us") / F.lit(SECOND)).cast("bigint"),
        "offset": F.pmod("us", F.lit(SECOND)).cast("bigint"),
    })
    own = timed.select(*keys, "second", "offset", F.lit(1).cast("bigint").alias("change"), "row")
    gone = timed.select(
        *keys, (F.col("second") + window_seconds).alias("second"), "offset", F.lit(-1).cast("bigint").alias("change")
    )
    changes = own.unionByName(gone, allowMissingColumns=True).unionByName(
        _whole_seconds(timed, keys, window_seconds), allowMissingColumns=True
    )
    so_far = Window.partitionBy(*keys, "second").orderBy("offset").rangeBetween(Window.unboundedPreceding, 0)
    return (
        changes.select("row", F.sum("change").over(so_far).alias("n_in_window"))
        .filter("row is not null")
        .select(*[F.col("row")[c].alias(c) for c in columns], "n_in_window")
    )


def windowed_request_counts(
    df: DataFrame, window: str = "60 seconds", slide: str = "10 seconds",
    watermark: str | None = None, ts: str = "ts",
) -> DataFrame:
    """Requests per (address, endpoint) in sliding windows; with a watermark for streams."""
    rows = df.withColumn(ts, F.col(ts).cast("timestamp"))
    if watermark:
        rows = rows.withWatermark(ts, watermark)
    return rows.groupBy(F.window(ts, window, slide), "ip", "endpoint").agg(
        F.count(F.lit(1)).alias("n_requests")
    ).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "ip", "endpoint", "n_requests",
    )


# --- exact admission --------------------------------------------------------------------------
def _ruled(events: DataFrame, limits: Limits) -> DataFrame:
    return endpoint_limits(events, limits).withColumn("us", micros("ts"))


def violation_candidates(events: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Requests that exceed their limit if the whole look-back was recorded.

    ``since`` is the time of the n-th request before: the request is a violation exactly when the
    last block ended before ``since``.
    """
    reach = limits.longest_window * SECOND
    rows = time_slices(
        _ruled(events, limits)
        .filter(~F.col("ip").isin(*limits.whitelist))
        .select("ip", "endpoint", "us", "event_id", "max_requests", "window_seconds",
                "block_minutes"),
        "us", _slice_width(limits.longest_window), reach,
    )
    order = Window.partitionBy("ip", "endpoint", "slice").orderBy("us", "event_id")
    since = F.lit(None).cast("bigint")
    for n in sorted({n for n, _, _ in limits.choices()}):
        since = F.when(F.col("max_requests") == n, F.lag("us", n).over(order)).otherwise(since)
    return (
        rows.withColumn("since", since)
        .filter(F.col("slice") == F.col("home"))
        .filter(F.col("since") > F.col("us") - F.col("window_seconds") * SECOND)
        .select("ip", "endpoint", "us", "event_id", "since",
                (F.col("us") + F.col("block_minutes") * (60 * SECOND)).alias("until"))
    )


def _next_violation(since: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Per entry state the first candidate (in time order) whose ``since`` lies after it.

    ``len(since)`` stands for none.
    """
    n = len(since)
    by_since = np.argsort(since, kind="stable")
    first = np.append(np.minimum.accumulate(by_since[::-1])[::-1], n)
    return first[np.searchsorted(since[by_since], after, side="right")]


def _chunks(
    batches: Iterator[pd.DataFrame], columns: list[str]
) -> Iterator[tuple[str, int, list[np.ndarray]]]:
    """(ip, chunk, columns) of a stream sorted by (ip, chunk); a chunk may span batches."""
    key, parts = None, []
    for pdf in batches:
        ips, chunks = pdf["ip"].to_numpy(), pdf["chunk"].to_numpy()
        data = [pdf[c].to_numpy() for c in columns]
        edges = np.flatnonzero((ips[1:] != ips[:-1]) | (chunks[1:] != chunks[:-1])) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(ips)]):
            if start == end:
                continue
            if key != (ips[start], chunks[start]):
                if parts:
                    yield *key, [np.concatenate(c) for c in zip(*parts)]
                key, parts = (ips[start], chunks[start]), []
            parts.append([c[start:end] for c in data])
    if parts:
        yield *key, [np.concatenate(c) for c in zip(*parts)]


def _steps_of(since: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk as a step function: entry states in [low, high) leave it as ``leaves``.

    Entry states from the last ``high`` on pass through unchanged.
    """
    n = len(since)
    following = _next_violation(since, until)
    # Jump along the chain in doubling strides until every candidate knows its last one.
    last = np.where(following < n, following, np.arange(n))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    highs = np.unique(since)
    lows = np.append(np.int64(NEVER), highs[:-1])
    leaves = until[last[_next_violation(since, lows)]]
    ends = np.append(leaves[1:] != leaves[:-1], True)
    starts = np.append(True, ends[:-1])
    return lows[starts], highs[ends], leaves[ends]


def _framed(groups: Callable, columns: list[str], rows: int = 20_000) -> Callable:
    """Output frames of many (ip, chunk, arrays) groups, so that a small group costs no frame."""

    def frame(held: list[tuple]) -> pd.DataFrame:
        sizes = [len(arrays[0]) for _, _, arrays in held]
        out = {
            "ip": np.repeat(np.array([ip for ip, _, _ in held], dtype=object), sizes),
            "chunk": np.repeat(np.array([chunk for _, chunk, _ in held], dtype=np.int64), sizes),
        }
        parts = zip(*(arrays for _, _, arrays in held))
        out |= {name: np.concatenate(part) for name, part in zip(columns, parts)}
        return pd.DataFrame(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for group in groups(batches):
            held.append(group)
            n += len(group[2][0])
            if n >= rows:
                yield frame(held)
                held, n = [], 0
        if held:
            yield frame(held)

    return run


def _applied(steps: tuple[np.ndarray, ...], state: np.ndarray) -> np.ndarray:
    """States after a chunk, from those before it."""
    low, high, leaves = steps
    if not len(low):
        return state
    at = np.maximum(np.searchsorted(low, state, side="right") - 1, 0)
    return np.where((state >= low[at]) & (state < high[at]), leaves[at], state)


def _composed(first: tuple[np.ndarray, ...], second: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Two chunks in a row as one step function; neighbouring steps with one outcome become one."""
    low, high, _ = second
    past = first[1][-1] if len(first[1]) else NEVER  # from here on the first chunk changes nothing
    rest = high > past
    parts = (
        (first[0], np.maximum(low[rest], past)),
        (first[1], high[rest]),
        (_applied(second, first[2]), second[2][rest]),
    )
    low, high, leaves = (np.concatenate(p) for p in parts)
    ends = np.append(leaves[1:] != leaves[:-1], True)
    starts = np.append(True, ends[:-1])
    return low[starts], high[ends], leaves[ends]


def _children(child: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """The step functions of one parent in order."""
    edges = [0, *(np.flatnonzero(child[1:] != child[:-1]) + 1).tolist(), len(child)]
    for start, end in zip(edges, edges[1:]):
        yield int(child[start]), tuple(a[start:end] for a in arrays)


def _steps_within(reach: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for ip, chunk, (us, since, until) in _chunks(batches, ["us", "since", "until"]):
            low, high, leaves = _steps_of(since, until)
            near = low < us[0] + reach  # no state reaches further into a chunk than the longest block
            yield ip, chunk, (low[near], high[near], leaves[near])

    return run


def _parents(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """One step function for up to FAN chunks of an address."""
    for ip, chunk, (child, *arrays) in _chunks(batches, ["child", "low", "high", "leaves"]):
        whole = None
        for _, steps in _children(child, arrays):
            whole = steps if whole is None else _composed(whole, steps)
        yield ip, chunk, whole


def _entered(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Entry state of every child; the parent's own comes first, as the ``low`` of child -1."""
    for ip, chunk, (child, *arrays) in _chunks(batches, ["child", "low", "high", "leaves"]):
        state, found = np.array([NEVER]), []
        for name, steps in _children(child, arrays):
            if name < 0:
                state = steps[0]
                continue
            found.append((name, state[0]))
            state = _applied(steps, state)
        yield ip, chunk, (np.array([n for n, _ in found]), np.array([s for _, s in found]))


def _chunk_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """The blocks of every chunk; a first row without a time carries the entry state in ``since``."""
    names = ["since", "until", "us", "event_id", "endpoint"]
    for ip, chunk, (since, until, us, event_id, endpoint) in _chunks(batches, names):
        entry, first = np.array([NEVER]), int(us[0] == NEVER)
        if first:
            entry = since[:1]
        since, n = since[first:], len(since) - first
        following = _next_violation(since, until[first:])
        found, at = [], _next_violation(since, entry)[0]
        while at < n:
            found.append(at + first)
            at = following[at]
        if found:
            yield ip, chunk, (endpoint[found], event_id[found], us[found], until[found])


_STEP_SCHEMA = "ip string, chunk bigint, low bigint, high bigint, leaves bigint"


def _entry_states(found: DataFrame, reach: int) -> DataFrame:
    """(ip, chunk, entry) of the chunks of addresses that fill more than one range.

    A range boundary is crossed by one address at most, so these are no more chunks than twice the
    ranges. Their step functions are composed by a tree, FAN neighbours at a time, and entry states
    come down the same tree: no task sees more than FAN functions of an address.
    """
    spans = found.groupBy("ip").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last"))
    wide = stored(spans.filter("last > first"), "wide-addresses")
    order = ("ip", "chunk", "us", "event_id")
    steps = (
        found.join(wide.select("ip"), "ip", "left_semi").select(*order, "since", "until")
        .repartition("ip", "chunk").sortWithinPartitions(*order)
        .mapInPandas(_framed(_steps_within(reach), ["low", "high", "leaves"]), _STEP_SCHEMA)
    )
    last = wide.agg(F.max("last")).first()[0] or 0
    levels = [stored(steps, "steps")]

    def children(level: DataFrame) -> DataFrame:
        parent = F.shiftright("chunk", FAN_BITS).alias("chunk")
        return level.select("ip", parent, F.col("chunk").alias("child"), "low", "high", "leaves")

    def by_parent(rows: DataFrame, run: Callable, columns: list[str], schema: str) -> DataFrame:
        ordered = rows.repartition("ip", "chunk").sortWithinPartitions("ip", "chunk", "child", "low")
        return ordered.mapInPandas(_framed(run, columns), schema)

    while last >> FAN_BITS * (len(levels) - 1):
        above = by_parent(children(levels[-1]), _parents, ["low", "high", "leaves"], _STEP_SCHEMA)
        levels.append(stored(above, "steps"))
    never = F.lit(NEVER).cast("bigint")
    entries = wide.select("ip", F.lit(0).cast("bigint").alias("chunk"), never.alias("entry"))
    for level in reversed(levels[:-1]):
        own = entries.select(
            "ip", "chunk", F.lit(-1).cast("bigint").alias("child"), F.col("entry").alias("low"),
            never.alias("high"), never.alias("leaves"),
        )
        entered = by_parent(
            children(level).unionByName(own), _entered, ["child", "entry"],
            "ip string, chunk bigint, child bigint, entry bigint",
        )
        entries = entered.select("ip", F.col("child").alias("chunk"), "entry")
    return entries


def block_intervals(
    events: DataFrame, limits: Limits = LIMITS, ranges: int | None = None
) -> DataFrame:
    """(ip, endpoint, event_id, us, until): every block, started by the violating request.

    Candidates are ranged by address and time into parts of equal size; a chunk is an address in a
    part, so an address with half the traffic has half the parts. Chunks of such addresses are
    solved for all entry states at once and reduced to step functions, whose composition gives
    every chunk its entry state (see `_entry_states`); each chunk then lists its blocks. ``ranges``
    sets the number of parts, by default the session's shuffle partitions.

    Limits whose blocks can end while their windows still count are decided in order instead.
    """
    if not limits.blocks_outlast_windows:
        decided = endpoint_limits(_decided_in_order(events, limits), limits)
        until = F.col("us") + F.col("block_minutes") * (60 * SECOND)
        return decided.filter(F.col("decision") == "limit").select(
            "ip", "endpoint", "event_id", "us", until.alias("until")
        )
    ship_package(events.sparkSession)
    order = ("ip", "us", "event_id")
    candidates = violation_candidates(events, limits)
    parted = candidates.repartitionByRange(ranges, *order) if ranges else candidates.repartitionByRange(*order)
    chunk = F.spark_partition_id().cast("bigint").alias("chunk")
    found = stored(parted.sortWithinPartitions(*order).select("*", chunk), "candidates")
    # The entry state travels as the first row of its chunk, which spares a join.
    never = F.lit(NEVER).cast("bigint")
    first = _entry_states(found, limits.longest_block * SECOND).select(
        "ip", F.lit("").alias("endpoint"), never.alias("us"), never.alias("event_id"),
        F.col("entry").alias("since"), never.alias("until"), "chunk",
    )
    return (
        found.unionByName(first)
        .repartition("ip", "chunk")
        .sortWithinPartitions("ip", "chunk", "us", "event_id")
        .mapInPandas(
            _framed(_chunk_blocks, ["endpoint", "event_id", "us", "until"]),
            "ip string, chunk bigint, endpoint string, event_id bigint, us bigint, until bigint",
        )
        .drop("chunk")
    )


def _decided_in_order(events: DataFrame, limits: Limits) -> DataFrame:
    """Decisions taken one by one per address, rows streamed in time order with a small state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate, at = None, None
        for pdf in batches:
            out = []
            columns = (pdf[c].tolist() for c in ("event_id", "us", "ip", "endpoint"))
            for event_id, us, ip, endpoint in zip(*columns):
                if ip != at:
                    gate, at = Gate(limits), ip
                out.append((event_id, us, ip, endpoint, *gate.decide(ip, us, endpoint)))
            if out:
                gate.forget(out[-1][1])
                yield decision_frame(out)

    return (
        events.select("event_id", micros("ts").alias("us"), "ip", "endpoint")
        .repartition("ip")
        .sortWithinPartitions("ip", "us", "event_id")
        .mapInPandas(run, DECISION_SCHEMA)
    )


def _mark_blocked(events: DataFrame, blocks: DataFrame, limits: Limits) -> DataFrame:
    """Adds the block a request falls into, by an equi-join on (address, hour-like slot).

    A slot is as long as the longest block, so a block covers at most two slots, and blocks of an
    address do not overlap: no request matches twice.
    """
    width = limits.longest_block * SECOND

    def slot(x: Column) -> Column:
        return F.floor(x / F.lit(width)).cast("bigint")

    covered = blocks.select(
        F.col("ip").alias("block_ip"),
        F.explode(F.sequence(slot(F.col("us")), slot(F.col("until")))).alias("block_slot"),
        F.col("us").alias("block_start"), F.col("event_id").alias("block_event"),
        F.col("until").alias("block_until"),
    )
    inside = (
        (F.col("ip") == F.col("block_ip"))
        & (F.col("slot") == F.col("block_slot"))
        & (F.col("us") <= F.col("block_until"))
        & (
            (F.col("us") > F.col("block_start"))
            | ((F.col("us") == F.col("block_start")) & (F.col("event_id") >= F.col("block_event")))
        )
    )
    return events.withColumn("slot", slot(F.col("us"))).join(covered, inside, "left").drop(
        "slot", "block_ip", "block_slot"
    )


def admit_requests(
    events: DataFrame, limits: Limits = LIMITS, blocks: DataFrame | None = None
) -> DataFrame:
    """Decision per request: ``whitelist``, ``admitted``, ``limit`` (starts a block), ``blocked``.

    ``remaining`` is what the limit still allows after an admitted request; ``retry_after`` is in
    seconds for rejected ones. Needs columns event_id, ts, ip, endpoint.
    """
    if not limits.blocks_outlast_windows:
        return _decided_in_order(events, limits).withColumn("ts", F.timestamp_micros("us")).select(
            "event_id", "ts", "ip", "endpoint", "decision", "remaining", "retry_after"
        )
    blocks = block_intervals(events, limits) if blocks is None else blocks
    free = F.col("ip").isin(*limits.whitelist)
    marked = _mark_blocked(_ruled(events, limits), blocks, limits)
    decided = marked.withColumn(
        "decision",
        F.when(free, "whitelist")
        .when(F.col("event_id") == F.col("block_event"), "limit")
        .when(F.col("block_event").isNotNull(), "blocked")
        .otherwise("admitted"),
    )
    rows = time_slices(decided, "us", _slice_width(limits.longest_window), limits.longest_window * SECOND)
    # Beyond the limit nothing is left, so a look-back needs no more rows than the largest limit;
    # rejected requests are counted by nobody and spread as groups of their own.
    most = max(n for n, _, _ in limits.choices())
    admitted = F.col("decision") == "admitted"
    recent = (
        Window.partitionBy("ip", "endpoint", "slice", F.when(~admitted, F.col("event_id")))
        .orderBy("us", "event_id").rowsBetween(-most, Window.currentRow)
    )
    inside = F.filter("times", lambda t: t > F.col("us") - F.col("window_seconds") * SECOND)
    wait = F.floor((F.col("block_until") - F.col("us")) / SECOND)
    return (
        rows.withColumn("times", F.collect_list("us").over(recent))
        .filter(F.col("slice") == F.col("home"))
        .select(
            "event_id", "ts", "ip", "endpoint", "decision",
            F.when(
                F.col("decision") == "admitted",
                F.greatest(F.lit(0), F.col("max_requests") - F.size(inside)),
            ).when(F.col("decision") == "limit", 0).cast("int").alias("remaining"),
            F.when(F.col("decision") == "limit", F.col("window_seconds"))
            .when(F.col("decision") == "blocked", F.greatest(F.lit(0), wait))
            .cast("int").alias("retry_after"),
        )
    )


def top_ips(df: DataFrame, k: int = 10) -> DataFrame:
    return (
        df.groupBy("ip").agg(F.count(F.lit(1)).alias("requests"))
        .orderBy(F.desc("requests"), "ip").limit(k)
    )


def rate_limit_stats(
    df: DataFrame, blocks: DataFrame, asof: Column, k: int = 10
) -> DataFrame:
    """(metric, key, value): tracked addresses, (address, endpoint) pairs, requests, open blocks
    with their remaining seconds, and the busiest addresses."""
    per_ip = (
        df.groupBy("ip", "endpoint").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("ip").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pairs"))
    )
    now, none = micros(asof), F.lit("")
    left = F.greatest(F.lit(0), F.floor((F.col("until") - now) / SECOND))
    open_blocks = blocks.filter((F.col("us") <= now) & (F.col("until") >= now))

    def cell(metric: str, key: Column, value: Column | int) -> Column:
        value = F.lit(value) if isinstance(value, int) else value
        return F.struct(
            F.lit(metric).alias("metric"), key.alias("key"), value.cast("bigint").alias("value")
        )

    def cells(source: DataFrame, *parts: Column) -> DataFrame:
        return source.select(F.inline(F.array(*parts)))

    counters = ("tracked_ips", "tracked_pairs", "tracked_requests", "blocked_ips")
    summed = (
        cells(
            per_ip,
            cell("tracked_ips", none, 1),
            cell("tracked_pairs", none, F.col("pairs")),
            cell("tracked_requests", none, F.col("n")),
        )
        .unionByName(
            cells(
                open_blocks,
                cell("blocked_ips", none, 1),
                cell("blocked_remaining", F.col("ip"), left),
            )
        )
        .unionByName(cells(df.sparkSession.range(1), *(cell(c, none, 0) for c in counters)))
        .groupBy("metric", "key")
        .agg(F.sum("value").alias("value"))
    )
    busiest = per_ip.orderBy(F.desc("n"), "ip").limit(k)
    return summed.unionByName(cells(busiest, cell("top_ip", F.col("ip"), F.col("n"))))
