"""Repair of a conversation's structure by the cheapest edits, the least audit first among equals.

A repaired conversation reads `(s?(ua)+)?` by the initials of its roles. Between two messages it is
in one of four states (nothing yet, after s, after u, after a), so a message is a four by four
matrix of costs, and matrices of neighbouring messages multiply (least sum for product). Messages
are put in order once; a stretch of at most 2^STRETCH_BITS of them hands over one matrix for each
conversation in it. Costs to go run backwards over those, and each stretch, told its own, finds the
arcs of cheapest paths and ranks their nodes by prefix doubling: a node's rank by its next 2^k edits
follows from its rank by 2^(k - 1) and that of the node its pointer of this length leads to. Ranks
choose the arc at each node, and the path through the chosen arcs is read off doubled pointers.

The edits at a node have different letters, so the first letter decides there, and ranks need not
look past the stretch. A conversation of any length fills as many stretches as it has messages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crivo.llm.common import stored
from crivo.llm.ranking import AT, in_order
from crivo.session import ship_package

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Letters of the edits in ASCII order; a path's end comes before all of them.
LETTERS = b"\0DIKR"
#: Faults, first to last.
SOUND, BLANK, DUPLICATE, CUT = range(4)
STRETCH_BITS = 12

#: State that a message of the turn's own role leads to; the role itself by state.
NEXT = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
#: State after keeping a message by its initial, -1 where the pattern forbids it.
KEPT = {"s": (1, -1, -1, -1), "u": (2, 2, -1, 2), "a": (-1, -1, 3, -1)}
NOT_KEPT = (-1, -1, -1, -1)
#: Cost and letters that end a conversation from each state.
ENDS, TAILS = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
LEGAL = {"su", "ua", "au"}

_SPACE = " \t\n\x0b\f\r"
Costs = tuple[int, int, int, int]


def step_back(initial: str, fault: int, ahead: Costs) -> Costs:
    """Costs to go before a message, by state, from those after it."""
    own = [DELETE + c for c in ahead]
    if fault not in (BLANK, DUPLICATE):
        extra = TRUNCATED if fault == CUT else 0
        kept = KEPT.get(initial, NOT_KEPT)
        for q in range(4):
            own[q] = min(own[q], REROLE + extra + ahead[NEXT[q]])
            if kept[q] >= 0:
                own[q] = min(own[q], KEEP + extra + ahead[kept[q]])
    u, a = min(own[2], INSERT + own[3]), min(own[3], INSERT + own[2])
    return min(own[0], INSERT + u), min(own[1], INSERT + u), u, a


_FAR = 1 << 40
_EXITS = [tuple(0 if q == e else _FAR for q in range(4)) for e in range(4)]


def cost_matrix(initials: list[str], faults: list[int]) -> list[int]:
    """Least costs from each state before the messages to each state after them, 16 numbers."""
    columns = []
    for ahead in _EXITS:
        for initial, fault in zip(reversed(initials), reversed(faults)):
            ahead = step_back(initial, fault, ahead)
        columns.append(ahead)
    return [min(_FAR, columns[e][q]) for q in range(4) for e in range(4)]


def _dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


def least_paths(initials: list[str], faults: list[int], runs: list[tuple[int, int, Costs]]) -> list[list[tuple[int, str]]]:
    """For each run (first, end, costs to go at its end) the exit state and audit from every entry state.

    Nodes are (message, state), four more end a run; all runs are ranked at once.
    """
    n = len(initials)
    place = np.zeros(n, dtype=np.int64)  # a message's first node, in fours
    ahead = np.zeros((n + len(runs), 4), dtype=np.int64)
    ends = np.zeros(n + len(runs), dtype=bool)
    for k, (first, end, costs) in enumerate(runs):
        place[first:end] = np.arange(first, end) + k
        ahead[end + k], ends[end + k] = costs, True
        for i in range(end - 1, first - 1, -1):
            costs = step_back(initials[i], faults[i], costs)
            ahead[i + k] = costs
    fault = np.array(faults, dtype=np.int64)[:, None]
    extra = np.where(fault == CUT, TRUNCATED, 0)
    usable = (fault != BLANK) & (fault != DUPLICATE)
    kept = np.array([KEPT.get(c, NOT_KEPT) for c in initials], dtype=np.int64).reshape(n, 4)
    here, there, state = ahead[place], ahead[place + 1], np.arange(4)[None, :]
    onward = np.broadcast_to(np.array(NEXT), (n, 4))

    def at(costs: np.ndarray, states: np.ndarray) -> np.ndarray:
        return np.take_along_axis(costs, np.maximum(states, 0), axis=1)

    # by letter: whether the edit lies on a cheapest path, and the node it leads to
    after = 4 * (place[:, None] + 1)
    options = (
        (here == DELETE + there, after + state),
        (here == INSERT + at(here, onward), after - 4 + onward),
        (usable & (kept >= 0) & (here == KEEP + extra + at(there, kept)), after + np.maximum(kept, 0)),
        (usable & (here == REROLE + extra + at(there, onward)), after + onward),
    )
    nodes = 4 * len(ahead)
    letter = np.zeros((len(ahead), 4, 4), dtype=np.int64)
    target = np.broadcast_to(np.arange(nodes).reshape(-1, 4, 1), letter.shape).copy()
    for k, (cheapest, to) in enumerate(options):
        letter[place, :, k] = np.where(cheapest, k + 1, len(LETTERS))
        target[place, :, k] = to
    letter, target, closed = letter.reshape(nodes, 4), target.reshape(nodes, 4), np.repeat(ends, 4)

    def doubled(choice: np.ndarray) -> list[np.ndarray]:
        pointers = [np.take_along_axis(target, choice[:, None], axis=1)[:, 0]]
        while not closed[pointers[-1]].all():
            pointers.append(pointers[-1][pointers[-1]])
        return pointers

    rank = letter.min(axis=1)
    for pointer in doubled(letter.argmin(axis=1)):
        rank = _dense(rank * (nodes + len(LETTERS)) + rank[pointer])
    choice = (letter * (nodes + 1) + rank[target]).argmin(axis=1)
    pointers = doubled(choice)
    letters = np.frombuffer(LETTERS, dtype=np.uint8)[np.take_along_axis(letter, choice[:, None], axis=1)[:, 0]]
    out = []
    for k, (first, end, _) in enumerate(runs):
        found = []
        for q in range(4):
            path = np.array([4 * (first + k) + q])
            for pointer in pointers:
                if closed[path[-1]]:
                    break
                path = np.concatenate([path, pointer[path]])
            stop = path[-1] if closed[path[-1]] else pointers[-1][path[-1]]
            found.append((int(stop) & 3, letters[path].tobytes().rstrip(b"\0").decode()))
        out.append(found)
    return out


def _runs(conv: list) -> list[tuple[int, int]]:
    """Stretches of equal neighbours."""
    starts = [i for i in range(len(conv)) if not i or conv[i] != conv[i - 1]]
    return list(zip(starts, [*starts[1:], len(conv)]))


def _summaries(table: pa.Table) -> pa.Table:
    """One row per conversation of a stretch: its matrix, its counts and its first and last message."""
    table = table.sort_by(AT)
    conv, turn = table.column("conv").to_pylist(), table.column("turn").to_pylist()
    initial, fault = table.column("initial").to_pylist(), table.column("fault").to_pylist()
    runs = _runs(conv)
    out = {name: [] for name in _SUMMARY}
    for a, b in runs:
        turns = [t for t in turn[a:b] if t is not None]
        out["matrix"].append(cost_matrix(initial[a:b], fault[a:b]))
        for name, value in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT)):
            out[name].append(fault[a:b].count(value))
        out["illegal"].append(sum(x + y not in LEGAL for x, y in zip(initial[a:b], initial[a + 1 : b])))
        out["turns"].append(len(set(turns)))
        out["least"].append(min(turns, default=None))
        out["most"].append(max(turns, default=None))
        out["first"].append(initial[a])
        out["last"].append(initial[b - 1])
    found = pa.table({name: pa.array(out[name], kind) for name, kind in _SUMMARY.items()})
    starts = pa.array([a for a, _ in runs], pa.int64())
    return found.append_column("conv", table.column("conv").take(starts)).append_column(
        "stretch", table.column("stretch").take(starts)
    )


_SUMMARY = {
    "matrix": pa.list_(pa.int64()), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(),
    "illegal": pa.int64(), "turns": pa.int64(), "least": pa.int64(), "most": pa.int64(),
    "first": pa.string(), "last": pa.string(),
}
_SUMMARY_SQL = (
    "matrix array<long>, blank long, duplicate long, truncated long, illegal long, turns long, least long, "
    "most long, first string, last string, conv {}, stretch long"
)
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Chain:
    """Costs to go and totals of one conversation, fed its stretches from the last to the first."""

    def __init__(self) -> None:
        self.ahead: Costs = ENDS
        self.sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.least = self.most = self.first = None

    def add(self, row: dict) -> None:
        for name in self.sums:
            self.sums[name] += row[name]
        if self.first is not None:
            self.sums["illegal"] += row["last"] + self.first not in LEGAL
        if row["most"] is not None:
            self.sums["turns"] -= row["most"] == self.least  # the same turn goes on in the next stretch
            self.most = row["most"] if self.most is None else self.most
            self.least = row["least"]
        self.first = row["first"]
        self.ahead = tuple(min(row["matrix"][4 * q + e] + self.ahead[e] for e in range(4)) for q in range(4))

    def totals(self) -> dict:
        gaps = 0 if self.most is None else self.most - self.least + 1 - self.sums["turns"]
        return {"gaps": gaps, "cost": self.ahead[0], **{k: v for k, v in self.sums.items() if k != "turns"}}


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs to go at the end of every stretch; the first stretch of a conversation carries its totals."""
    chain, held, kind = None, None, None

    def rows(found: list[dict]) -> pa.RecordBatch:
        columns = {"conv": kind, "stretch": pa.int64(), "ahead": pa.list_(pa.int64()), "head": pa.bool_()}
        columns |= dict.fromkeys(_COUNTS, pa.int64())
        return pa.record_batch({c: pa.array([r.get(c) for r in found], t) for c, t in columns.items()})

    for batch in batches:
        kind, out = batch.schema.field("conv").type, []
        for row in batch.to_pylist():
            if held is not None and held["conv"] == row["conv"]:
                out.append(held)
            else:
                if held is not None:
                    out.append(held | {"head": True} | chain.totals())
                chain = _Chain()
            held = {"conv": row["conv"], "stretch": row["stretch"], "ahead": list(chain.ahead), "head": False}
            chain.add(row)
        yield rows(out)
    if held is not None:
        yield rows([held | {"head": True} | chain.totals()])


def _pieces(messages: pa.Table, ahead: pa.Table) -> pa.Table:
    """Exit states and audits of a stretch's conversations by entry state; a head is entered in state 0."""
    table = messages.sort_by(AT)
    conv = table.column("conv").to_pylist()
    told = {r["conv"]: r for r in ahead.to_pylist()}
    runs = [(a, b, told[conv[a]]) for a, b in _runs(conv)]
    found = least_paths(
        table.column("initial").to_pylist(),
        table.column("fault").to_pylist(),
        [(a, b, tuple(r["ahead"])) for a, b, r in runs],
    )
    kept = [f[:1] if r["head"] else f for f, (_, _, r) in zip(found, runs)]
    return pa.table(
        {
            "conv": table.column("conv").take(pa.array([a for a, _, _ in runs], pa.int64())),
            "stretch": pa.array([r["stretch"] for _, _, r in runs], pa.int64()),
            "exits": pa.array([[e for e, _ in f] for f in kept], pa.list_(pa.int32())),
            "audits": pa.array([[a for _, a in f] for f in kept], pa.list_(pa.string())),
        }
    )


class _Repair:
    """One conversation: its audit is put together from pieces, then its messages pass by."""

    def __init__(self, head: dict) -> None:
        self.head, self.parts, self.state = head, [], 0
        self.audit, self.at, self.walk = None, 0, 0

    def piece(self, exits: list[int], audits: list[str]) -> None:
        self.parts.append(audits[self.state])
        self.state = exits[self.state]

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            yield "I", ROLE[self.walk], ""
            self.walk = NEXT[self.walk]
            self.at += 1

    def message(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """Edits (letter, role, text) up to this message; a deleted one is told as well."""
        if self.audit is None:
            self.audit = "".join(self.parts) + TAILS[self.state]
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.walk = KEPT[role[:1]][self.walk]
        elif edit == "R":
            role, self.walk = ROLE[self.walk], NEXT[self.walk]
        yield edit, role, text

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Repair, Iterator[tuple[str, str, str]]]]:
    """(repair, edits so far) for rows sorted by conversation: its head, its pieces, its messages."""
    now = None
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] == 0:
                if now is not None:
                    yield now, now.end(), True
                now = _Repair(row)
            elif row["part"] == 1:
                now.piece(row["exits"], row["audits"])
            else:
                yield now, now.message(row["role"], row["text"]), False
    if now is not None:
        yield now, now.end(), True


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, out, digest, any_kept = None, [], hashlib.sha256(), False

    def seen(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for batch in source:
            kind = batch.schema.field("conv").type
            yield batch

    def rows() -> pa.RecordBatch:
        columns = {"conv": kind} | dict.fromkeys(_COUNTS, pa.int64()) | {"audit": pa.string(), "repaired_sha256": pa.string()}
        made = pa.record_batch({c: pa.array([r[c] for r in out], t) for c, t in columns.items()})
        out.clear()
        return made

    for repair, edits, last in _conversations(seen(batches)):
        for edit, role, text in edits:
            if edit != "D":
                digest.update((("\n" if any_kept else "") + f"{role}:{text}").encode())
                any_kept = True
        if last:
            out.append(repair.head | {"audit": repair.audit, "repaired_sha256": digest.hexdigest()})
            digest, any_kept = hashlib.sha256(), False
            if len(out) >= 5000:
                yield rows()
    if out:
        yield rows()


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, out, held, number = None, [], 0, 0

    def seen(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for batch in source:
            kind = batch.schema.field("conv").type
            yield batch

    def rows() -> pa.RecordBatch:
        columns = zip(("conv", "number", "edit", "role", "text"), (kind, pa.int64(), pa.string(), pa.string(), pa.string()))
        made = pa.record_batch({c: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate(columns)})
        out.clear()
        return made

    for repair, edits, last in _conversations(seen(batches)):
        for edit, role, text in edits:
            if edit != "D":
                out.append((repair.head["conv"], number, edit, role, text))
                number += 1
                held += len(text)
        number = 0 if last else number
        if held > 1 << 22 or len(out) >= 5000:
            yield rows()
            held = 0
    if out:
        yield rows()


def _plain(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The four columns under fixed names, with the digest that orders and compares texts."""
    def full(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    return rows.select(
        F.col(f"`{conv}`").alias("conv"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        full(role).alias("role"),
        full(text).alias("text"),
        F.unhex(F.sha2(full(text), 256)).alias("digest"),
    )


def _with_faults(messages: DataFrame) -> DataFrame:
    """Messages in order without their texts: `conv`, `turn`, `initial`, `fault`, the order number and the stretch.

    A message is a duplicate unless it is the first of its conversation with its role and text; the
    firsts come from a grouping with partial sums and are told by their own order number, so a
    text that fills a conversation is no hot key.
    """
    bare = F.rtrim("text", F.lit(_SPACE))
    rows = messages.select(
        "conv",
        "turn",
        "role",
        "digest",
        F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(SOUND).alias("own"),
    )
    ordered = in_order(rows, ["conv", "turn", "role", "digest"], "turns")
    firsts = ordered.groupBy("conv", "role", "digest").agg(F.min(AT).alias(AT)).select(AT, F.lit(True).alias("first"))
    own = F.col("own")
    fault = F.when(own == BLANK, BLANK).when(F.col("first").isNull(), DUPLICATE).otherwise(own)
    return ordered.join(firsts, AT, "left").select(
        "conv",
        "turn",
        F.substring("role", 1, 1).alias("initial"),
        fault.cast("int").alias("fault"),
        AT,
        F.shiftright(AT, STRETCH_BITS).alias("stretch"),
    )


def _edited(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, str]:
    """Heads, audit pieces and messages of every conversation, sorted within partitions of whole conversations."""
    ship_package(rows.sparkSession)
    messages = _plain(rows, conv, turn, role, text)
    kind = messages.schema["conv"].dataType.simpleString()
    faults = stored(_with_faults(messages), "faults")
    summaries = faults.groupBy("stretch").applyInArrow(_summaries, _SUMMARY_SQL.format(kind))
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    backwards = summaries.repartition("conv").sortWithinPartitions("conv", F.desc("stretch"))
    ahead = stored(
        backwards.mapInArrow(_chained, f"conv {kind}, stretch long, ahead array<long>, head boolean, {counts}"), "ahead"
    )
    pieces = (
        faults.groupBy("stretch")
        .cogroup(ahead.select("conv", "stretch", "ahead", "head").groupBy("stretch"))
        .applyInArrow(_pieces, f"conv {kind}, stretch long, exits array<int>, audits array<string>")
    )
    parts = (
        ahead.filter("head").select("conv", F.lit(0).alias("part"), *_COUNTS),
        pieces.withColumn("part", F.lit(1)),
        messages.withColumn("part", F.lit(2)),
    )
    every = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    order = ("conv", "part", "stretch", "turn", "role", "digest")
    return every.repartition("conv").sortWithinPartitions(*order).drop("stretch", "turn", "digest"), kind


def repair_report(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: `conv`, `gaps`, `blank`, `duplicate`, `truncated`, `illegal`, `cost`, `audit`, `repaired_sha256`.

    Messages stand by turn (nulls first), then role, then SHA-256 of the text. A null role or text
    is one space; a null conversation id is a conversation of its own; rows that repeat a message
    are duplicates. A message's first fault counts: blank, seen before, cut off. Keeping a message
    costs 0, giving it the pattern's next role 3, deleting it 4, inserting an empty one 3, and a
    cut-off message that stays 3 more. An empty table gives no rows; other columns are ignored.

    Texts are shuffled once, by conversation, and pass through a task one batch at a time. What one
    task has to do for one conversation is to hash its text in order and to hold its audit, which
    is a single value of the result; faults, costs and paths are spread over its stretches.
    """
    every, kind = _edited(rows, conv, turn, role, text)
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return every.mapInArrow(_reports, f"conv {kind}, {counts}, audit string, repaired_sha256 string")


def repaired_messages(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The repaired conversations: `conv`, `number` from 0, `edit` (K, R or I), `role`, `text`.

    Conversations all of whose messages are deleted have no rows; else as `repair_report`.
    """
    every, kind = _edited(rows, conv, turn, role, text)
    return every.mapInArrow(_messages, f"conv {kind}, number long, edit string, role string, text string")


def damaged(rows: DataFrame) -> DataFrame:
    """`conv_id`, `turn`, `role`, `text` with faults planted by the CRC-32 of id and turn; nulls read as one space."""
    def full(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    sort = F.crc32(F.concat(full("conv_id"), F.lit(":"), full("turn"))) % 20
    text = F.when(sort == 1, "").when(sort == 2, F.translate(full("text"), ".!?", "")).otherwise(full("text"))
    copies = F.when(sort == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    made = rows.filter(sort != 0).select(
        "conv_id",
        "turn",
        F.when(sort == 4, "user").otherwise(full("role")).alias("role"),
        text.alias("text"),
        F.explode(copies).alias("__llm_copy"),
    )
    return made.drop("__llm_copy")
