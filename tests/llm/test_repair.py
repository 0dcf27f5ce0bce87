"""Conversation repair against a search over edit sequences, cheapest first and then least."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from crivo.llm import queries, repair
from crivo.llm.repair import cost_matrix, damaged, least_paths, repair_report, repaired_messages

ROLES = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def search(rows):
    """(cost, audit, repaired) of rows (role, text, fault) by best-first search over single edits."""
    heap = [(0, "", 0, "", ())]
    done = set()
    while heap:
        cost, audit, i, last, kept = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in kept)):
            return cost, audit, kept
        if (i, last, audit, cost) in done:
            continue
        done.add((i, last, audit, cost))
        role = ROLES[last]
        if not audit.endswith("III"):
            heapq.heappush(heap, (cost + 3, audit + "I", i, role[0], kept + ((role, ""),)))
        if i == len(rows):
            continue
        own, text, fault = rows[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, kept))
        if fault in ("blank", "duplicate"):
            continue
        extra = 3 if fault == "truncated" else 0
        heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, role[0], kept + ((role, text),)))
        legal = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        if own[:1] and own[:1] in legal:
            heapq.heappush(heap, (cost + extra, audit + "K", i + 1, own[:1], kept + ((own, text),)))
    raise AssertionError("no repair")


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = re.findall("[^\x20\x09-\x0d]", text)
        if not solid:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_report(rows):
    """The expected row of one conversation of rows (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    faults = faults_of([r[1:] for r in rows])
    cost, audit, kept = search([(r, x, f) for (_, r, x), f in zip(rows, faults)])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    text = "\n".join(f"{r}:{x}" for r, x in kept)
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), kept


def random_rows(draw, n):
    rows = []
    for _ in range(n):
        role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
        text = draw.choice(["", " \t\n", "Hi.", "Hi.", "cut", "Yes! ", "x" * 50 + "?\n", None, "é…"]) if draw.random() < 0.6 else f"t{draw.randrange(99)}."
        rows.append((draw.choice([None, *range(6)]), role, text))
    return rows


def check(spark, conversations):
    rows = [(c, *r, "theirs") for c, own in conversations.items() for r in own]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string")
    got = {r.conv: tuple(r)[1:] for r in repair_report(made).collect()}
    expected = {c: plain_report(own) for c, own in conversations.items()}
    assert got == {c: report for c, (report, _) in expected.items()}
    kept = defaultdict(list)
    for r in sorted(repaired_messages(made).collect(), key=lambda r: r.number):
        assert r.number == len(kept[r.conv])
        kept[r.conv].append((r.role, r.text))
    assert dict(kept) == {c: list(k) for c, (_, k) in expected.items() if k}


@pytest.mark.parametrize("bits", [0, 2, 12])
def test_reports_equal_the_search(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "STRETCH_BITS", bits)
    draw = random.Random(bits)
    conversations = {c: random_rows(draw, draw.randint(1, 7)) for c in range(60)}
    conversations[None] = random_rows(draw, 6)
    conversations[60] = [(t, r, "same.") for t in (1, 2) for r in ("user", "user", "assistant")]
    conversations[61] = [(None, "user", "a."), (None, "user", "a.")]
    conversations[62] = [(1, "user", "word " * 60_000 + "end."), (2, "assistant", "é" * 100_000)]
    check(spark, conversations)


def test_no_messages_and_damage(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair_report(empty).count() == 0 and repaired_messages(empty).count() == 0
    rows = [(c, t, r, x) for c in (0, 1, None) for t in (*range(30), None) for r, x in [("assistant", "A. b! c?")]]
    made = spark.createDataFrame([*rows, (5, 1, None, None)], "conv_id long, turn long, role string, text string")
    expected = []
    for c, t, r, x in [*rows, (5, 1, " ", " ")]:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        sort = zlib.crc32(key.encode()) % 20
        x = "" if sort == 1 else re.sub("[.!?]", "", x) if sort == 2 else x
        expected += [(c, t, "user" if sort == 4 else r, x)] * (0 if sort == 0 else 2 if sort == 3 else 1)
    assert sorted(map(repr, map(tuple, damaged(made).collect()))) == sorted(map(repr, expected))


def test_conversations_that_lose_every_message_are_reported(spark, tmp_path):
    lost = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    made = spark.createDataFrame([(lost, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    made.write.parquet(f"{tmp_path}/conversations.parquet")
    row = queries.op12_repair(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in row] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_matrices_and_paths_of_long_conversations():
    draw = random.Random(3)
    for n in (1, 40, 300):
        initials = [draw.choice("uuaasx") for _ in range(n)]
        faults = [draw.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        half = n // 2
        (whole,) = least_paths(initials, faults, [(0, n, repair.ENDS)])
        back = tuple(min(cost_matrix(initials[half:], faults[half:])[4 * q + e] + repair.ENDS[e] for e in range(4)) for q in range(4))
        state, parts = 0, ""
        for first, end, costs in ((0, half, back), (half, n, repair.ENDS)):
            (found,) = least_paths(initials[first:end], faults[first:end], [(0, end - first, costs)])
            parts += found[state][1]
            state = found[state][0]
        assert (state, parts) == whole[0]
        cost = min(cost_matrix(initials, faults)[e] + repair.ENDS[e] for e in range(4))
        if n <= 40:
            names = ["", "blank", "duplicate", "truncated"]
            plain = search([(c, "t", names[f]) for c, f in zip(initials, faults)][:12])
            (short,) = least_paths(initials[:12], faults[:12], [(0, min(n, 12), repair.ENDS)])
            assert plain[1] == short[0][1] + repair.TAILS[short[0][0]]
        spent = sum({"D": 4, "I": 3, "R": 3, "K": 0}[e] for e in parts + repair.TAILS[state])
        assert cost >= spent


def test_a_long_conversation_spreads_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(repair, "STRETCH_BITS", 4)
    rows = [(1, t, "user" if t % 2 else "assistant", f"t{t % 90}." if t % 7 else "cut") for t in range(400)]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    row = repair_report(made).first()
    monkeypatch.setattr(repair, "STRETCH_BITS", 30)
    assert row == repair_report(made.repartition(3).withColumn("extra", F.lit(1))).first() and row.cost > 0
