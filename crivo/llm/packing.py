"""Packing documents into training windows by sum-of-squares online packing.

A document's ids fill as many whole windows as they can; what is left, less than a window, is
placed whole. Of all fill levels at which a partially filled window stands, and of opening a new
window, the one is taken that leaves the sum of squared counts of windows by level smallest. The
counts are kept in one array indexed by level, so a placement looks at `window` numbers, however
many documents came before. Every task packs the rows it reads: nothing is shuffled.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crivo.session import ship_package

#: Characters tokenized at a time, so that a text of any length needs bounded memory.
SEGMENT = 1 << 16
#: Partially filled windows a task keeps; beyond, they are poured together and closed.
OPEN_WINDOWS = 2048
#: Bytes of ids handed on at a time.
OUT_BYTES = 4 << 20

# The splitting pattern and the special token of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = {"<|endoftext|>": 50256}

#: A token never has a space after another character, so a text may be cut before such a space.
_CUT = re.compile("[0-9A-Za-z] ")


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """Cuts a long text where no token can span the cut; together they are the text."""
    at = 0
    while len(text) - at > size and (found := _CUT.search(text, at + size)):
        yield text[at : found.start() + 1]
        at = found.start() + 1
    yield text[at:]


def token_ids(encoding: tiktoken.Encoding, text: str, end_id: int) -> np.ndarray:
    """Ids of the whole text, then `end_id`."""
    parts = [encoding.encode_to_numpy(part, allowed_special="all") for part in segments(text) if part]
    return np.concatenate([*parts, [end_id]]).astype("<u4")


class LevelPacker:
    """Windows of one task: `counts[h]` partially filled ones stand at level h.

    `place` takes an item smaller than the window. Pieces (item, first, ids, sequence, offset) of
    closed windows gather in `closed`.
    """

    def __init__(self, window: int, first_sequence: int = 0, open_windows: int = OPEN_WINDOWS) -> None:
        self.window, self.sequence, self.open_windows = window, first_sequence, open_windows
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.at_level: list[list[list]] = [[] for _ in range(window)]
        self.closed: list[tuple] = []

    def level_for(self, size: int) -> int:
        """Level whose use makes the sum of squares smallest; of equal ones the fullest; 0 opens a window.

        Moving a window from level h to h + size changes the sum by 2 (N[h + size] - N[h]) + 2; a
        window that fills up leaves the array, and a new one comes from nowhere.
        """
        here, there = self.counts[: self.window - size + 1], self.counts[size:]
        change = 2 * (there - here) + 2
        change[0] -= 1
        change[-1] -= 1
        change[1:][here[1:] == 0] = np.iinfo(np.int64).max
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def place(self, item: object, first: int, ids: np.ndarray) -> None:
        size = len(ids)
        level = self.level_for(size)
        content = []
        if level:
            self.counts[level] -= 1
            content = self.at_level[level].pop()
        content.append((item, first, ids))
        if level + size == self.window:
            self._close(content)
        else:
            self.counts[level + size] += 1
            self.at_level[level + size].append(content)
            if self.counts.sum() > self.open_windows:
                self.drain()

    def whole(self, item: object, first: int, ids: np.ndarray) -> None:
        """A piece that fills a window by itself."""
        self._close([(item, first, ids)])

    def _close(self, content: list) -> None:
        offset = 0
        for item, first, ids in content:
            self.closed.append((item, first, ids, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def drain(self) -> None:
        """Closes every open window without padding.

        The emptiest windows are poured into the fullest ones, cutting a piece where a window is
        full; the ids left over become sequences whose lengths are powers of two.
        """
        rest = [content for level in self.at_level for content in level]  # emptiest first
        levels = [level for level, contents in enumerate(self.at_level) for _ in contents]
        self.counts[:] = 0
        self.at_level = [[] for _ in range(self.window)]
        spare: list[tuple] = []  # pieces to pour, last first
        low, high = 0, len(rest) - 1
        while low <= high:
            content, room = rest[high], self.window - levels[high]
            high -= 1
            while room:
                if not spare:
                    if low > high:
                        break
                    spare = rest[low][::-1]
                    low += 1
                item, first, ids = spare.pop()
                if len(ids) > room:
                    spare.append((item, first + room, ids[room:]))
                    ids = ids[:room]
                content.append((item, first, ids))
                room -= len(ids)
            if room:
                spare = content[::-1]
            else:
                self._close(content)
        left = sum(len(piece[2]) for piece in spare)
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            content = []
            while size:
                item, first, ids = spare.pop()
                if len(ids) > size:
                    spare.append((item, first + size, ids[size:]))
                    ids = ids[:size]
                content.append((item, first, ids))
                size -= len(ids)
            self._close(content)


def pack_documents(
    docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", window: int = 1024, end_id: int = 0
) -> DataFrame:
    """One row per piece: the key, `start`, `length`, `ids`, `doc_tokens`, `sequence_id`, `offset`.

    `vocabulary` is the path of a byte-level vocabulary in rank form; the driver reads it (under 2
    MB) and broadcasts it. A document is the ids of its whole text and `end_id`; `ids` holds a
    piece's ids as little-endian unsigned 32-bit numbers. Sequences hold `window` ids, except the
    few that `LevelPacker.drain` ends a task with, whose lengths are powers of two: nothing is
    padded. `sequence_id` is made of the task's number and a running number.

    Null and empty texts are the end id alone; invalid UTF-8 reads as replacement characters. Rows
    with equal or null keys are documents of their own. An empty table gives no rows; other columns
    are ignored. Long texts are tokenized in segments cut where no token can span the cut, so
    memory holds one document's ids, the open windows and one batch.
    """
    if window < 2 or window & (window - 1):
        raise ValueError("window is a power of two")
    spark = docs.sparkSession
    ship_package(spark)
    with open(vocabulary, "rb") as file:
        shared = spark.sparkContext.broadcast(file.read())
    kind = docs.select(f"`{key}`").schema[0].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(shared.value)
        packer = LevelPacker(window, TaskContext.get().partitionId() << 33)
        held, names = 0, None

        def rows() -> pa.RecordBatch:
            closed, packer.closed = packer.closed, []
            return pa.record_batch(
                {
                    key: pa.array([c[0][0] for c in closed], names),
                    "start": pa.array([c[1] for c in closed], pa.int64()),
                    "length": pa.array([len(c[2]) for c in closed], pa.int64()),
                    "ids": pa.array([c[2].tobytes() for c in closed], pa.binary()),
                    "doc_tokens": pa.array([c[0][1] for c in closed], pa.int64()),
                    "sequence_id": pa.array([c[3] for c in closed], pa.int64()),
                    "offset": pa.array([c[4] for c in closed], pa.int64()),
                }
            )

        for batch in batches:
            names = batch.schema.field(0).type
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = token_ids(encoding, (raw.as_py() or b"").decode("utf-8", "replace"), end_id)
                item, whole = (name, len(ids)), len(ids) // window * window
                for first in range(0, whole, window):
                    packer.whole(item, first, ids[first : first + window])
                if whole < len(ids):
                    packer.place(item, whole, ids[whole:].copy())
                held += 4 * len(ids)
                if held >= OUT_BYTES:
                    yield rows()
                    held = 0
        if names is not None:
            packer.drain()
            yield rows()

    out = f"`{key}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    # raw bytes, so that texts that are no valid UTF-8 reach the task
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("binary").alias("__llm_raw")).mapInArrow(pack, out)


def sequences(pieces: DataFrame, window: int = 1024, pad_id: int = 0) -> DataFrame:
    """One row per sequence: `sequence_id`, `used`, `ids` in order, padded unless `used` is a power of two."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b""), lambda so_far, piece: F.concat(so_far, piece["ids"]))
    out = pieces.groupBy("sequence_id").agg(F.sum("length").cast("int").alias("used"), joined.alias("ids"))
    missing = F.when(F.bit_count("used") == 1, 0).otherwise(F.lit(window) - F.col("used"))
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), missing))
    return out.withColumn("ids", F.concat("ids", pad))
