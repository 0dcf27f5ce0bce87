"""Helpers shared by the corpus operators."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crivo.session import stored

__all__ = [
    "SEPARATORS", "WORD_BYTES", "fold_ascii", "hash_unit", "raw_texts", "read_table", "row_digest", "split_words", "stored", "without",
    "words_of",
]

#: Bytes that end a word of the alphanumeric rule: everything in ASCII but digits and letters.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

_KEPT = (string.ascii_lowercase + string.digits).encode()
#: Byte table of the same rule: A-Z folded, separators blank, bytes of other scripts unchanged.
WORD_BYTES = bytes(
    b if b >= 128 or b in _KEPT else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; null is the empty text."""
    return F.translate(
        F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase
    )


def words_of(text: Column) -> Column:
    """Words of the alphanumeric rule in the folded text, as an array without empty entries."""
    return F.array_remove(F.split(fold_ascii(text), SEPARATORS), "")


def raw_texts(texts: pa.Array, rows: int = 256) -> Iterator[bytes | None]:
    """UTF-8 of every text, taken from the batch a few at a time, so it is never held twice."""
    for at in range(0, len(texts), rows):
        yield from texts.slice(at, rows).cast(pa.binary()).to_pylist()


def split_words(raw: bytes | None) -> list[bytes]:
    """The same words from UTF-8 bytes."""
    return raw.translate(WORD_BYTES).split() if raw else []


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops columns an operator is about to add; compares names as the planner does."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def row_digest(columns: list[str]) -> Column:
    """MD5 as bytes of a whole row: every value by its length, nulls apart from empty texts."""
    values = [F.col(f"`{c}`").cast("string") for c in columns]
    sized = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.unhex(F.md5(F.concat(*sized)))


def hash_unit(*parts: Column | str) -> Column:
    """Uniform number in [0, 1) from MD5 of the parts joined by colons; 52 bits, so exact."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
