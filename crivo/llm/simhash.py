"""Near duplicates by SimHash and meet-in-the-middle ball hashing.

Two fingerprints at most `2 r` bits apart share a variant that is at most `r` bits from either.
Every fingerprint stands for all its variants within `r` bits; rows are shuffled on a hash of the
variant, equal variants collide, and colliding pairs are deduplicated and verified.

The hash of the shuffle is linear over bits: the bucket of `x ^ mask` is the bucket of `x` xor the
bucket of `mask`. One shuffled row (bucket, fingerprint) therefore stands for all variants of the
fingerprint in that bucket, and the reader writes them out. That carries eight bytes for some
thirty variants; with more buckets than masks a row is exactly one variant.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crivo.llm.common import raw_texts, row_digest, stored
from crivo.llm.components import components
from crivo.session import ship_package

SEED = 42
#: Variants written out at a time by one task.
PASS_VARIANTS = 1 << 20
#: Variants and fingerprints a bucket should hold, and the least number of buckets as a power of two.
BUCKET_VARIANTS, BUCKET_PRINTS, LEAST_BITS = 1 << 27, 1 << 24, 6


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit numbers have each bit."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(raw: bytes | None, width: int = 4) -> int:
    """SimHash of UTF-8 text as an unsigned number; zero without words."""
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, SEED)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, ends)), dtype=np.uint64, count=len(starts)
    )
    majority = _bit_counts(hashes) * 2 > len(hashes)
    return int(np.packbits(majority, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, name: str, text: str = "text", width: int = 4) -> DataFrame:
    """Adds the fingerprint as a signed long; only the text goes through Python."""
    ship_package(docs.sparkSession)

    @F.arrow_udf(T.LongType())
    def made(texts: pa.Array) -> pa.Array:
        values = [fingerprint(raw, width) for raw in raw_texts(texts)]
        return pa.array(np.array(values, dtype=np.uint64).view(np.int64))

    return docs.withColumn(name, made(F.col(text)))


def ball_masks(bits: int) -> np.ndarray:
    """All 64-bit masks of at most that many bits."""
    return np.array(
        [sum(1 << b for b in chosen) for k in range(bits + 1) for chosen in combinations(range(64), k)],
        dtype=np.uint64,
    )


def _basis(bits: int) -> np.ndarray:
    """Rows of the linear hash, one 64-bit parity mask per bit of the bucket."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, size=bits, dtype=np.uint64)


def _linear(values: np.ndarray, basis: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), dtype=np.int64)
    for i, row in enumerate(basis):
        out |= (np.bitwise_count(values & row) & 1).astype(np.int64) << i
    return out


def _linear_column(value: Column, basis: np.ndarray) -> Column:
    out = F.lit(0).cast("long")
    for i, row in enumerate(basis.view(np.int64).tolist()):
        bit = F.bit_count(value.bitwiseAND(F.lit(row).cast("long"))) % 2
        out = out.bitwiseOR(F.shiftleft(bit.cast("long"), i))
    return out


def _grouped(classes: np.ndarray) -> dict[int, np.ndarray]:
    """Positions by class."""
    order = np.argsort(classes, kind="stable")
    found, first = np.unique(classes[order], return_index=True)
    return dict(zip(found.tolist(), np.split(order, first[1:])))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, member) of a spanning star for every component of the edges."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        la, lb = la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]
    member = np.flatnonzero(label != np.arange(n))
    return label[member], member


def bucket_links(values: np.ndarray, bucket: int, bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints whose variants collide in this bucket, as spanning stars.

    All members of one variant are within twice the half radius of each other, so linking
    neighbours in the sorted run loses no connection. Variants are written out in passes of
    bounded size, split by further bits of the same hash.
    """
    masks = ball_masks(half)
    values = np.unique(values)
    passes = 0
    while len(values) * len(masks) >> (bits + passes) > PASS_VARIANTS:
        passes += 1
    basis = _basis(bits + passes)
    of_mask = _grouped(_linear(masks, basis))
    of_value = _grouped(_linear(values, basis))
    a, b = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for turn in range(1 << passes):
        target, made, owner = bucket | turn << bits, [], []
        for cls, rows in of_value.items():
            if (chosen := of_mask.get(target ^ cls)) is not None:
                made.append((values[rows][:, None] ^ masks[chosen][None, :]).ravel())
                owner.append(np.repeat(rows.astype(np.int32), len(chosen)))
        if not made:
            continue
        variants, owners = np.concatenate(made), np.concatenate(owner)
        del made, owner
        order = np.argsort(variants)
        variants = variants[order]
        same = np.flatnonzero(variants[1:] == variants[:-1])
        x, y = owners[order[same]], owners[order[same + 1]]
        near = np.bitwise_count(values[x] ^ values[y]) <= 2 * half
        a, b = _forest(len(values), np.concatenate([a, x[near]]), np.concatenate([b, y[near]]))
    return values[a], values[b]


def bucket_bits(count: int, masks: int) -> int:
    """Number of buckets, as a power of two, for so many fingerprints with so many masks each.

    A fingerprint has a row in every bucket that one of its variants falls into.
    """
    bits = LEAST_BITS
    while count * masks >> bits > BUCKET_VARIANTS or count * min(masks, 1 << bits) >> bits > BUCKET_PRINTS:
        bits += 1
    return bits


def fingerprint_links(prints: DataFrame, count: int, max_bits: int = 4) -> DataFrame:
    """Links `u`, `v` that connect all distinct fingerprints `fp` at most `max_bits` apart.

    `count` is their number; it only sets how many buckets are used. A bucket holds about
    `BUCKET_PRINTS` fingerprints at most, and its variants are written out in passes.
    """
    if max_bits % 2 or not 0 < max_bits <= 8:
        raise ValueError("max_bits must be even, from 2 to 8")
    ship_package(prints.sparkSession)
    half = max_bits // 2
    masks = ball_masks(half)
    bits = bucket_bits(count, len(masks))
    basis = _basis(bits)
    classes = F.array(*[F.lit(c).cast("long") for c in np.unique(_linear(masks, basis)).tolist()])
    rows = prints.select(
        "fp",
        F.explode(
            F.transform(classes, lambda c: c.bitwiseXOR(_linear_column(F.col("fp"), basis)))
        ).alias("bucket"),
    )

    def links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        values = table.column("fp").to_numpy().view(np.uint64)
        u, v = bucket_links(values, key[0].as_py(), bits, half)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return rows.groupBy("bucket").applyInArrow(links, "u long, v long").distinct()


def _groups(prints: DataFrame, max_bits: int) -> DataFrame:
    """`fp`, `component_id` and the fingerprint `owner` that holds the component's document."""
    own = stored(
        prints.groupBy("fp").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("first")
        ),
        "fingerprints",
    )
    links = fingerprint_links(own.select("fp"), own.count(), max_bits)
    roots = components(links).withColumnRenamed("node", "fp")
    rooted = own.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    return rooted.join(best, "root").select(
        "fp",
        F.col("best.doc_id").alias("component_id"),
        F.col("best.fp").alias("owner"),
    )


def simhash_groups(docs: DataFrame, max_bits: int = 4, width: int = 4) -> DataFrame:
    """One row per document: `doc_id`, `fingerprint`, `component_id`.

    Words are split at ASCII white space after folding A-Z; shingles count as often as they occur;
    a text with fewer words than `width` is one shingle. Null, empty and blank texts have
    fingerprint zero and are linked like any other. The component is the smallest doc_id reachable
    over links of at most `max_bits`; null doc_ids count last, and a component of nulls only has a
    null id. Repeated rows come out as often as they went in; an empty table gives no rows; columns
    other than `doc_id` and `text` are ignored.

    Only distinct fingerprints take part in the links, so groups of equal texts cost nothing.
    Joining back is the one step a frequent fingerprint can skew, and the planner splits it.
    """
    prints = stored(with_fingerprint(docs.select("doc_id", "text"), "fp", width=width).drop("text"), "prints")
    out = prints.join(_groups(prints, max_bits), "fp", "left")
    return out.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def simhash_keep(docs: DataFrame, max_bits: int = 4, width: int = 4) -> DataFrame:
    """The documents of which one of each component stays, with their own columns.

    The row with the component's smallest doc_id stays (nulls last); of rows that share that
    doc_id the one whose digest over all columns is smallest, so the choice depends on the rows
    alone and not on where they lie. Texts are shuffled once, on fingerprint and doc_id together.
    """
    fp, owner = "__llm_fp", "__llm_owner"
    prints = stored(with_fingerprint(docs.select("doc_id", "text"), "fp", width=width).drop("text"), "prints")
    winners = (
        _groups(prints, max_bits)
        .select(F.col("owner").alias(fp), F.col("component_id").alias(owner))
        .distinct()
    )
    marked = with_fingerprint(docs, fp, width=width)
    kept = marked.join(
        winners, (marked[fp] == winners[fp]) & marked["doc_id"].eqNullSafe(winners[owner]), "left_semi"
    )
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    best = kept.groupBy(fp, "doc_id").agg(F.min_by(whole, row_digest(docs.columns)).alias("__llm_row"))
    return best.select(*[F.col("__llm_row")[c].alias(c) for c in docs.columns])
