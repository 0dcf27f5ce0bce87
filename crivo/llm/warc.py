"""WARC archives of pages: gzip members written by tasks, read back by byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crivo.llm.common import stored
from crivo.session import scratch_path, ship_package

MAGIC = b"\x1f\x8b\x08"
#: Bytes a reading task owns, and bytes fetched or decoded at a time.
SPLIT_BYTES, CHUNK = 16 << 20, 1 << 18
#: Size at which a task starts another archive.
ARCHIVE_BYTES = 1 << 30
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
COLUMNS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
    ("path", pa.string()), ("offset", pa.int64()),
])
DDL = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary, path string, offset long"
)


def base32(digest: bytes) -> str:
    """A digest as archives write it."""
    return base64.b32encode(digest).decode()


def _plain(value: str | None) -> str:
    """Header text on one line."""
    return re.sub(r"[\r\n]+", " ", value or "")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit that names the response."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_plain(url)}",
        f"WARC-Payload-Digest: sha1:{base32(bytes.fromhex(digest))}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is None:
        body += payload
    else:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(body)}")
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds `payload`, `digest` and `original` (page_id of the response) to each page.

    Equal payloads have one digest and one length. Lengths and largest ids are summed before the
    shuffle; pages join their group by sort-merge, of which the planner splits a hot group.
    """
    rows = pages.select(
        "page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    size = F.length("payload").alias("size")
    groups = (
        rows.select("digest", size, "page_id")
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
        .filter(F.col("n") > 1)
        .select(F.col("digest").alias("group_digest"), F.col("size").alias("group_size"), "original")
    )
    same = (F.col("digest") == F.col("group_digest")) & (F.length("payload") == F.col("group_size"))
    large = F.length("payload") >= min_bytes
    return rows.join(groups, same, "left").select(
        "page_id", "url", "payload", "digest",
        F.when(large & ~F.col("original").eqNullSafe(F.col("page_id")), F.col("original")).alias("original"),
    )


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record per page under `folder` and returns the manifest: `path`, `bytes`, `records`.

    Of records with equal payloads of at least `min_bytes`, that with the largest page_id is the
    response and the others revisit it; rows that repeat this page_id are responses too, and a
    null page_id never is the largest while another exists. Null html is an empty payload, a null
    url an empty header. An empty table writes no archive. Columns other than page_id, url and html
    are ignored.

    A file name belongs to one attempt of one task and only finished attempts reach the manifest,
    so a lost or repeated task leaves an unused file and never a broken archive.
    """

    ship_package(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        part, done, out, size, count, name = TaskContext.get().partitionId(), [], None, 0, 0, ""
        for batch in batches:
            for page_id, url, payload, digest, original in zip(*[c.to_pylist() for c in batch.columns]):
                if out is not None and size >= archive_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", size, count))
                    out = None
                if out is None:
                    name, size, count = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20)
                record = make_record(page_id, url, payload, digest, original)
                out.write(record)
                size, count = size + len(record), count + 1
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, count))
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*done)], names=["path", "bytes", "records"]
            )

    written = with_originals(pages, min_bytes).mapInArrow(write, "path string, bytes long, records long")
    return stored(written, "manifest")


class View:
    """Bytes of a file from a moving position on, fetched in chunks."""

    def __init__(self, source: pa.NativeFile, at: int):
        self.source, self.at, self.data = source, at, bytearray()
        source.seek(at)

    def more(self) -> bool:
        """Fetches the next chunk; false at the end of the file."""
        got = self.source.read(CHUNK)
        self.data += got
        return bool(got)

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.at += n


def _header_end(raw: bytes) -> int:
    """Where the header of a record ends; 0 if it may still come, -1 if this is no record."""
    if not b"WARC/1."[: len(raw)] == raw[:7]:
        return -1
    end = raw.find(b"\r\n\r\n")
    if end >= 0:
        return end + 4 if b"\r\nWARC-Type: " in raw[:end] else -1
    return 0


def _member(view: View) -> bytes | None:
    """Decodes the member at the window's start and moves past it; None if it isn't a record.

    The header is checked as soon as it is decoded, so a false candidate costs little; the
    checksum at the member's end is the decoder's.
    """
    decoder, out, used, checked = zlib.decompressobj(31), bytearray(), 0, False
    while not decoder.eof:
        if used == len(view.data) and not view.more():
            return None
        piece = bytes(view.data[used : used + CHUNK])
        try:
            out += decoder.decompress(piece)
        except zlib.error:
            return None
        used += len(piece) - len(decoder.unused_data)
        if not checked:
            end = _header_end(bytes(out))
            if end < 0:
                return None
            checked = end > 0
    if not checked:
        return None
    view.drop(used)
    return bytes(out)


def members(source: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the members that start in the byte range, however far they reach."""
    view = View(source, start)
    while True:
        found = view.data.find(MAGIC)
        if found < 0:
            view.drop(max(0, len(view.data) - len(MAGIC) + 1))
            if view.at >= end or not view.more():
                return
            continue
        view.drop(found)
        if (at := view.at) >= end:
            return
        record = _member(view)
        if record is None:
            view.drop(1)
        else:
            yield at, record


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-cased names) and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    fields = {k.lower(): v for k, v in fields.items()}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _row(raw: bytes, path: str, offset: int) -> tuple:
    """Values of the columns; the digest of a response is checked against its payload."""
    fields, payload = parse_record(raw)
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and base32(hashlib.sha1(payload).digest()) != digest:
        raise ValueError(f"{path}: the payload at {offset} has another digest than its header")

    def number(name: str) -> int | None:
        text = fields.get(name, "")[len("<urn:page:") : -1]
        return int(text) if text else None

    return (
        number("warc-record-id"), fields.get("warc-target-uri"), kind, number("warc-refers-to"),
        int(fields["x-payload-length"]), digest, payload if kind == "response" else None, path, offset,
    )


def read_warc(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of the archives in the manifest (`path`, `bytes`): page_id, url, record_type,
    refers_to, payload_bytes, payload_digest, payload (null for a revisit), path, offset.

    Archives are cut into byte ranges; a task searches its range for the magic of a gzip member,
    decodes candidates until the header proves a record, and owns the records that start inside.
    An empty manifest gives no rows. If the manifest has `records`, they are counted first, and
    another number than its sum is an error.
    """
    ship_package(manifest.sparkSession)
    cuts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))
    ranges = manifest.filter("bytes > 0").select("path", "bytes", F.explode(cuts).alias("start"))
    tasks = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*[c.to_pylist() for c in batch.columns]):
                files, place = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with files.open_input_file(place) as source:
                    for offset, raw in members(source, start, min(start + split_bytes, size)):
                        rows.append(_row(raw, path, offset))
                        held += len(raw)
                        if held > 1 << 24:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = 0
            for path, size, start in zip(*[c.to_pylist() for c in batch.columns]):
                files, place = fs.FileSystem.from_uri(path)
                with files.open_input_file(place) as source:
                    found += sum(1 for _ in members(source, start, min(start + split_bytes, size)))
            yield pa.RecordBatch.from_arrays([pa.array([found], pa.int64())], names=["n"])

    dealt = ranges.repartition(int(tasks))
    if "records" in manifest.columns:
        written = manifest.agg(F.sum("records")).first()[0] or 0
        found = dealt.mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
        if found != written:
            raise ValueError(f"{found} records in archives of {written}")
    return dealt.mapInArrow(read, DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kind) for values, kind in zip(zip(*rows), COLUMNS.types)], schema=COLUMNS
    )


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives under the shared one."""
    return scratch_path(spark, "warc")
