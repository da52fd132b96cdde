"""WARC archives as seekable Zstandard bundles.

Writing: each task writes one archive. Records are grouped into independent frames of about
`FRAME_BYTES`; a footer frame that decoders skip lists the sizes of all frames, so a reader finds any frame
without reading those before it. The index maps each record to (archive, frame, offset in the frame).
Reading walks an archive frame by frame through its seek table; `lookup` reads single records.

Deduplication: of records with equal payloads the one with the smallest id is a `response`, the others are
`revisit` records that refer to it and carry no payload, if the payload has at least `min_bytes` bytes.

Archives go to the shared folder of the session under a name made of the partition number and the task's attempt, and
the index names the attempts that counted: a lost or doubled task cannot mix two versions of an archive.

Cases: a null payload is an empty one; a null id never becomes the record others refer to unless all
equal payloads have null ids, and then all stay responses; repeated rows (same id and payload) with the
smallest id are all responses; a record larger than a frame is a frame of its own; an empty table gives no
archive and an empty index; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import checkpoint_folder, cut

FRAME_BYTES = 1 << 20
LEVEL = 3
#: fixed values of the seekable format: skippable frame, footer
SKIPPABLE_MAGIC, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
ENTRY, FOOTER = struct.Struct("<II"), struct.Struct("<IBI")

INDEX = "page_id long, archive string, frame long, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, kind: str) -> bytes:
    """One WARC 1.1 record; a revisit has an empty block but the digest and size of its full payload."""
    block = payload if kind == "response" else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {' '.join(url.split())}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Bytes: {len(payload)}",
    ]
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and the end of the record that starts at `at`."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    start = end + 4
    stop = start + int(headers["Content-Length"])
    return headers, data[start:stop], stop + 4


class BundleWriter:
    """Frames of whole records, then the seek table."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.sink, self.frame_bytes = sink, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.sizes: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.held = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number and offset in the frame of the added record."""
        if self.held and self.held + len(data) > self.frame_bytes:
            self.flush()
        place = len(self.sizes), self.held
        self.parts.append(data)
        self.held += len(data)
        return place

    def flush(self) -> None:
        if self.parts:
            frame = self.compressor.compress(b"".join(self.parts))
            self.sizes.append((len(frame), self.held))
            self.sink.write(frame)
            self.parts, self.held = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(ENTRY.pack(*sizes) for sizes in self.sizes) + FOOTER.pack(len(self.sizes), 0, SEEK_MAGIC)
        self.sink.write(ENTRY.pack(SKIPPABLE_MAGIC, len(table)) + table)


class BundleReader:
    """Frames of a seekable file by number."""

    def __init__(self, source):
        import zstandard

        self.source = source
        self.decompressor = zstandard.ZstdDecompressor()
        size = source.seek(0, io.SEEK_END)
        source.seek(size - FOOTER.size)
        count, _, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table at the end of the archive")
        source.seek(size - FOOTER.size - count * ENTRY.size)
        self.sizes = list(ENTRY.iter_unpack(source.read(count * ENTRY.size)))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, number: int) -> bytes:
        self.source.seek(self.starts[number])
        packed, size = self.sizes[number]
        return self.decompressor.decompress(self.source.read(packed), max_output_size=size)


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _write(folder: str, frame_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, root = _filesystem(folder)
    task = TaskContext.get()
    name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"
    writer, sink = None, None
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if writer is None:
                sink = store.open_output_stream(f"{root}/{name}", compression=None)
                writer = BundleWriter(sink, frame_bytes)
            payload = row["payload"] or b""
            first, own = row["first"], row["page_id"]
            kind = "revisit" if first is not None and first != own else "response"
            data = record(own, row["url"] or "", payload, first, kind)
            rows.append((own, name, *writer.add(data), len(data)))
        if rows:
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                names=["page_id", "archive", "frame", "offset", "length"])
    if writer is not None:
        writer.close()
        sink.close()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Writes all pages under `folder` and returns the index, one row per record."""
    store, root = _filesystem(folder)
    store.create_dir(root, recursive=True)
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
        F.coalesce(pages["html"], F.lit("")).cast("binary").alias("payload"),
    ).withColumn("_key", F.sha2("payload", 256))
    # combined before the shuffle, so that a payload held by many rows is one row per task
    firsts = rows.filter(F.length("payload") >= min_bytes).groupBy("_key").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    marked = rows.join(firsts, "_key", "left").select("page_id", "url", "payload", "first")
    return cut(marked.mapInArrow(lambda batches: _write(folder, frame_bytes, batches), INDEX))


def _read(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, root = _filesystem(folder)
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        for name in batch.column(0).to_pylist():
            with store.open_input_file(f"{root}/{name}") as source:
                bundle = BundleReader(source)
                for number in range(len(bundle.sizes)):
                    rows = [described(*found) for found in records(bundle.frame(number))]
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)


def records(frame: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(frame):
        headers, block, at = parse(frame, at)
        yield headers, block


def described(headers: dict[str, str], block: bytes) -> dict:
    """The digest columns of one record; a response's payload is checked against its digest."""
    def number(header: str) -> int | None:
        value = headers.get(header, "").removeprefix("<urn:page:").removesuffix(">")
        return int(value) if value else None

    found = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response" and digest(block) != found:
        raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
    return {"page_id": number("WARC-Record-ID"), "payload_bytes": int(headers["X-Payload-Bytes"]),
            "payload_digest": found, "record_type": headers["WARC-Type"], "refers_to": number("WARC-Refers-To")}


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """All records of the archives that the index names, one task per archive."""
    names = cut(index.select("archive").distinct())
    # a stated number of partitions is not merged again because the names are small
    return names.repartition(max(1, names.count()), "archive").mapInArrow(lambda batches: _read(folder, batches), RECORDS)


def lookup(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, record_type, block) of single index rows, decoding only the frames they lie in."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("block", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['archive']}") as source:
                    headers, block, _ = parse(BundleReader(source).frame(row["frame"]), row["offset"])
                yield pa.RecordBatch.from_pylist(
                    [{"page_id": row["page_id"], "record_type": headers["WARC-Type"], "block": block}], schema=schema)

    return index.select("page_id", "archive", "frame", "offset").mapInArrow(
        find, "page_id long, record_type string, block binary")


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the archives to a folder of the session's shared one and describes what is read back."""
    folder = f"{checkpoint_folder(pages.sparkSession).rstrip('/')}/warc-{uuid4().hex}"
    return read_archives(write_archives(pages, folder, min_bytes), folder)
