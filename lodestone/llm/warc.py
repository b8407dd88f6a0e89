r"""WARC archives as seekable Zstandard bundles.

Each partition writes one archive: records go into independent frames, and a seek table in
a skippable frame ends the file. The index maps a record's identifier to its archive, its
frame and its offset within the frame, so that one record costs one frame to read.

Of records with equal payloads of at least ``least_bytes`` bytes the one with the smallest
id is a response and the others are revisits of it; smaller ones are all responses.

Defined results: a null payload is empty; a null url is an empty one. Repeated rows of one
id and payload are equals: if theirs is the smallest id they are responses all. A null id
comes after all others; where no equal has an id, all are responses. An empty table gives
an empty index. Payloads are written whole. Only the columns named are read.

Files are written under a name of the attempt and then moved, and rows are sorted before
they are written, so that a repeated task leaves the same file. Paths go through Arrow's
file systems, so the folder can be in any store that they open.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import slices
from lodestone.session import shared_dir, stored

#: Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, FRAME_RECORDS, LEVEL = 1 << 18, 64, 3
DATE = "1970-01-01T00:00:00Z"
_END = b"\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text or "")


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool, date: str = DATE) -> bytes:
    """The bytes of one WARC record; a revisit has no payload of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>",
        f"WARC-Target-URI: {_line(url)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record at an offset."""
    head = data.index(_END, at)
    lines = data[at:head].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record starts here")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return headers, data[head + 4 : head + 4 + int(headers["Content-Length"])]


class BundleWriter:
    """Groups records into frames and ends the file with the seek table."""

    def __init__(self, sink):
        self.sink, self.compressor = sink, zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.size = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        if self.parts and (self.size + len(data) > FRAME_BYTES or len(self.parts) >= FRAME_RECORDS):
            self.flush()
        at = len(self.frames), self.size
        self.parts.append(data)
        self.size += len(data)
        return at

    def flush(self) -> None:
        if self.parts:
            packed = self.compressor.compress(b"".join(self.parts))
            self.sink.write(packed)
            self.frames.append((len(packed), self.size))
            self.parts, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class BundleReader:
    """Reads single frames by the seek table; keeps the last one."""

    def __init__(self, source):
        self.source, self.last = source, (-1, b"")
        source.seek(source.size() - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        source.seek(source.size() - 9 - n * width)
        table = source.read(n * width)
        self.spans, at = [], 0
        for i in range(n):
            packed, size = struct.unpack_from("<II", table, i * width)
            self.spans.append((at, packed, size))
            at += packed

    def frame(self, i: int) -> bytes:
        if self.last[0] != i:
            at, packed, size = self.spans[i]
            self.source.seek(at)
            self.last = i, zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=size)
        return self.last[1]


def decide(pages: DataFrame, *, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, payload, refers_to (null: response)."""
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload")
    ).withColumn("sha", F.sha1(F.col("payload"))).withColumn("n", F.octet_length("payload"))
    first = rows.where(F.col("n") >= least_bytes).groupBy(F.col("sha").alias("k_sha"), F.col("n").alias("k_n")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("many"))
    # only payloads that repeat have a decision to join; unique ones pass by
    joined = rows.join(first.where("many > 1"), (F.col("sha") == F.col("k_sha")) & (F.col("n") == F.col("k_n")), "left")
    return joined.select("id", "url", "payload", F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str, *, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives into ``folder``; returns the index: id, archive, frame, offset, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        context = TaskContext.get()
        final = f"part-{context.partitionId():05d}.warc.zst"
        draft = f"{root}/.{final}.{context.taskAttemptId()}"
        writer = sink = None
        for b in slices(batches):
            if sink is None:
                sink = where.open_output_stream(draft)
                writer = BundleWriter(sink)
            frames, offsets, lengths = [], [], []
            for i in range(b.num_rows):
                page_id, url, payload, refers = (c[i].as_py() for c in b.columns)
                data = record(page_id, url, payload.encode("utf-8", "replace"), refers, refers is not None)
                frame, offset = writer.add(data)
                frames.append(frame), offsets.append(offset), lengths.append(len(data))
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([final] * n, pa.string()), *(pa.array(x, pa.int64()) for x in (frames, offsets, lengths))], ["id", "archive", "frame", "offset", "length"]
            )
        if sink is not None:
            writer.close()
            sink.close()
            where.move(draft, f"{root}/{final}")

    rows = decide(pages, least_bytes=least_bytes, id_col=id_col, url_col=url_col, html_col=html_col)
    # sorting makes a repeated task write the same file
    dealt = rows.select(F.col("id").cast("string").alias("id"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to"))
    return dealt.sortWithinPartitions("id", "url", "refers_to").mapInArrow(run, "id string, archive string, frame long, offset long, length long")


def fetch(index: DataFrame, folder: str, *, with_payload: bool = False) -> DataFrame:
    """The records that index rows point to: page_id, url, record_type, payload_bytes, payload_digest, refers_to and, if asked, payload.

    Digest and size of a response are taken from the payload as read, and must agree with the header.
    """
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(folder)
        name, reader = None, None
        for b in batches:
            rows = []
            for archive, frame, offset in zip(*(b.column(c).to_pylist() for c in ("archive", "frame", "offset")), strict=True):
                if archive != name:
                    name, reader = archive, BundleReader(where.open_input_file(f"{root}/{archive}"))
                headers, block = parse(reader.frame(frame), offset)
                at = block.index(_END) + 4
                payload, kind, said = block[at:], headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(block[:at].rsplit(b"Content-Length: ", 1)[1])
                if kind == "response" and (digest(payload) != said or len(payload) != size):
                    raise ValueError(f"{archive}: a payload is not what its header says")
                rows.append((headers.get("X-Page-ID"), headers["WARC-Target-URI"], kind, size, said, headers.get("X-Refers-To-Page-ID"), payload.decode() if kind == "response" else None))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][: len(names)], names)

    schema = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string" + ", payload string" * with_payload
    return index.select("archive", "frame", "offset").mapInArrow(run, schema)


def round_trip(pages: DataFrame, *, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the pages into a new folder beside the checkpoints and reads every record back by the index."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    index = stored(write_bundles(pages, folder, least_bytes=least_bytes, id_col=id_col, url_col=url_col, html_col=html_col), "warc-index")
    kind = pages.schema[id_col].dataType
    out = fetch(index, folder)
    return out.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


#: The query in SQL.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
x AS (
  SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes, p.h, first,
         array_to_string(list_transform(range(1, 41), lambda j: lpad(bin(instr('0123456789abcdef', substr(sha1(p.h), j::INT, 1)) - 1), 4, '0')), '') AS bits
  FROM p JOIN f ON p.h = f.h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * substr(bits, (5 * i + 1)::INT, 1)::INT + 8 * substr(bits, (5 * i + 2)::INT, 1)::INT + 4 * substr(bits, (5 * i + 3)::INT, 1)::INT
           + 2 * substr(bits, (5 * i + 4)::INT, 1)::INT + substr(bits, (5 * i + 5)::INT, 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM x
"""
