"""WARC archives as seekable Zstandard bundles.

Records go into bundles, several megabytes each; a bundle is a row of independent Zstandard frames of a few records, and its footer,
in the public seekable format, has every frame's sizes. An index maps each record identifier to (bundle, frame, offset in the
frame), so that one record is read by decompressing one frame.

Equal payloads of at least `least` bytes are stored once: the record with the smallest id is a response, the others
revisit it. A payload that many records share is never gathered in one task: its few facts are broadcast and its records stay where
they are. Bundles are written by the task that has the records under a name of its own and moved into place when they are whole,
so a task that runs again leaves the same result.

A null html is empty. Rows that repeat an id and payload have the same type and identifier. A null id refers to the group's smallest id that
is not null; with none, it is a response. A null url gives no target. An empty table gives an empty archive.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_path
from .common import attach, batch, written

#: Payloads shorter than this are always stored.
LEAST_BYTES = 100
#: Raw bytes after which a frame, and a bundle, ends.
FRAME, BUNDLE = 1 << 18, 64 << 20
DATE = "1970-01-01T00:00:00Z"
# The public seekable format: a skippable frame with the table, its magic numbers, one descriptor byte.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def _open(path: str):
    """File system and path within it; any store that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record_id(page_id, digest: str) -> str:
    """Of the id and the payload: rows that repeat an id with another payload are records of their own."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}').urn}>"


def record(page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to, response: bool) -> bytes:
    """One WARC/1.1 record; a revisit has no payload, only its digest and size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if response else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {''.join(url.split())}")
    if not response:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and end of the record that begins at `at`."""
    top = data.index(b"\r\n\r\n", at)
    lines = data[at:top].decode().split("\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    end = top + 4 + int(headers["Content-Length"])
    body = data.index(b"\r\n\r\n", top + 4, end) + 4
    if data[end : end + 4] != b"\r\n\r\n" or not lines[0].startswith("WARC/"):
        raise ValueError("not a whole WARC record")
    return headers, data[body:end], end + 4


class Bundle:
    """Writes frames to a file, then the seek table."""

    def __init__(self, path: str):
        self.system, self.path = _open(path)
        self.draft = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.system.open_output_stream(self.draft, compression=None)
        self.sizes: list[tuple[int, int]] = []
        self.buffer, self.held, self.written = [], 0, 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        place = len(self.sizes), self.held
        self.buffer.append(data)
        self.held += len(data)
        self.written += len(data)
        if self.held >= FRAME:
            self._frame()
        return place

    def _frame(self) -> None:
        raw = b"".join(self.buffer)
        packed = zstandard.ZstdCompressor(level=6, write_checksum=True).compress(raw)
        self.out.write(packed)
        self.sizes.append((len(packed), len(raw)))
        self.buffer, self.held = [], 0

    def close(self) -> None:
        if self.buffer:
            self._frame()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        self.system.move(self.draft, self.path)


class Reader:
    """Frames of a bundle by number, found through the footer."""

    def __init__(self, path: str):
        system, name = _open(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        entry = 12 if flags & 0x80 else 8
        table = self.file.read_at(entry * n, size - 9 - entry * n)
        self.frames, at = [], 0
        for i in range(n):
            packed, raw = struct.unpack_from("<II", table, entry * i)
            self.frames.append((at, packed, raw))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, raw = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=raw)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse(self.frame(frame), offset)[:2]

    def close(self) -> None:
        self.file.close()


INDEX = "page_id long, record_id string, bundle string, frame int, offset int"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def write(pages: DataFrame, base: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """Write an archive under `base` and return its index (written, so each record is archived once)."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    size, digest = F.octet_length("html").cast("long"), F.unhex(F.sha2(F.col("html").cast("binary"), 256))
    facts = written(rows.select("page_id", size.alias("n"), digest.alias("digest")), "payloads")
    total = facts.count()
    groups = facts.where((F.col("n") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.count(F.lit(1)).alias("same"), F.min("page_id").alias("first"))
    groups = written(groups.where("same > 1"), "revisits")
    big = rows.withColumn("digest", F.when(size >= least, digest))
    placed = attach(big, groups, "digest", "same", total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, bundle, name, found = TaskContext.get().partitionId(), 0, None, "", []

        def finished() -> pa.RecordBatch:
            bundle.close()
            ids, names, frames, offsets = zip(*found)
            out = batch(INDEX, page_id=list(ids), record_id=list(names), bundle=[name] * len(ids), frame=list(frames), offset=list(offsets))
            found.clear()
            return out

        for some in batches:
            for page_id, address, text, first in zip(*(some.column(i).to_pylist() for i in range(4))):
                payload = text.encode("utf-8", "replace")
                response = first is None or first == page_id
                if bundle is None:
                    name = f"{base}/part-{part:06d}-{count:04d}.warc.zst"
                    bundle, count = Bundle(name), count + 1
                own = hashlib.sha256(payload).hexdigest()
                data = record(page_id, address, payload, own, len(payload), first, response)
                found.append((page_id, record_id(page_id, own), *bundle.add(data)))
                if bundle.written >= BUNDLE:
                    yield finished()
                    bundle = None
        if bundle is not None:
            yield finished()

    _open(base)[0].create_dir(_open(base)[1], recursive=True)
    return written(placed.select("page_id", "url", "html", "first").mapInArrow(run, INDEX), "index")


def read(index: DataFrame) -> DataFrame:
    """Every record of the bundles in the index, read back frame by frame. A payload that does not have its digest is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for name in some.column(0).to_pylist():
                bundle = Reader(name)
                for k in range(len(bundle.frames)):
                    data, at, found = bundle.frame(k), 0, []
                    while at < len(data):
                        headers, payload, at = parse(data, at)
                        digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers["WARC-Type"]
                        http = data[data.index(b"HTTP/1.1", at - 4 - int(headers["Content-Length"])) : at]
                        size = int(http.split(b"Content-Length: ", 1)[1].split(b"\r\n", 1)[0])
                        if kind == "response" and (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
                            raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
                        number = lambda x: int(x) if x else None
                        found.append((number(headers["X-Page-Id"]), size, digest, kind, number(headers.get("X-Refers-To-Page"))))
                    columns = map(list, zip(*found))
                    yield batch(READ, **dict(zip(("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), columns)))
                bundle.close()

    return index.select("bundle").distinct().mapInArrow(run, READ)


def lookup(index: DataFrame, ids: list[int]) -> dict[int, tuple[dict[str, str], bytes]]:
    """Headers and payload of a few pages, each from one frame; of rows that repeat an id the record with the smallest identifier."""
    out = {}
    for r in index.where(F.col("page_id").isin(ids)).groupBy("page_id").agg(F.min(F.struct("record_id", "bundle", "frame", "offset")).alias("r")).select("page_id", "r.*").collect():
        bundle = Reader(r.bundle)
        out[r.page_id] = bundle.record(r.frame, r.offset)
        bundle.close()
    return out


def round_trip(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Write all pages and read the archive back."""
    return read(write(pages, new_path(pages.sparkSession, "warc"), least=least))
