"""WARC archives in seekable Zstandard bundles.

Every task writes one bundle: records are grouped into frames of about ``FRAME`` bytes, each frame
is compressed on its own, and a skippable frame at the end holds the seek table (Zstandard seekable
format: sizes of each frame, then count, flags and magic number). Beside the bundle lies a record
map: for each record identifier its frame, its offset in the frame and its length. A reader gets a
record by the map's entry and one frame, without reading the rest.

Equal payloads are found before writing: of equal payloads of at least ``min_bytes`` the one with
the largest id is a response, the others are revisit records that refer to it. Payloads are grouped
by SHA-256 with partial aggregation; rows of very common payloads are joined with a broadcast of
at most HOT_SHARE groups (common.join_groups), so no task gets all copies of a payload.

A task that runs twice writes two bundles; only the one that the stored manifest names is read.

Defined results
- A null payload is empty; a null url is left out of the record's head.
- Rows that repeat the largest id of a payload are each a response. A row with a null id is a
  response too and is never referred to, unless all rows of its payload have null ids.
- An empty table writes nothing and gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectral_topics.functions.storage import materialize
from spectral_topics.llm.common import arrow_map, filesystem, forget, join_groups, new_folder, quoted

FRAME = 1 << 18
LEVEL = 3
# Fixed values of the Zstandard seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

RECORD_MAP = pa.schema([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])


def roles(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """``(id, url, payload, refers_to)``: ``refers_to`` is the response's id for a revisit, else null."""
    payload = F.coalesce(quoted(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(quoted(id_col).cast("long").alias("id"), quoted(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = materialize(
        rows.groupBy("digest").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")), "payload-groups"
    )
    revisit = (F.col("id") < F.col("keep")) & (F.octet_length("payload") >= min_bytes)
    joined = join_groups(rows, groups, "digest", "n", "id")
    return joined.select("id", "url", "payload", F.when(revisit, F.col("keep")).alias("refers_to"))


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP head, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head.append(f"WARC-Refers-To: {record_id(refers_to)}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Head fields, HTTP fields and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, _fields(http), payload


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


class BundleWriter:
    """A file of independent frames with a seek table at its end, and its record map."""

    def __init__(self, path: str, frame: int = FRAME, level: int = LEVEL) -> None:
        import zstandard

        self.compressor = zstandard.ZstdCompressor(level=level)
        self.frame = frame
        fs, place = filesystem(path)
        fs.create_dir(place.rpartition("/")[0], recursive=True)
        self.sink = fs.open_output_stream(place, compression=None)
        self.map_sink = fs.open_output_stream(place + ".map", compression=None)
        self.map = pa.ipc.new_stream(self.map_sink, RECORD_MAP)
        self.held: list[bytes] = []
        self.entries: list[tuple[str, int, int, int]] = []
        self.size = 0
        self.frames: list[tuple[int, int]] = []

    def add(self, identifier: str, data: bytes) -> None:
        self.entries.append((identifier, len(self.frames), self.size, len(data)))
        self.held.append(data)
        self.size += len(data)
        if self.size >= self.frame:
            self._flush()

    def _flush(self) -> None:
        if not self.held:
            return
        packed = self.compressor.compress(b"".join(self.held))
        self.sink.write(packed)
        self.frames.append((len(packed), self.size))
        self.map.write_batch(pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*self.entries, strict=True), RECORD_MAP, strict=True)], schema=RECORD_MAP))
        self.held, self.entries, self.size = [], [], 0

    def close(self) -> None:
        self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), 0, SEEKABLE))
        self.map.close()
        self.sink.close()
        self.map_sink.close()


class Bundle:
    """Reads frames of a bundle by number, and records by their map entry."""

    def __init__(self, path: str) -> None:
        import zstandard

        self.decompressor = zstandard.ZstdDecompressor()
        self.fs, self.place = filesystem(path)
        self.file = self.fs.open_input_file(self.place)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or flags:
            raise ValueError(f"{path} has no seek table of the written kind")
        table = struct.unpack(f"<{2 * count}I", self.file.read_at(8 * count, size - 9 - 8 * count))
        self.frames, at = [], 0
        for packed, plain in zip(table[::2], table[1::2], strict=True):
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        return self.decompressor.decompress(self.file.read_at(packed, at), max_output_size=plain)

    def maps(self) -> Iterator[pa.RecordBatch]:
        """Map entries, a batch for each frame."""
        with self.fs.open_input_stream(self.place + ".map", compression=None) as source:
            yield from pa.ipc.open_stream(source)

    def record(self, identifier: str) -> bytes:
        for part in self.maps():
            for found, frame, offset, length in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if found == identifier:
                    return self.frame(frame)[offset : offset + length]
        raise KeyError(identifier)


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record for each page into bundles; the stored manifest ``(path, n_records)``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        path, out, n = f"{folder}/{uuid.uuid4().hex}.warc.zst", None, 0
        for rows in batches:
            payloads = rows.column("payload")
            for i, (page, url, refers) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("id", "url", "refers_to")), strict=True)):
                out = out or BundleWriter(path)
                out.add(record_id(page), record(page, url, payloads[i].as_py(), refers, date))
                n += 1
        if out:
            out.close()
            yield pa.record_batch([pa.array([path]), pa.array([n])], names=["path", "n_records"])

    return materialize(arrow_map(roles(pages, id_col, url_col, payload_col, min_bytes), write, "path string, n_records long"), "warc-manifest")


def read_warc(manifest: DataFrame) -> DataFrame:
    """``(record_id, record_type, refers_to, payload_bytes, payload_digest, url)`` of every record in the bundles.

    Responses are measured by their payloads; a revisit's length and digest are those in its heads.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "url"]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for paths in batches:
            for path in paths.column("path").to_pylist():
                bundle = Bundle(path)
                for part in bundle.maps():
                    found = []
                    at, data = None, b""
                    for identifier, frame, offset, length in zip(*(c.to_pylist() for c in part.columns), strict=True):
                        if frame != at:
                            at, data = frame, bundle.frame(frame)
                        head, http, payload = parse(data[offset : offset + length])
                        if head["WARC-Record-ID"] != identifier:
                            raise ValueError(f"{path}: the map leads to another record than {identifier}")
                        revisit = head["WARC-Type"] == "revisit"
                        size = int(http["Content-Length"]) if revisit else len(payload)
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else sha1_base32(payload)
                        found.append((identifier, head["WARC-Type"], head.get("WARC-Refers-To"), size, digest, head.get("WARC-Target-URI")))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=names)

    dealt = manifest.repartition(max(1, manifest.count()), "path")
    schema = "record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string, url string"
    return arrow_map(dealt, read, schema)


def page_of(identifier: Column) -> Column:
    """The page id in a record identifier; null where there is none."""
    number = F.regexp_extract(identifier, r"^<urn:page:(-?[0-9]*)>$", 1)
    return F.when(number != "", number.cast("long"))


def warc_round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write all pages and describe them as read back from the archives."""
    return read_warc(write_warc(pages, folder or new_folder(pages.sparkSession, "warc"), **options))

