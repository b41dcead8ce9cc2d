"""WARC records in seekable zstandard bundles.

A bundle is a file of independent zstandard frames, each with some records,
and a seek table at its end: a skippable frame that lists the packed and plain
size of every frame. Any zstandard reader can unpack a bundle from the start;
a reader that knows the seek table can open one frame alone. ``write`` returns
an index row per record: bundle, frame, and the record's place in the unpacked
frame. ``read`` goes back through those places.

Bundles are written by the tasks, under a name that an attempt has to itself,
and renamed when complete. An attempt that is lost may leave a bundle or a draft
that no index row names; the index is what counts. The folder must be one that
all executors share.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import col
from emberlog.session import stage

# Payloads from this size on are stored once and referred to after that.
LEAST_BYTES = 1000
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
LEVEL = 3
# Up to so many repeated digests (some 60 bytes each) are sent to the tasks; more are joined.
BROADCAST_DIGESTS = 200_000
# Unpacked bytes that one task reads back.
READ_BYTES = 64 << 20
# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX = ("record_key long, bundle string, frame long, frame_offset long, frame_bytes long, frame_plain long,"
         " record_offset long, record_bytes long")
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
         least_bytes: int = LEAST_BYTES) -> DataFrame:
    """What is to be written: ``page_id, url, body, digest, bytes, refers_to``.

    Of rows with equal payloads of at least ``least_bytes`` bytes, the one with
    the largest id is the response; the others have its id in ``refers_to``. A
    null payload is empty. Rows that share the largest id are all responses, as
    are rows without an id when none of their equals has one; a row without an
    id otherwise refers to the largest. Smaller payloads are all responses.
    """
    body = F.coalesce(col(body_col).cast("binary"), F.lit(b""))
    rows = pages.select(col(id_col).cast("long").alias("page_id"), col(url_col).alias("url"), body.alias("body"))
    rows = rows.withColumns({"digest": F.sha1("body"), "bytes": F.octet_length("body").cast("long")})
    # Payloads take no part in the look-up: only keys do.
    keys = rows.filter(F.col("bytes") >= least_bytes).select("digest", "page_id")
    repeated = keys.groupBy("digest").agg(F.max("page_id").alias("latest"), F.count("*").alias("n"))
    repeated = stage(repeated.filter((F.col("n") > 1) & F.col("latest").isNotNull()).select("digest", "latest"), "warc_repeated")
    names = ("page_id", "url", "body", "digest", "bytes")
    again = (F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("latest"))
    refers = F.when(again, F.col("latest")).alias("refers_to")
    if repeated.count() <= BROADCAST_DIGESTS:
        # Every payload is written from where it lies.
        return rows.join(F.broadcast(repeated), "digest", "left").select(*names, refers)
    # More are looked up by digest and id, so that one payload's rows are dealt to many tasks;
    # small payloads stay where they lie.
    found = keys.distinct().join(repeated, "digest").filter(~F.col("page_id").eqNullSafe(F.col("latest")))
    found = stage(found.select(F.struct("digest", "page_id").alias("key"), F.col("latest").alias("refers_to")), "warc_revisits")
    large = rows.filter(F.col("bytes") >= least_bytes).withColumn("key", F.struct("digest", "page_id"))
    small = rows.filter(F.col("bytes") < least_bytes).select(*names, F.lit(None).cast("long").alias("refers_to"))
    return small.unionByName(large.join(found, "key", "left").select(*names, "refers_to"))


def write(planned: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write the planned records under ``folder`` and return their index.

    The index is computed by writing; keep it (``session.stage``) and do not
    evaluate it twice. No rows write no bundle.
    """
    rows = planned.select("page_id", "url", "body", "digest", "bytes", "refers_to")
    return rows.mapInArrow(_writer(folder, frame_bytes, bundle_bytes), INDEX)


def _writer(folder: str, frame_bytes: int, bundle_bytes: int):
    level, names = LEVEL, [x.split()[0] for x in INDEX.split(", ")]
    types = [pa.string() if " string" in x else pa.int64() for x in INDEX.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, index = Bundle(folder, level), []
        for batch in batches:
            for row in batch.to_pylist():
                at, record = bundle.plain_bytes, record_bytes(row)
                bundle.add(record)
                index.append([row["page_id"], bundle.name, len(bundle.frames), bundle.packed_bytes, 0, 0, at, len(record)])
                if bundle.plain_bytes >= frame_bytes:
                    yield packed(bundle, index)
                    index = []
                    if bundle.packed_bytes >= bundle_bytes:
                        bundle.close()
                        bundle = Bundle(folder, level)
        if index:
            yield packed(bundle, index)
        bundle.close()

    def packed(bundle, index):
        size, plain = bundle.end_frame()
        for entry in index:
            entry[4:6] = size, plain
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), types)], names)

    return work


class Bundle:
    """One file in the making. Nothing is left behind if no frame was added."""

    def __init__(self, folder: str, level: int):
        self.store, root = fs.FileSystem.from_uri(folder)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.done, self.draft = f"{root}/{self.name}", f"{root}/.{self.name}.draft"
        self.root, self.packer = root, zstandard.ZstdCompressor(level=level)
        self.out, self.pending, self.frames = None, bytearray(), []
        self.packed_bytes = 0

    @property
    def plain_bytes(self) -> int:
        """Bytes of the frame being filled."""
        return len(self.pending)

    def add(self, record: bytes) -> None:
        self.pending += record

    def end_frame(self) -> tuple[int, int]:
        if self.out is None:
            self.store.create_dir(self.root, recursive=True)
            self.out = self.store.open_output_stream(self.draft)
        frame, plain = self.packer.compress(bytes(self.pending)), len(self.pending)
        self.out.write(frame)
        self.frames.append((len(frame), plain))
        self.packed_bytes += len(frame)
        self.pending.clear()
        return len(frame), plain

    def close(self) -> None:
        if self.out is None:
            return
        self.out.write(seek_table(self.frames))
        self.out.close()
        self.store.move(self.draft, self.done)


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle: sizes per frame, then the footer."""
    entries = b"".join(struct.pack("<II", size, plain) for size, plain in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, packed size, plain size) of each frame of an open bundle."""
    end = file.seek(0, 2)
    file.seek(end - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    file.seek(end - 9 - count * width)
    raw, found, at = file.read(count * width), [], 0
    for i in range(count):
        size, plain = struct.unpack_from("<II", raw, i * width)
        found.append((at, size, plain))
        at += size
    return found


def record_bytes(row: dict) -> bytes:
    """One record: a response with its payload, or a revisit without."""
    key = "null" if row["page_id"] is None else str(row["page_id"])
    revisit = row["refers_to"] is not None
    block = b"" if revisit else row["body"]
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_urn(key, row['digest'])}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{row['digest']}",
        f"X-Page-Id: {key}", f"X-Payload-Length: {row['bytes']}", "Content-Type: text/html; charset=utf-8",
    ]
    if row["url"] is not None:
        head.append(f"WARC-Target-URI: {_one_line(row['url'])}")
    if revisit:
        head += [f"WARC-Refers-To: <{_urn(str(row['refers_to']), row['digest'])}>", f"X-Refers-To-Page: {row['refers_to']}",
                 f"WARC-Profile: {REVISIT_PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _urn(key: str, digest: str) -> str:
    """A record's id, from the page's id and its payload: pages that share an id have records of their own."""
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{key} {digest}'.encode()).digest()[:16])}"


def _one_line(text: str) -> str:
    """Header values end at the line's end: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 else c for c in text)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    split = data.index(b"\r\n\r\n")
    lines = data[:split].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a record")
    head = dict(line.split(": ", 1) for line in lines[1:])
    start, size = split + 4, int(head["Content-Length"])
    if data[start + size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return head, data[start:start + size]


def read(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """The records an index points to, each frame unpacked once.

    ``payload`` is a response's payload and null for a revisit. A record whose
    payload does not have the digest it claims raises an error.
    """
    total = index.agg(F.coalesce(F.sum("record_bytes"), F.lit(0))).first()[0]
    # By an explicit number: the index is far smaller than what it points to.
    spread = index.repartition(-(-total // READ_BYTES) + 1, "bundle", "frame")
    frames = spread.groupBy("bundle", "frame", "frame_offset", "frame_bytes", "frame_plain").agg(
        F.sort_array(F.collect_list(F.struct("record_offset", "record_bytes"))).alias("places"))
    return frames.mapInArrow(_reader(folder), RECORD)


def _reader(folder: str):
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in RECORD.split(", ")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{root}/{row['bundle']}") as file:
                    file.seek(row["frame_offset"])
                    plain = unpack.decompress(file.read(row["frame_bytes"]), max_output_size=row["frame_plain"])
                found = [rebuilt(plain[p["record_offset"]:p["record_offset"] + p["record_bytes"]]) for p in row["places"]]
                yield pa.RecordBatch.from_pylist(found, schema)

    def rebuilt(data):
        head, block = parse_record(data)
        response = head["WARC-Type"] == "response"
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if response and hashlib.sha1(block).hexdigest() != digest:
            raise ValueError("a payload was damaged")
        key, refers = head["X-Page-Id"], head.get("X-Refers-To-Page")
        return dict(zip(names, (
            None if key == "null" else int(key), head.get("WARC-Target-URI"), head["WARC-Type"],
            None if refers is None else int(refers), digest, int(head["X-Payload-Length"]), block if response else None)))

    return work
