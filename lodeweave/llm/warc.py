"""Dictionary-compressed WARC archives."""

from __future__ import annotations

import base64
import hashlib
import math
import struct
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import shared_dir

#: Uncompressed bytes of records in one archive: they are held until its dictionary is built.
FILE_BYTES = 32 << 20
DICT_BYTES = 110 << 10
#: Samples that a dictionary is trained on, at least; and their bytes at most, which only pages over 32 MB exceed.
SAMPLES = 16
TRAIN_BYTES = 2 * FILE_BYTES
LEVEL = 6
#: The first four bytes of the skippable frame that holds the dictionary.
SKIPPABLE = 0x184D2A5D
#: The date of records whose table has none: fixed, so an archive has the same bytes whenever it is written.
DATE = datetime(2024, 1, 1, tzinfo=UTC)

SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("warc_file", T.StringType(), False),
    T.StructField("offset", T.LongType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("record_bytes", T.LongType(), False),
    T.StructField("payload_digest", T.StringType(), False),
])


def record(url: str | None, payload: bytes, page_id: int | None, date: datetime = DATE) -> tuple[bytes, str]:
    """Return a WARC/1.1 resource record and the digest of its payload."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    name = hashlib.sha256(f"{page_id}|{url}|{digest}".encode()).hexdigest()
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = (
        f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:32]}>\r\n"
        + f"WARC-Date: {date:%Y-%m-%dT%H:%M:%SZ}\r\n"
        + (f"WARC-Target-URI: {target}\r\n" if url is not None else "")
        + f"WARC-Payload-Digest: {digest}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    )
    return head.encode() + payload + b"\r\n\r\n", digest


def _samples(records: list[bytes]) -> list[bytes]:
    """Return what a dictionary is trained on: all records, in pieces where they are few; evenly thinned beyond TRAIN_BYTES, which training takes many times in memory."""
    total = sum(map(len, records))
    step = total // SAMPLES + 1 if len(records) < SAMPLES else total
    if total > TRAIN_BYTES:
        step = min(step, 1 << 20)
    pieces = [r[i : i + step] for r in records for i in range(0, len(r), step)]
    return pieces[:: math.ceil(total / TRAIN_BYTES)]


def build_dictionary(records: list[bytes], size: int = DICT_BYTES) -> bytes:
    """Build a dictionary from all given records, of ``size`` bytes or an eighth of theirs; none where they hold under 2 KB or nothing that repeats."""
    size = min(size, sum(map(len, records)) // 8)
    if size < 256:  # the least that Zstandard takes
        return b""
    try:
        return zstandard.train_dictionary(size, _samples(records), k=min(1024, size), d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # nothing that repeats
        return b""


def archive(records: list[bytes], level: int = LEVEL) -> tuple[bytes, list[tuple[int, int]]]:
    """Return an archive's bytes and each record's offset and length.

    It begins with a skippable frame that holds the dictionary, compressed; each
    record is a frame of its own, so it can be read alone.
    """
    dictionary = build_dictionary(records)
    out = bytearray()
    if dictionary:
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
        out += struct.pack("<II", SKIPPABLE, len(packed)) + packed
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    compressor = zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=True)
    places = []
    for r in records:
        frame = compressor.compress(r)
        places.append((len(out), len(frame)))
        out += frame
    return bytes(out), places


def dictionary_of(head: bytes) -> zstandard.ZstdCompressionDict | None:
    """Return the dictionary at an archive's head."""
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE:
        return None
    (size,) = struct.unpack("<I", head[4:8])
    return zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(head[8 : 8 + size]))


def payload_of(blob: bytes) -> tuple[str | None, bytes]:
    """Return a record's target and payload."""
    head, _, rest = blob.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields.get("WARC-Target-URI"), rest[: int(fields["Content-Length"])]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_warc(pages: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES, key: str = "page_id", url: str = "url", html: str = "html", date: datetime = DATE) -> DataFrame:
    """Write pages to ``.warc.zst`` archives in a shared folder; return an index row for each page.

    Each task writes the rows of its partition, nothing is shuffled. Records
    gather until an archive holds ``file_bytes``; then a dictionary is built from
    all its records, so archives are self-contained and no statistic of the
    corpus passes the driver. An archive is written under a name of its own
    and renamed when whole, so a task that runs again after an executor is lost
    writes the same bytes under the same name.

    The index has ``(page_id, url, warc_file, offset, length, record_bytes,
    payload_digest)``. A null page is archived with an empty payload, a null url
    without a target; repeated rows are archived as often as they come, in the
    order in which they come; a page of any length is one record, and ends its
    archive if it's longer than that. Empty partitions and tables write no
    archive; keys must be integers; other columns don't matter. ``date`` is the
    WARC-Date of all records, which the table doesn't have.
    """
    folder = folder or shared_dir(pages.sparkSession, "warc")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        part = TaskContext.get().partitionId()
        keys: list = []
        blobs: list[bytes] = []
        held = serial = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, blobs, held, serial
            name = f"part-{part:06d}-{serial:04d}.warc.zst"
            data, places = archive(blobs)
            system.create_dir(root, recursive=True)
            trial = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
            with system.open_output_stream(trial) as out:
                out.write(data)
            if system.get_file_info(f"{root}/{name}").is_file:  # of a task that ran before; not all systems rename over it
                system.delete_file(f"{root}/{name}")
            system.move(trial, f"{root}/{name}")
            columns = [
                [k for k, _, _ in keys], [u for _, u, _ in keys], [name] * len(keys), [o for o, _ in places],
                [n for _, n in places], [len(b) for b in blobs], [d for _, _, d in keys],
            ]
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            keys, blobs, held, serial = [], [], 0, serial + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=SCHEMA.names)

        for batch in batches:
            for page, link, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blob, digest = record(link, (body or "").encode(), page, date)
                keys.append((page, link, digest))
                blobs.append(blob)
                held += len(blob)
                if held >= file_bytes:
                    yield flush()
        if blobs:
            yield flush()

    return rows.mapInArrow(run, SCHEMA)


def read_warc(index: DataFrame, folder: str) -> DataFrame:
    """Return ``(page_id, url, html)`` of the pages that an index names, each record read by its offset."""
    schema = "page_id long, url string, html string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        for batch in batches:
            got: list = []
            by: dict[str, list] = {}
            for page, name, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by.setdefault(name, []).append((offset, length, page))
            for name, wanted in by.items():
                with system.open_input_file(f"{root}/{name}") as f:
                    head = f.read(8)
                    if struct.unpack("<I", head[:4])[0] == SKIPPABLE:
                        head += f.read(struct.unpack("<I", head[4:])[0])
                    reader = zstandard.ZstdDecompressor(dict_data=dictionary_of(head))
                    for offset, length, page in sorted(wanted, key=lambda x: x[0]):
                        f.seek(offset)
                        link, body = payload_of(reader.decompress(f.read(length)))
                        got.append((page, link, body.decode()))
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["page_id", "url", "html"])

    return index.select("page_id", "warc_file", "offset", "length").mapInArrow(run, schema)
