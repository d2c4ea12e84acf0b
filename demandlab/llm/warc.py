"""WARC records in seekable Zstandard archives.

Records are grouped into frames that are compressed independently; an archive is
a file of frames followed by a seek table in a skippable frame (public "seekable
format": per frame the compressed and the plain size, then a footer with the
number of frames).  An index table maps every record identifier to its archive,
frame and offset in the plain frame, so that one record is read by seeking to
the footer and decompressing one frame.

Tasks write archives to the shared folder under a temporary name and rename
them to the digest of their content; the index is a table that Spark commits.
An archive of a lost executor that no index row names is not part of the set.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterable
from datetime import UTC, datetime
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stage_table

# fixed values of the seekable format
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

FRAME_BYTES = 256 << 10     # plain bytes after which a frame is closed
ARCHIVE_BYTES = 16 << 20    # plain bytes after which an archive is closed


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"urn:page:{page_id}"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record with its payload, or a revisit record without one."""
    length = len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <{record_id(refers_to)}>", f"X-Payload-Length: {length}"]
        payload = b""
    else:
        head.append("Content-Type: text/html; charset=utf-8")
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length doesn't match its header")
    return fields, rest[:size]


class ArchiveWriter:
    def __init__(self, level: int = 3):
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[bytes] = []
        self.sizes: list[int] = []
        self.open: list[bytes] = []
        self.filled = self.total = 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Append a record; (frame, offset in the plain frame, length)."""
        at = (len(self.frames), self.filled, len(record))
        self.open.append(record)
        self.filled += len(record)
        self.total += len(record)
        if self.filled >= FRAME_BYTES:
            self._close()
        return at

    def _close(self) -> None:
        if self.open:
            self.frames.append(self.zip.compress(b"".join(self.open)))
            self.sizes.append(self.filled)
            self.open, self.filled = [], 0

    def finish(self) -> bytes:
        self._close()
        table = b"".join(struct.pack("<II", len(f), n) for f, n in zip(self.frames, self.sizes))
        table += struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


class ArchiveReader:
    """Random access to an archive (bytes or an open file) by its footer."""

    def __init__(self, data):
        self.file = io.BytesIO(data) if isinstance(data, bytes) else data
        end = self.file.seek(0, 2) or self.file.tell()
        n, _, magic = struct.unpack("<IBI", self._read(end - 9, 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        sizes = np.frombuffer(self._read(end - 9 - 8 * n, 8 * n), "<u4").reshape(n, 2).astype(np.int64)
        self.ends, self.plain = np.cumsum(sizes[:, 0]), sizes[:, 1]
        self.unzip, self.last = zstandard.ZstdDecompressor(), (-1, b"")

    def _read(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def record(self, frame: int, offset: int, length: int) -> bytes:
        if self.last[0] != frame:
            start = int(self.ends[frame - 1]) if frame else 0
            plain = self.unzip.decompress(self._read(start, int(self.ends[frame]) - start), max_output_size=int(self.plain[frame]))
            self.last = (frame, plain)
        return self.last[1][offset:offset + length]


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder and the folder's path in it."""
    scheme = urlparse(folder).scheme
    return (fs.LocalFileSystem(), urlparse(folder).path) if scheme in ("", "file") else fs.FileSystem.from_uri(folder)


INDEX = "record_id string, page_id long, archive string, frame int, start long, length long"
INDEX_TYPE = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("frame", pa.int32()),
                        ("start", pa.int64()), ("length", pa.int64())])


def _write(folder: str, min_revisit: int, date: str):
    def run(batches):
        store, path = _filesystem(folder)
        store.create_dir(path, recursive=True)
        writer, rows = ArchiveWriter(), []

        def done():
            data = writer.finish()
            name = hashlib.sha1(data).hexdigest() + ".warc.zst"
            part = f"{path}/.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out:
                out.write(data)
            if store.get_file_info(f"{path}/{name}").type == fs.FileType.File:  # an earlier attempt of this task wrote the same
                store.delete_file(part)
            else:
                store.move(part, f"{path}/{name}")
            return pa.RecordBatch.from_pylist([r | {"archive": name} for r in rows], INDEX_TYPE)

        for b in batches:
            for page, url, html, first in zip(*(b.column(c) for c in ("page_id", "url", "html", "first_id"))):
                payload, page, first = (html.as_py() or "").encode(), page.as_py(), first.as_py()
                seen = first if len(payload) >= min_revisit else None
                record = warc_record(page, url.as_py(), payload, payload_digest(payload), seen, date)
                frame, start, length = writer.add(record)
                rows.append({"record_id": record_id(page), "page_id": page, "frame": frame, "start": start, "length": length})
                if writer.total >= ARCHIVE_BYTES:
                    yield done()
                    writer, rows = ArchiveWriter(), []
        if rows:
            yield done()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit: int = 0, date: str | None = None) -> tuple[DataFrame, str]:
    """``pages`` (page_id, url, html, ...) -> the index of the records (record_id,
    page_id, archive, frame, start, length) and the folder of the archives, one
    of its own in the shared folder if none is given.

    A null html is an empty payload.  Of the rows whose payloads are equal and
    have ``min_revisit`` bytes or more, those with the smallest page_id are
    responses, the others are revisits of it.  Rows with a null page_id are
    responses, and no row revisits them.  A url keeps no line breaks.  Repeated
    rows make repeated records of one identifier; other columns are ignored.
    ``date`` is the records' WARC-Date, the time of the call if not given.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/llm-archives-{uuid.uuid4().hex}"
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = pages.withColumn("sha1", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    facts = stage_table(rows.select("page_id", "sha1").where("page_id IS NOT NULL"), "payloads")
    first = stage_table(facts.groupBy("sha1").agg(F.min("page_id").alias("first_id")), "first")
    again = facts.join(first, "sha1").where("page_id > first_id").distinct()
    joined = rows.join(again, ["page_id", "sha1"], "left").select("page_id", "url", "html", "first_id")
    return stage_table(joined.mapInArrow(_write(folder, min_revisit, date), INDEX), "index"), folder


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Seek to every record of ``index``, parse it and check its payload:
    page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload
    (null without ``with_payload``, and empty for revisits).  Rows of one frame
    that follow each other, as the index is written, decompress it once."""
    def run(batches):
        store, path = _filesystem(folder)
        name, file, reader = None, None, None
        try:
            for b in batches:
                out = []
                for r in b.to_pylist():
                    if r["archive"] != name:
                        if file is not None:
                            file.close()
                        name, file = r["archive"], store.open_input_file(f"{path}/{r['archive']}")
                        reader = ArchiveReader(file)
                    f, payload = parse_record(reader.record(r["frame"], r["start"], r["length"]))
                    if f["warc-record-id"] != f"<{r['record_id']}>":
                        raise ValueError(f"the index names another record than {r['record_id']}")
                    digest = f["warc-payload-digest"].removeprefix("sha1:")
                    target = f.get("warc-refers-to")
                    if target is None and payload_digest(payload) != digest:
                        raise ValueError(f"payload of page {r['page_id']} is damaged")
                    out.append({"page_id": r["page_id"], "payload_digest": digest, "record_type": f["warc-type"],
                                "payload_bytes": int(f.get("x-payload-length", len(payload))),
                                "refers_to": None if target is None else int(target[len("<urn:page:"):-1]),
                                "url": f.get("warc-target-uri"), "payload": payload if with_payload else None})
                if out:
                    yield pa.RecordBatch.from_pylist(out, pa.schema([
                        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]))
        finally:
            if file is not None:
                file.close()

    return index.mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
             "url string, payload binary")


def sorted_index(index: DataFrame) -> DataFrame:
    """The index as a table in ranges of page_id, so that a look-up reads the row
    groups that can hold its identifiers."""
    return stage_table(index.repartitionByRange("page_id").sortWithinPartitions("page_id"), "index-by-page")


def look_up(index: DataFrame, folder: str, page_ids: Iterable[int]) -> DataFrame:
    """The records of ``page_ids``: the filter reaches the index's scan, and of the
    archives only their footers and the frames named are read."""
    return read_records(index.where(F.col("page_id").isin(list(page_ids))), folder)
