"""Media columns: payloads stored as lossless 8-bit images in archives, and a Spark data source that reads them back.

Writing packs each payload as an 8-bit greyscale PNG of fixed width into ZIP archives (members stored, archives of about
``ARCHIVE_BYTES``), one open archive per task.  A commit message carries what a task wrote.  When all tasks are done, one
manifest that names their archives and sizes is put in place by a single rename, and readers read only what manifests
name: a lost executor's or a second attempt's files are never read, and a driver lost midway leaves nothing visible.
Archives of the job that no committed task names are then removed.

Reading plans partitions as byte ranges of the archives in a folder's manifests: the driver reads names and sizes only,
whatever the number of members.  A range reads its archive's directory, takes the members whose header starts in the range, checks
each one's checksum, and streams payloads through Arrow in bounded batches.  A member that fails to read is tried again
by its own offset on a newly opened file; the others are not read again.  After the last attempt the task fails, or, with
option ``permissive``, the member becomes a row with an error.

Files are reached through Hadoop-style URIs with pyarrow's file systems, so folder and executors need not share a disk.

Defined results: a null or empty text is a payload of ``unit`` spaces; equal texts give equal media; equal rows stay;
a null doc_id is carried through; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tensorloom.llm._shared import new_path

WIDTH = 192
ARCHIVE_BYTES = 48 << 20
ARCHIVE_MEMBERS = 60_000
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def encode_png(payload: bytes) -> bytes:
    """An 8-bit greyscale PNG of ``WIDTH`` columns, one sample per byte; the payload is a multiple of the width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = rows
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of a PNG made by ``encode_png``."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, size = 8, [], None
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a damaged PNG chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale PNG")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered PNG")
    return lines[:, 1:].tobytes()


class _Sink(io.RawIOBase):
    """A write-only stream with a position, as zipfile wants it."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def tell(self) -> int:
        return self.at

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        self.at += len(data)
        return len(data)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


@dataclass
class Range(InputPartition):
    file: str
    start: int
    stop: int


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class MediaArchives(DataSource):
    """Format ``media_archives``: rows (doc_id, n_bytes, payload) in, (doc_id, n_bytes, payload, media_bytes, media_sha256, offset, attempts, error) out."""

    SCHEMA = "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, offset long, attempts int, error string"

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return self.SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(self.options)


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.folder = options["path"]
        self.job = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = _file_system(self.folder)
        system.create_dir(root, recursive=True)
        files: list[tuple[str, int]] = []
        stream = archive = sink = name = None
        count = 0
        for batch in batches:
            for doc_id, n_bytes, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if archive is None:
                    name = f"{self.job}-{uuid.uuid4().hex}.zip"
                    stream = system.open_output_stream(f"{root}/{name}")
                    sink = _Sink(stream)
                    archive, count = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED), 0
                archive.writestr(zipfile.ZipInfo(f"{count}/{'' if doc_id is None else doc_id}/{n_bytes}.png"), encode_png(payload))
                count += 1
                if sink.at > ARCHIVE_BYTES or count >= ARCHIVE_MEMBERS:
                    archive.close(), stream.close()
                    files.append((name, sink.at))
                    archive = None
        if archive is not None:
            archive.close(), stream.close()
            files.append((name, sink.at))
        return Written(files)

    def commit(self, messages) -> None:
        system, root = _file_system(self.folder)
        system.create_dir(root, recursive=True)
        files = [f for m in messages if m for f in m.files]
        with system.open_output_stream(f"{root}/{self.job}.pending") as out:
            out.write(json.dumps(files).encode())
        system.move(f"{root}/{self.job}.pending", f"{root}/{self.job}.manifest")
        self._remove({name for name, _ in files})

    def abort(self, messages) -> None:
        self._remove(set())

    def _remove(self, keep: set[str]) -> None:
        """This job's archives besides ``keep``: those of lost or repeated tasks."""
        system, root = _file_system(self.folder)
        for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(f"{self.job}-") and f.base_name not in keep:
                system.delete_file(f.path)


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        self.attempts = int(options.get("attempts", 3))
        self.permissive = str(options.get("permissive", "false")).lower() == "true"

    def partitions(self) -> list[Range]:
        """Byte ranges of the archives that manifests name."""
        system, root = _file_system(self.folder)
        found = []
        for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.base_name.endswith(".manifest"):
                with system.open_input_file(f.path) as manifest:
                    found += [(f"{root}/{name}", size) for name, size in json.loads(manifest.read())]
        return [Range(path, at, min(at + self.range_bytes, size)) for path, size in sorted(found) for at in range(0, size, self.range_bytes)]

    def _member(self, system: fs.FileSystem, path: str, info: zipfile.ZipInfo, file) -> bytes:
        """The stored bytes of a member, by its offset."""
        own = file or system.open_input_file(path)
        try:
            own.seek(info.header_offset)
            head = own.read(30)
            if head[:4] != b"PK\x03\x04":
                raise OSError(f"no member at {info.header_offset}")
            names = sum(struct.unpack("<HH", head[26:30]))
            own.read(names)
            data = own.read(info.compress_size)
            if len(data) != info.compress_size or zlib.crc32(data) != info.CRC:
                raise OSError(f"the member at {info.header_offset} is damaged")
            return data
        finally:
            if file is None:
                own.close()

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without archives
            return
        system, _ = _file_system(self.folder)
        rows: list[tuple] = []
        size = 0
        with system.open_input_file(partition.file) as file:
            with zipfile.ZipFile(file) as archive:
                members = [m for m in archive.infolist() if partition.start <= m.header_offset < partition.stop]
                for info in members:
                    _, doc_id, name = info.filename.split("/")
                    media, payload, error, tries = b"", None, None, 0
                    while payload is None and tries < self.attempts:
                        tries += 1
                        try:
                            media = self._member(system, partition.file, info, file if tries == 1 else None)
                            payload = decode_png(media)
                            error = None
                        except (OSError, ValueError, zlib.error) as problem:
                            error = f"{partition.file} at {info.header_offset}: {problem}"
                            time.sleep(0.05 * (tries < self.attempts))
                    if error and not self.permissive:
                        raise OSError(error)
                    rows.append((int(doc_id) if doc_id else None, int(name.removesuffix(".png")), payload, len(media), hashlib.sha256(media).hexdigest(), info.header_offset, tries, error))
                    size += len(payload or b"")
                    if size >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string())
        names = [c.split()[0] for c in MediaArchives.SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def store_texts(docs: DataFrame, folder: str | None = None, unit: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> str:
    """Write every text as padded UTF-8 payload into archives in ``folder`` (default: a new one in the shared folder); gives the folder."""
    spark = docs.sparkSession
    spark.dataSource.register(MediaArchives)
    folder = folder or new_path(spark, "media")
    body = F.coalesce(F.col(text), F.lit(""))
    n = F.octet_length(body).cast("long")
    pad = (F.greatest(F.lit(unit), F.ceil(n / unit) * unit) - n).cast("int")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), n.alias("n_bytes"), F.concat(F.encode(body, "UTF-8"), F.repeat(F.lit(" "), pad).cast("binary")).alias("payload"))
    rows.write.format("media_archives").mode("append").save(folder)
    return folder


def read_media(spark, folder: str, **options: str) -> DataFrame:
    """The members of the archives in a folder."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(**options).load(folder)


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and a 16-level histogram (in thousandths) of 8-bit samples."""
    bins = np.bincount(samples >> 4, minlength=16) * 1000 // max(len(samples), 1)
    return f"m{samples.mean():.3f} d{samples.std():.3f} h{'-'.join(map(str, bins))}" if len(samples) else ""


def media_features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature of read members."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [p or b"" for p in batch.column(2).to_pylist()]
            columns = [pa.array([len(p) for p in payloads], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()), pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()), batch.column(3), batch.column(4), pa.array([feature(np.frombuffer(p, np.uint8)) for p in payloads], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "payload", "media_bytes", "media_sha256").mapInArrow(compute, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
