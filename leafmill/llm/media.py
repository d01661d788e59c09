"""Media columns: payloads in archives, and a Spark data source that reads them by byte ranges.

Payloads are stored as 8-bit grey PNG images in ZIP archives (members stored as they are). The data source lists archives with their sizes and
plans one partition for each range of RANGE bytes; a task reads the archive's directory, takes the members that begin in its range, and streams their bytes
through Arrow. Each member is read on its own by its offset and tried again on its own; one that stays unreadable gives a row with ``error``.

Null texts are empty; an empty payload is one row of padding. Equal texts give equal media bytes: names and places of members are not part of them. Rows that
share a doc_id, or repeat whole, are members of their own. A very long text is one member, held by one task; archives and byte ranges are not split within a member. An empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import core
from . import files

WIDTH = 576
ARCHIVE_BYTES = 32 << 20
RANGE = 8 << 20
BATCH_BYTES = 4 << 20
TRIES = 3
_PNG = b"\x89PNG\r\n\x1a\n"


def payload_of(text: bytes) -> bytes:
    """The text, filled up with bytes 255 to a positive multiple of WIDTH. UTF-8 has no byte 255, so the text can be told apart again."""
    return text + b"\xff" * (WIDTH - len(text) if not text else -len(text) % WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes, level: int = 1) -> bytes:
    """Payload bytes as the samples of a grey PNG image of WIDTH columns, without row filters."""
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    return _PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> bytes:
    """The samples of an image that encode() made; checksums are verified."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, data, width, height = 8, [], 0, 0
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("row filters are not used here")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, standard deviation and entropy of the samples, and which of 64 equal runs are brighter than the mean."""
    x = np.frombuffer(payload, np.uint8)
    count = np.bincount(x, minlength=256)
    share = count[count > 0] / len(x)
    mean = float((count * np.arange(256)).sum() / len(x))
    square = float((count * np.arange(256) ** 2).sum() / len(x))
    runs = x.reshape(64, -1).sum(1, dtype=np.int64) * 64 > mean * len(x)
    return f"{mean:.3f};{max(square - mean * mean, 0) ** 0.5:.3f};{abs(float(-(share * np.log2(share)).sum())):.3f};{np.packbits(runs).tobytes().hex()}"


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes each text (doc_id, text) as a member of archives in ``folder``. Returns the stored list (path, members, bytes) of finished archives."""
    core.bounded_batches(docs.sparkSession)
    files.make_folder(folder)
    kinds = pa.schema([("path", pa.string()), ("members", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        raw, archive, n = io.BytesIO(), None, 0

        def finish():
            nonlocal raw, archive, n, number
            archive.close()
            path = f"{folder}/{files.fresh_name(f'{part:06d}-{number:06d}')}.zip"
            size = files.write(path, [raw.getbuffer()])
            row = pa.RecordBatch.from_pydict({"path": [path], "members": [n], "bytes": [size]}, kinds)
            raw, archive, n, number = io.BytesIO(), None, 0, number + 1
            return row

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                if archive is None:
                    archive = zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED)
                archive.writestr(zipfile.ZipInfo(f"{n:07d}-{'' if doc_id is None else doc_id}.png"), encode(payload_of(text or b"")))
                n += 1
                if raw.tell() >= archive_bytes:
                    yield finish()
        if archive is not None:
            yield finish()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return core.stored(rows.mapInArrow(run, "path string, members long, bytes long"), "archives")


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


MEMBERS = pa.schema([("doc_id", pa.int64()), ("archive", pa.string()), ("member_offset", pa.int64()), ("media", pa.binary()), ("error", pa.string())])


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int, tries: int):
        self.folder, self.range_bytes, self.tries = folder, range_bytes, tries

    def partitions(self):
        """Archives are listed with their sizes; nothing is opened on the driver."""
        system, path = files.at(self.folder)
        out = []
        for info in system.get_file_info(fs.FileSelector(path, recursive=True)):
            if info.is_file and info.path.endswith(".zip"):
                uri = f"{self.folder}/{info.path[len(path) :].lstrip('/')}"
                out += [ByteRange(uri, a, a + self.range_bytes) for a in range(0, info.size, self.range_bytes)]
        return out or [ByteRange("", 0, 0)]

    def _member(self, handle, info: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        error = None
        for k in range(self.tries):
            try:
                handle.seek(info.header_offset)
                head = handle.read(30)
                if head[:4] != b"PK\x03\x04":
                    raise ValueError("no member here")
                skip = sum(struct.unpack("<HH", head[26:30]))
                handle.seek(info.header_offset + 30 + skip)
                data = handle.read(info.compress_size)
                if len(data) != info.compress_size or zlib.crc32(data) != info.CRC:
                    raise ValueError("damaged member")
                return data, None
            except (OSError, ValueError) as e:
                error = f"{type(e).__name__}: {e}"
                time.sleep(0.05 * k)
        return None, error

    def read(self, partition: ByteRange):
        if not partition.path:
            return
        system, path = files.at(partition.path)
        with system.open_input_file(path) as handle:
            rows, size = [], 0
            for info in zipfile.ZipFile(handle).infolist():
                if partition.start <= info.header_offset < partition.end:
                    data, error = self._member(handle, info)
                    name = info.filename.partition("-")[2].removesuffix(".png")
                    rows.append((int(name) if name else None, partition.path, info.header_offset, data, error))
                    size += len(data or b"")
                    if size >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
            if rows:
                yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), MEMBERS, strict=True)], schema=MEMBERS)


class ArchiveSource(DataSource):
    """format("media_archives"): doc_id, archive, member_offset, media, error of every member below a folder."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "doc_id long, archive string, member_offset long, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("rangeBytes", RANGE)), int(self.options.get("tries", TRIES)))


def read_archives(spark, folder: str, range_bytes: int = RANGE) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archives").option("rangeBytes", str(range_bytes)).load(folder)


def features(members: DataFrame) -> DataFrame:
    """Per member: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. Unreadable members fail the job."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, media, error in zip(batch["doc_id"].to_pylist(), batch["media"], batch["error"].to_pylist(), strict=True):
                if error:
                    raise OSError(error)
                media = media.as_py()
                data = decode(media)
                out.append((doc_id, len(data.rstrip(b"\xff")), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(data)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    return members.select("doc_id", "media", "error").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
