"""Operator 7: media columns in archives, read and written by a custom Spark data source.

A payload is stored as an 8-bit grayscale PNG, 64 samples wide; its samples are the payload's bytes. Media go as
members into ZIP archives of about `ARCHIVE_BYTES` in one folder. The source `media_archive`:

* plans partitions from the folder listing alone: byte ranges of each archive, whatever its number of members;
* reads, in a partition, the archive's central directory and those members whose headers begin in the range, each by
  its offset, and streams them as Arrow batches of about `BATCH_BYTES`;
* checks each member's checksum and retries a failed member by itself, reopening the file at its offset;
* writes archives under temporary names and renames them in the commit, so failed or doubled tasks leave nothing.

Nulls: a null text is empty (64 zero bytes); null doc_ids are kept. Repeated rows are members of their own. Equal
texts give equal media and features. An empty table gives an empty archive folder and an empty result.
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

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import map_slices, offsets, shared_dir

UNIT = 64
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 32 << 20, 8 << 20, 4 << 20
TRIES = 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEMA = "archive string, offset long, member string, media binary"
FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of UNIT."""
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    """The payload as a grayscale image of 8-bit samples; the unpadded length goes into a text chunk."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)  # filter 0: samples as they are
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"bytes\0%d" % n_bytes) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """(payload, unpadded length) of an image that to_png made."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, width, packed, n = 8, 0, b"", 0
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", data)[0]
        elif kind == b"tEXt":
            n = int(data.partition(b"\0")[2])
        elif kind == b"IDAT":
            packed += data
        at += 12 + size
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes(), n


class Range(InputPartition):
    def __init__(self, path: str, lo: int, hi: int):
        self.path, self.lo, self.hi = path, lo, hi


def located(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri)


class MediaArchive(DataSource):
    """format("media_archive"): load(folder) and save(folder) of archives of media members."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)

    def writer(self, schema, overwrite: bool) -> MediaWriter:
        return MediaWriter(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        system, root = located(self.uri)
        files = [f for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".zip")]
        return [Range(f.path, lo, lo + self.range_bytes) for f in sorted(files, key=lambda f: f.path) for lo in range(0, f.size, self.range_bytes)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = located(self.uri)
        with system.open_input_file(partition.path) as f, zipfile.ZipFile(f) as z:
            members = sorted((m.header_offset, m.filename, m.compress_size, m.CRC) for m in z.infolist() if partition.lo <= m.header_offset < partition.hi)
        held, size = [], 0
        source = Members(system, partition.path)
        for at, name, length, crc in members:
            media = source.read(at, length, crc)
            held.append((partition.path, at, name, media))
            size += length
            if size >= BATCH_BYTES:
                yield as_batch(held)
                held, size = [], 0
        if held:
            yield as_batch(held)
        source.close()


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    path, at, name, media = zip(*rows)
    return pa.RecordBatch.from_pydict({"archive": pa.array(path, pa.string()), "offset": pa.array(at, pa.int64()), "member": pa.array(name, pa.string()), "media": pa.array(media, pa.binary())})


class Members:
    """Members of one archive by offset; a member that fails is read again alone, from a newly opened file."""

    def __init__(self, system: fs.FileSystem, path: str, tries: int = TRIES, wait: float = 0.2):
        self.system, self.path, self.tries, self.wait, self.file = system, path, tries, wait, None

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None

    def once(self, at: int, length: int, crc: int) -> bytes:
        if self.file is None:
            self.file = self.system.open_input_file(self.path)
        self.file.seek(at)
        head = self.file.read(30)
        if head[:4] != b"PK\x03\x04":
            raise OSError(f"no member at {at} of {self.path}")
        name, extra = struct.unpack_from("<HH", head, 26)
        self.file.seek(at + 30 + name + extra)
        data = self.file.read(length)
        if len(data) != length or zlib.crc32(data) != crc:
            raise OSError(f"damaged member at {at} of {self.path}")
        return data

    def read(self, at: int, length: int, crc: int) -> bytes:
        for attempt in range(1, self.tries + 1):
            try:
                return self.once(at, length, crc)
            except OSError:
                self.close()
                if attempt == self.tries:
                    raise
                time.sleep(self.wait * attempt)
        raise AssertionError


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class MediaWriter(DataSourceArrowWriter):
    """Writes columns (member, media); one task's archives come under names of its own."""

    def __init__(self, options: dict):
        self.uri = options["path"]
        self.archive_bytes = int(options.get("archiveBytes", ARCHIVE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = located(self.uri)
        system.create_dir(root, recursive=True)
        files: list[str] = []
        buffer, archive = None, None

        def finish() -> None:
            archive.close()
            path = f"{root}/{uuid.uuid4().hex}.zip"
            with system.open_output_stream(f"{path}.part") as out:
                out.write(buffer.getvalue())
            files.append(path)

        for batch in iterator:
            for name, media in zip(batch.column("member").to_pylist(), batch.column("media")):
                if archive is None:
                    buffer = io.BytesIO()
                    archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)
                archive.writestr(zipfile.ZipInfo(name), media.as_py())
                if buffer.tell() >= self.archive_bytes:
                    finish()
                    archive = None
        if archive is not None:
            finish()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = located(self.uri)
        system.create_dir(root, recursive=True)
        for message in messages:
            for path in message.files if message else ():
                system.move(f"{path}.part", path)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = located(self.uri)
        for message in messages:
            for path in message.files if message else ():
                system.delete_file(f"{path}.part")


def feature_of(samples: np.ndarray, n: int) -> str:
    """Mean, deviation, entropy and the shares of 8 bands of sample values, over the unpadded samples."""
    counts = np.bincount(samples[:n], minlength=256)
    total = max(1, n)
    mean = float((counts * np.arange(256)).sum()) / total
    spread = float(np.sqrt(max(0.0, (counts * (np.arange(256) - mean) ** 2).sum() / total)))
    p = counts[counts > 0] / total
    entropy = float((p * -np.log2(p)).sum()) if n else 0.0
    return json.dumps({"mean": round(mean, 4), "spread": round(spread, 4), "entropy": round(entropy, 4), "bands": [round(float(x) / total, 4) for x in counts.reshape(8, 32).sum(1)]}, separators=(",", ":"))


def write_media(docs: DataFrame, folder: str) -> None:
    """Store every whole text of docs as a member of the archives under folder."""

    def make():
        seen = [0]

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            body, at = offsets(part.column("text"))
            raw = body.tobytes()
            texts = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            names = [f"{'null' if i is None else i}-{seen[0] + k}" for k, i in enumerate(part.column("doc_id").to_pylist())]
            seen[0] += len(names)
            return pa.RecordBatch.from_pydict({"member": pa.array(names, pa.string()), "media": pa.array([to_png(padded(t), len(t)) for t in texts], pa.binary())})

        return step

    docs.sparkSession.dataSource.register(MediaArchive)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    map_slices(rows, make, "member string, media binary").write.format("media_archive").mode("append").save(folder)


def media_features(spark, folder: str) -> DataFrame:
    """Digests and features of the media under folder, from the stored bytes."""
    spark.dataSource.register(MediaArchive)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, media in zip(batch.column("member").to_pylist(), batch.column("media")):
                media = media.as_py()
                payload, n = from_png(media)
                doc_id = name.rpartition("-")[0]
                rows.append((None if doc_id == "null" else int(doc_id), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(np.frombuffer(payload, np.uint8), n)))
            names = [c.strip().split(" ") for c in FEATURE_SCHEMA.split(",")]
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_pydict({c: pa.array(list(v), pa.int64() if kind == "long" else pa.string()) for (c, kind), v in zip(names, columns)})

    return spark.read.format("media_archive").load(folder).select("member", "media").mapInArrow(run, FEATURE_SCHEMA)


def stored_and_read(docs: DataFrame) -> DataFrame:
    folder = shared_dir(docs.sparkSession, "media")
    write_media(docs, folder)
    return media_features(docs.sparkSession, folder)
