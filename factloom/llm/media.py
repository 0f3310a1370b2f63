"""Media columns: members of archives read as rows by a custom Spark data source.

``write_archives`` turns documents into lossless 8-bit grey PNG members of ZIP archives in a shared
folder; ``ArchiveSource`` plans byte ranges over these archives and streams the members through
Arrow; ``features`` decodes what was read back.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from factloom.llm.common import new_folder

WIDTH = 64
#: The eight bytes every PNG begins with (fixed value).
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(text: str) -> bytes:
    """UTF-8 of ``text``, zero-padded to a positive multiple of 64, as grey PNG rows of 64 samples."""
    raw = text.encode()
    rows = max(1, -(-len(raw) // WIDTH))
    samples = np.zeros((rows, WIDTH + 1), np.uint8)  # each row begins with filter 0
    samples[:, 1:].flat[: len(raw)] = np.frombuffer(raw, np.uint8)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return PNG_MAGIC + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % len(raw)) + _chunk(b"IDAT", zlib.compress(samples.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> tuple[bytes, int]:
    """The payload of a member and how many of its bytes are not padding; every chunk's CRC is checked."""
    at, size, n, data = len(PNG_MAGIC), None, None, []
    if media[:at] != PNG_MAGIC:
        raise ValueError("not a PNG member")
    while at < len(media):
        length = struct.unpack_from(">I", media, at)[0]
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + length]
        if struct.unpack_from(">I", media, at + 8 + length)[0] != zlib.crc32(kind + body):
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"tEXt":
            n = int(body.partition(b"\0")[2])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + length
    samples = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    return samples[:, 1:].tobytes(), n


def describe(payload: bytes) -> str:
    """Mean, deviation, sign changes about the mean, peak and entropy in bits of the samples."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    over = x > x.mean()
    return f"mean={x.mean():.4f};std={x.std():.4f};crossings={int((over[1:] != over[:-1]).sum())};peak={int(x.max())};entropy={float(-(p * np.log2(p)).sum()):.4f}"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_archives(docs: DataFrame, root: str, archive_mb: int = 64) -> DataFrame:
    """One row per archive written (path, members, bytes).

    ``docs`` has doc_id and text (null: empty). Every task attempt writes archives of its own name,
    each closed at ``archive_mb``; only those of attempts that succeeded are returned, so a retried
    or speculative task leaves no doubles. An archive is a plain ZIP file of stored PNG members.
    """
    limit = archive_mb << 20

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        stem, done = f"part-{task.partitionId():06d}-{task.taskAttemptId()}", []
        out = archive = name = None
        n = total = 0

        def close():
            nonlocal out, archive
            if archive is not None:
                archive.close()
                out.close()
                done.append((name, n, total))
                out = archive = None

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if archive is None:
                    name = f"{root}/{stem}-{len(done):04d}.zip"
                    where, path = _open(name)
                    out = where.open_output_stream(path)
                    archive, n, total = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED), 0, 0
                media = encode(text.as_py() or "")
                archive.writestr(zipfile.ZipInfo(f"{n:08d}.{'' if doc_id is None else doc_id}.png"), media)
                n, total = n + 1, total + len(media)
                if total >= limit:
                    close()
        close()
        yield pa.RecordBatch.from_pylist([{"path": p, "members": m, "bytes": b} for p, m, b in done], pa.schema([("path", pa.string()), ("members", pa.int64()), ("bytes", pa.int64())]))

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(write, "path string, members long, bytes long")


class Range(InputPartition):
    """Members of one archive whose local header begins in [start, end)."""

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class Source:
    """An archive's file, opened when it is first read and again after ``drop``."""

    def __init__(self, where, path: str):
        self.where, self.path, self.file = where, path, None

    def handle(self):
        if self.file is None:
            self.file = self.where.open_input_file(self.path)
        return self.file

    def drop(self) -> None:
        file, self.file = self.file, None
        if file is not None:
            file.close()


class ArchiveReader(DataSourceReader):
    """Plans by file size alone; each task reads its archive's directory and then its own members."""

    def __init__(self, options: dict):
        self.paths = json.loads(options["archives"])
        self.step = int(options.get("rangeBytes", 16 << 20))
        self.batch = int(options.get("batchBytes", 4 << 20))
        self.tries = int(options.get("tries", 4))

    def partitions(self) -> list[Range]:
        return [Range(p, lo, min(lo + self.step, size)) for p, size in self.paths for lo in range(0, size, self.step)] or [Range("", 0, 0)]

    def tried(self, what: str, once):
        """``once()``, tried anew after an OSError, with a growing pause."""
        for attempt in range(1, self.tries + 1):
            try:
                return once()
            except OSError as e:
                if attempt == self.tries:
                    raise OSError(f"{what}: {e}") from e
                time.sleep(0.1 * 2**attempt)
        raise AssertionError

    def member(self, source: Source, info: zipfile.ZipInfo) -> bytes:
        """One member by its offset; after a failed read the archive is opened anew and this member alone is tried again."""

        def once() -> bytes:
            try:
                f = source.handle()
                f.seek(info.header_offset)
                head = f.read(30)
                if len(head) < 30 or head[:4] != b"PK\x03\x04":
                    raise OSError("no local header at the member's offset")
                f.seek(info.header_offset + 30 + sum(struct.unpack("<HH", head[26:30])))
                body = f.read(info.compress_size)
                if len(body) != info.file_size or zlib.crc32(body) != info.CRC:
                    raise OSError("short or damaged member")
                return body
            except OSError:
                source.drop()
                raise

        return self.tried(f"{source.path} at {info.header_offset}", once)

    def directory(self, source: Source) -> list[zipfile.ZipInfo]:
        def once() -> list[zipfile.ZipInfo]:
            try:
                return zipfile.ZipFile(source.handle()).infolist()
            except zipfile.BadZipFile as e:
                source.drop()
                raise OSError(str(e)) from e
            except OSError:
                source.drop()
                raise

        return self.tried(f"{source.path}, its directory", once)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("doc_id", pa.int64()), ("media", pa.binary())])
        if not part.path:
            return
        source = Source(*_open(part.path))
        rows, size = [], 0
        for m in (m for m in self.directory(source) if part.start <= m.header_offset < part.end):
            key = m.filename.split(".")[1]
            rows.append({"archive": part.path, "offset": m.header_offset, "doc_id": int(key) if key else None, "media": self.member(source, m)})
            size += m.file_size
            if size >= self.batch:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        source.drop()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").option("archives", json of [path, size] pairs)``."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, offset long, doc_id long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, archives: list[tuple[str, int]], range_mb: int = 16) -> DataFrame:
    """Rows (archive, offset, doc_id, media) of all members."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").option("archives", json.dumps(archives)).option("rangeBytes", range_mb << 20).load()


def features(media: DataFrame) -> DataFrame:
    """Decodes ``media`` and describes it; keeps doc_id. Extra columns are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stored = cell.as_py()
                payload, n = decode(stored)
                out.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(payload)))
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], names)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(spark: SparkSession, docs: DataFrame, root: str | None = None) -> DataFrame:
    """Documents to archives, archives to features: one row per document.

    The archives stay under ``root`` (a new folder in spark.checkpoint.dir by default) for as long as
    the result is read. Null or empty text is 64 zero bytes; null and repeated doc_ids keep their own
    rows; an empty table gives no archives and no rows; other columns of ``docs`` are ignored.
    The driver holds one short row per archive, as it does for any file listing.
    """
    root = root or new_folder(spark, "media")
    where, path = _open(root)
    where.create_dir(path, recursive=True)
    written = write_archives(docs, root).where("members > 0").collect()
    sizes = []
    for r in sorted(written):
        w, p = _open(r.path)
        sizes.append((r.path, w.get_file_info(p).size))
    return features(read_archives(spark, sizes))


def member_bytes(archive: bytes, offset: int) -> bytes:
    """The member at ``offset`` of a whole archive (for tests and tools)."""
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        return next(z.read(m) for m in z.infolist() if m.header_offset == offset)
