"""Media columns: payloads stored as images in archives, read back through a custom Spark data source.

Storing: a payload (a text's bytes, filled up with 255) becomes an 8-bit greyscale PNG of 576 columns; each write task
appends its images to archives (zip, uncompressed members) in a shared directory. An archive is renamed to its final
name only when Spark commits the job, so a task that ran twice leaves one copy; what failed tasks left goes then.

Reading: the planner lists the archive directory and cuts every archive into byte ranges; nothing per member reaches
the driver. A task reads the archive's own directory and takes the members that start in its range, by offset, and
streams them as Arrow batches. A member that can't be read is tried again by itself: the file is opened anew and read
at that member's offset. One that stays unreadable fails the job or, if asked for, is a row without media that tells why.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import new_path, slices

WIDTH = 576
ARCHIVE_MEMBERS, ARCHIVE_BYTES = 10_000, 64 << 20
BATCH_BYTES = 4 << 20
_PNG = b"\x89PNG\r\n\x1a\n"
_DAY_ONE = (1980, 1, 1, 0, 0, 0)


def payload(text: str | None) -> bytes:
    """UTF-8 bytes, filled with 255 to a positive multiple of WIDTH; 255 occurs in no UTF-8."""
    b = (text or "").encode()
    return b + b"\xff" * (WIDTH - len(b) % WIDTH if len(b) % WIDTH or not b else 0)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(samples: bytes) -> bytes:
    """An 8-bit greyscale PNG with a sample for each byte."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row starts with its filter: none
    lines[:, 1:] = rows
    return _PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> np.ndarray:
    """The samples of such a PNG, a row for each line; every chunk's checksum is tested."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], (0, 0)
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("not 8-bit greyscale")
            shape = (height, width + 1)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape)
    if lines[:, 0].any():
        raise ValueError("filtered rows aren't used here")
    return lines[:, 1:]


def feature(rows: np.ndarray) -> str:
    """Height, mean, deviation and a 64-bit hash of column means against the whole mean; blank filling included."""
    mean = rows.mean()
    bits = rows.mean(0).reshape(64, -1).mean(1) > mean
    return f"h={len(rows)};mean={mean:.4f};std={rows.std():.4f};hash={int(''.join('01'[int(b)] for b in bits), 2):016x}"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def member_name(number: int, key: str | None) -> str:
    """A name that holds the key; a null one leaves it out."""
    return f"{number:08d}.png" if key is None else f"{number:08d}_{quote(key, safe='')}.png"


def member_key(name: str) -> str | None:
    _, mark, key = name.removesuffix(".png").partition("_")
    return unquote(key) if mark else None


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path, self.job = path, uuid.uuid4().hex

    def _pending(self, root: str) -> str:
        return f"{root}/.pending-{self.job}-"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        names: list[str] = []
        out = stream = None
        members = size = 0

        def close() -> None:
            if out is not None:
                out.close()
                stream.close()

        for batch in iterator:
            for key, media in zip(batch.column("key").to_pylist(), batch.column("media").to_pylist(), strict=True):
                if out is None or members >= ARCHIVE_MEMBERS or size >= ARCHIVE_BYTES:
                    close()
                    names.append(f"{uuid.uuid4().hex}.zip")
                    stream = store.open_output_stream(self._pending(root) + names[-1])
                    out, members, size = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED), 0, 0
                out.writestr(zipfile.ZipInfo(member_name(members, key), _DAY_ONE), media)
                members, size = members + 1, size + len(media)
        close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        for name in (n for m in messages if m for n in m.names):
            store.move(self._pending(root) + name, f"{root}/{name}")
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_open(self.path))

    def _clear(self, store: pafs.FileSystem, root: str) -> None:
        """Archives of this job's failed tasks."""
        for f in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(self._pending("")[1:]):
                store.delete_file(f.path)


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, split: int, tries: int, skip_unreadable: bool) -> None:
        self.path, self.split, self.tries, self.skip_unreadable = path, split, tries, skip_unreadable

    def partitions(self) -> list[ByteRange]:
        store, root = _open(self.path)
        files = store.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        found = sorted((f.path, f.size) for f in files if f.base_name.endswith(".zip") and not f.base_name.startswith("."))
        return [ByteRange(p, a, min(a + self.split, n)) for p, n in found for a in range(0, n, self.split)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = _open(self.path)
        with store.open_input_file(partition.path) as f, zipfile.ZipFile(f) as z:
            members = [(i.header_offset, i.file_size, i.CRC, i.filename) for i in z.infolist() if partition.start <= i.header_offset < partition.end]
        with Members(store, partition.path, self.tries) as source:
            rows: list[tuple] = []
            size = 0
            for offset, n, crc, name in members:
                media, error = None, None
                try:
                    media = source.read(offset, n, crc, name)
                except OSError as e:
                    if not self.skip_unreadable:
                        raise
                    error = str(e)
                rows.append((member_key(name), media, partition.path, offset, error))
                size += n
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Typed columns, whatever is null in these rows."""
    kinds = {"key": pa.string(), "media": pa.binary(), "archive": pa.string(), "offset": pa.int64(), "error": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=[*kinds])


class Members:
    """Reads members of one archive by offset; a failed one is read again from a newly opened file."""

    def __init__(self, store: pafs.FileSystem, path: str, tries: int) -> None:
        self.store, self.path, self.tries, self.file = store, path, tries, None

    def __enter__(self) -> Members:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None

    def read(self, offset: int, n: int, crc: int, name: str) -> bytes:
        for left in reversed(range(self.tries)):
            try:
                if self.file is None:
                    self.file = self.store.open_input_file(self.path)
                self.file.seek(offset)
                head = self.file.read(30)
                if head[:4] != b"PK\x03\x04":
                    raise OSError("no member starts here")
                self.file.seek(offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
                data = self.file.read(n)
                if len(data) != n or zlib.crc32(data) != crc:
                    raise OSError("member is cut short or damaged")
                return data
            except (OSError, struct.error) as e:
                self.close()
                if not left:
                    raise OSError(f"{self.path}, member {name} at {offset}: {e}") from e
                time.sleep(0.1)
        raise ValueError("tries must be positive")


class MediaArchives(DataSource):
    """Options: path (a directory URI), split (bytes of a read partition), tries (for each member), skip_unreadable (a
    member that all tries fail on gives a row with a null media and an error instead of failing the job)."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "key string, media binary, archive string, offset long, error string"

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("split", 8 << 20)), int(self.options.get("tries", 3)), str(self.options.get("skip_unreadable", "false")).lower() == "true")


def store(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> None:
    """Write every row's payload as a member of archives under `path`."""
    spark = docs.sparkSession
    spark.dataSource.register(MediaArchives)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            media = [encode(payload(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary()), pa.nulls(len(media), pa.string()), pa.nulls(len(media), pa.int64()), pa.nulls(len(media), pa.string())], names=["key", "media", "archive", "offset", "error"])

    docs.select(docs[key].cast("string").alias("key"), text).mapInArrow(run, "key string, media binary, archive string, offset long, error string").write.format("media_archives").mode("append").option("path", path).save()


def load(spark: SparkSession, path: str, *, split: int = 8 << 20, tries: int = 3, skip_unreadable: bool = False) -> DataFrame:
    """key, media, archive, offset and error of every member under `path`; an empty or missing directory has none. An
    archive whose own directory can't be read fails the job."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("path", path).option("split", split).option("tries", tries).option("skip_unreadable", skip_unreadable).load()


def describe(media: DataFrame) -> DataFrame:
    """Per member: key, sizes, digests of the payload and of the stored form, and the feature of its samples; all null
    but the key where there is no media."""
    cols = "key string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def one(m: bytes) -> tuple:
        rows = decode(m)
        p = rows.tobytes()
        return len(p.rstrip(b"\xff")), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in slices(batches):
            found = [one(m) if m is not None else (None,) * 7 for m in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in found], k) for i, k in enumerate(kinds))], names=[c.split()[0] for c in cols.split(", ")])

    return media.select("key", "media").mapInArrow(run, cols)


def media_column(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Store all rows of `docs`, read them back and describe them: key and the columns of `describe`.

    A null text is stored as an empty one (576 bytes of 255); null keys and repeated rows are members of their own.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "media")
    store(docs, path, key=key, text=text)
    out = describe(load(spark, path))
    return out.withColumn("key", out["key"].cast(dict(docs.dtypes)[key])).withColumnRenamed("key", key)
