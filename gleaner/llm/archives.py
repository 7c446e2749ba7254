"""Operator 4: media payloads in archives, read by a Spark data source in byte ranges, member by member.

Writing packs every text as an 8-bit grey image (PNG, lossless) into ZIP archives in a shared folder, and lists them in a
manifest. Reading plans partitions from the archives' sizes alone (those of the manifest, or of the files in the folder): each
holds byte ranges of archives, and of these the members whose header starts in them. A task reads an archive's directory
(bounded by ``ARCHIVE_BYTES``), then streams members in Arrow batches of bounded size. A member that fails is read again by its
offset, from a file opened anew, whatever the others do; one that keeps failing becomes a row with an error, or fails the task.
"""

from __future__ import annotations

import hashlib
import re
import struct
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gleaner.llm.common import Scratch

#: Samples in a row of an image; payloads are padded to a multiple of it with the byte PAD.
ROW, PAD = 192, b" "
#: An archive is closed at this size; a partition covers as many bytes, or more where there would be over MOST_RANGES of them; a batch
#: holds as many payload bytes.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 64 << 20, 16 << 20, 4 << 20
MOST_RANGES = 100_000
#: How often a member is tried, and the seconds before the second time (each later pause is twice as long).
ATTEMPTS, PAUSE = 3, 0.2
_PNG = b"\x89PNG\r\n\x1a\n"


def _fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI, and the path in it."""
    if re.match(r"^file:/(?!//)", uri):
        uri = "file:///" + uri[6:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def padded(data: bytes) -> bytes:
    """``data`` with PAD appended up to a positive multiple of ROW."""
    return data + PAD * (-len(data) % ROW if data else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes) -> bytes:
    """``data``, padded, as the samples of an 8-bit grey image; its unpadded length goes along as a text chunk."""
    samples = np.frombuffer(padded(data), dtype=np.uint8).reshape(-1, ROW)
    rows = np.zeros((len(samples), ROW + 1), dtype=np.uint8)
    rows[:, 1:] = samples
    head = struct.pack(">IIBBBBB", ROW, len(samples), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 2)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[np.ndarray, int]:
    """(samples, unpadded length) of an image that ``to_png`` made; raises ValueError if it is damaged."""
    if media[:8] != _PNG:
        raise ValueError("no PNG signature")
    at, shape, size, packed, ended = 8, None, None, [], False
    while at + 12 <= len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + data)):
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IHDR":
            shape = struct.unpack(">II", data[:8])
        elif kind == b"tEXt" and data.startswith(b"bytes\0"):
            size = int(data[6:])
        elif kind == b"IDAT":
            packed.append(data)
        ended |= kind == b"IEND"
        at += 12 + n
    if not ended or shape is None or size is None:
        raise ValueError("incomplete image")
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(shape[1], shape[0] + 1)
    if rows[:, 0].any():
        raise ValueError("row filters are not used here")
    return rows[:, 1:], size


class _Archive:
    """A ZIP archive of stored members, written in one go and moved to its name when complete."""

    def __init__(self, where: fs.FileSystem, path: str, attempt: int):
        self.fs, self.path, self.part = where, path, f"{path}.{attempt}.part"
        self.out, self.at, self.entries = where.open_output_stream(self.part), 0, []

    def add(self, name: str, data: bytes) -> None:
        raw, crc = name.encode(), zlib.crc32(data)
        self.out.write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 20, 0x800, 0, 0, 33, crc, len(data), len(data), len(raw), 0) + raw)
        self.out.write(data)
        self.entries.append((raw, crc, len(data), self.at))
        self.at += 30 + len(raw) + len(data)

    def close(self) -> None:
        start = self.at
        size = 0
        for raw, crc, n, at in self.entries:
            self.out.write(head := struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 20, 20, 0x800, 0, 0, 33, crc, n, n, len(raw), 0, 0, 0, 0, 0, at) + raw)
            size += len(head)
        count = min(len(self.entries), 0xFFFF)
        self.out.write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, count, count, size, start, 0))
        self.size = start + size + 22
        self.out.close()
        self.fs.move(self.part, self.path)


def directory(file: pa.NativeFile, size: int) -> list[tuple[int, int, str, int]]:
    """(offset of the header, size, name, crc32) of each member, read from the archive's end."""
    file.seek(size - 22)
    mark, *_, length, start, _ = struct.unpack("<IHHHHIIH", file.read(22))
    if mark != 0x06054B50:
        raise ValueError("no end of archive")
    file.seek(start)
    raw, at, out = file.read(length), 0, []
    while at < length:
        crc, n, _, k = struct.unpack_from("<IIIH", raw, at + 16)
        (offset,) = struct.unpack_from("<I", raw, at + 42)
        out.append((offset, n, raw[at + 46 : at + 46 + k].decode(), crc))
        at += 46 + k
    return out


def read_member(file: pa.NativeFile, offset: int, size: int, crc: int) -> bytes:
    """The payload of the member whose header is at ``offset``; raises ValueError if it isn't what the directory says."""
    file.seek(offset)
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no member at {offset}")
    name, extra = struct.unpack("<HH", head[26:30])
    file.seek(offset + 30 + name + extra)
    data = file.read(size)
    if len(data) != size or zlib.crc32(data) != crc:
        raise ValueError(f"member at {offset} is damaged")
    return data


class Ranges(InputPartition):
    """(path, size, start, end) of byte ranges of archives."""

    def __init__(self, parts: list[tuple[str, int, int, int]]):
        self.parts = parts


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.manifest = options["path"], options.get("manifest")
        self.step = int(options.get("rangebytes", RANGE_BYTES))
        self.attempts, self.fail = int(options.get("attempts", ATTEMPTS)), options.get("onerror", "row") == "fail"

    def archives(self) -> list[tuple[str, int]]:
        """(path, size) of the archives to read, by path."""
        if self.manifest:
            where, path = _fs(self.manifest)
            table = parquet.read_table(path, columns=["archive", "size"], filesystem=where)
            return sorted(zip(table["archive"].to_pylist(), table["size"].to_pylist(), strict=True))
        where, path = _fs(self.root)
        found = where.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted((f.path, f.size) for f in found if f.path.endswith(".zip"))

    def partitions(self) -> list[InputPartition]:
        found = self.archives()
        step = max(self.step, sum(n for _, n in found) // MOST_RANGES)
        out, held = [[]], 0
        for path, size in found:
            for a in range(0, size, step):
                b = min(a + step, size)
                if out[-1] and held + b - a > step:
                    out.append([])
                    held = 0
                out[-1].append((path, size, a, b))
                held += b - a
        return [Ranges(parts) for parts in out]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        where, _ = _fs(self.root)
        for path, size, start, end in partition.parts:
            rows: list[tuple] = []
            held = 0
            with where.open_input_file(path) as file:
                members = directory(file, size)
                for offset, n, name, crc in members:
                    if not start <= offset < end:
                        continue
                    data, tries, error = self._tried(where, path, file, offset, n, crc)
                    rows.append((path, offset, name, data, tries, error))
                    held += n
                    if held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)

    def _tried(self, where: fs.FileSystem, path: str, file: pa.NativeFile, offset: int, size: int, crc: int) -> tuple[bytes | None, int, str | None]:
        """(payload, tries, error) of a member: first from the open file, then each time from the file opened anew after a pause."""
        error = None
        for i in range(self.attempts):
            try:
                if not i:
                    return read_member(file, offset, size, crc), 1, None
                time.sleep(PAUSE * 2 ** (i - 1))
                with where.open_input_file(path) as again:
                    return read_member(again, offset, size, crc), i + 1, None
            except (OSError, ValueError) as e:
                error = str(e)
        if self.fail:
            raise OSError(f"{path}: {error}")
        return None, self.attempts, error


_KINDS = {"archive": pa.string(), "offset": pa.int64(), "name": pa.string(), "media": pa.binary(), "attempts": pa.int32(), "error": pa.string()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows, strict=True), _KINDS.values(), strict=True)], names=list(_KINDS))


class ArchiveSource(DataSource):
    """``spark.read.format("gleaner_archives").load(folder)``: a row for each member of the folder's archives.

    Options: ``manifest`` (a table of the archives to read, instead of all files in the folder), ``rangeBytes``, ``attempts``,
    ``onError`` (``row``: a member that can't be read is a row with an error; ``fail``: it fails the task, which Spark
    then repeats elsewhere).
    """

    @classmethod
    def name(cls) -> str:
        return "gleaner_archives"

    def schema(self) -> str:
        return "archive string, offset long, name string, media binary, attempts int, error string"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


def write_archives(docs: DataFrame, folder: str) -> DataFrame:
    """Stores the text of each row of ``docs`` (doc_id, text) in archives in ``folder``; (archive, members, bytes, size) of each.

    A member is named by its place and doc_id. An archive gets its final name, which only its partition and place in it
    determine, when complete: a repeated attempt replaces it by the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = _fs(folder)
        where.create_dir(root, recursive=True)
        task = TaskContext.get()
        done, open_, n = [], None, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if open_ is None:
                    open_ = _Archive(where, f"{root}/part-{task.partitionId():06d}-{len(done):04d}.zip", task.taskAttemptId())
                open_.add(f"{n}{'' if doc_id is None else f':{doc_id}'}.png", to_png((text or "").encode()))
                n += 1
                if open_.at >= ARCHIVE_BYTES or len(open_.entries) == 0xFFFF:
                    open_.close()
                    done.append(open_)
                    open_ = None
        if open_ is not None:
            open_.close()
            done.append(open_)
        yield pa.RecordBatch.from_arrays(
            [pa.array([a.path for a in done], type=pa.string()), *(pa.array(x, type=pa.int64()) for x in ([len(a.entries) for a in done], [a.at for a in done], [a.size for a in done]))],
            names=["archive", "members", "bytes", "size"],
        )

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "archive string, members long, bytes long, size long")


def features(samples: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples, and the 64 signs of the differences of neighbouring block means."""
    flat = samples.ravel()
    share = np.bincount(flat, minlength=256) / len(flat)
    some = share[share > 0]
    edges = np.linspace(0, len(flat), 66).astype(np.int64)
    total = np.concatenate(([0], np.cumsum(flat, dtype=np.int64)))
    means = (total[edges[1:]] - total[edges[:-1]]) / np.maximum(np.diff(edges), 1)
    signs = np.packbits(means[1:] > means[:-1]).tobytes().hex()
    level = np.arange(256)
    mean = float((share * level).sum())
    return f"{mean:.4f}:{float((share * (level - mean) ** 2).sum()) ** 0.5:.4f}:{abs(float((some * np.log2(some)).sum())):.4f}:{signs}"


def media_columns(spark: SparkSession, docs: DataFrame, on_error: str = "row") -> DataFrame:
    """doc_id and the columns of the stored and re-read media of each row of ``docs`` (doc_id, text): n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and error (null, or why a member could not be read,
    all others null then; with ``on_error`` "fail" such a member fails its task instead).

    - A null text counts as empty; an empty one is stored as one row of padding. Texts of any length are stored whole.
    - Equal texts give equal values. Repeated rows are members of their own; an empty table gives an empty result. doc_id may
      be null and of any type that goes to text and back.
    - The archives stay in the shared folder as long as results may be read.
    """
    scratch = Scratch(spark, "media")
    folder = f"{scratch.root}/archives"
    scratch.keep(write_archives(docs, folder), "manifest")
    spark.dataSource.register(ArchiveSource)
    members = spark.read.format("gleaner_archives").option("manifest", f"{scratch.root}/manifest").option("onError", on_error).load(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, media, error in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                _, has, key = name.removesuffix(".png").partition(":")
                doc_id = key if has else None
                row = (doc_id, *[None] * 7, error)
                if media is not None:
                    try:
                        samples, size = from_png(media)
                        data = samples.tobytes()
                        row = (doc_id, size, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(samples), None)
                    except (ValueError, zlib.error) as e:
                        if on_error == "fail":
                            raise
                        row = (doc_id, *[None] * 7, str(e))
                out.append(row)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            cols = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=[str(i) for i in range(len(kinds))])

    out = members.select("name", "media", "error").mapInArrow(
        run,
        "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string",
    )
    return out.withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]))
