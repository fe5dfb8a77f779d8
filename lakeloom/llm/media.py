"""Payloads stored as media files in archives, and a Spark data source that reads them.

A payload is written as an 8-bit greyscale PNG (one byte a pixel, WIDTH pixels a row), so it
is kept without loss; PNG files are members of stored (not deflated) ZIP archives.

The data source "media_archive" plans byte ranges over the archives of a folder from their
sizes alone. A task reads its archive's central directory, takes the members whose local
header starts in its range, reads some READ_BYTES of them at a time, and streams them in Arrow batches of bounded size. A member
that fails is tried again by itself, at its offset, through a new handle, `retries` times;
then the task fails, or with onError=row gives a row with the reason in `error`.

Null payloads are empty ones. An empty payload is padded like any other, to PAD bytes of
zeros. Names may repeat or be null; equal payloads have equal files. An empty table gives
no archives and an empty result. Only the two columns named are read, and the result's columns are fixed, so none can clash. A very
long payload closes its archive and is held whole, raw and compressed, in the task at hand; one of 2 GB or more does not fit a value of Spark's and fails there.
"""

from __future__ import annotations

import struct
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .archives import fetch, list_files, put
from .common import discard, scratch, ship, stored, tidy

PAD, WIDTH = 64, 64
MAGIC = b"\x89PNG\r\n\x1a\n"
LEVEL = 2
MOST_MEMBERS = 60_000
READ_BYTES = 4 << 20


def padded(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of PAD."""
    return data + bytes(PAD if not data else -len(data) % PAD)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """payload, a multiple of WIDTH bytes, as an image of WIDTH columns."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)  # each line begins with its filter, 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> tuple[bytes, int, int]:
    """(samples, width, height) of an 8-bit greyscale image with unfiltered lines."""
    if data[:8] != MAGIC:
        raise ValueError("not a PNG file")
    at, body, size = 8, [], (0, 0)
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + n]
        if len(part) < n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + part):
            raise ValueError(f"PNG chunk {kind!r} is damaged")
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", part)
            if (depth, colour) != (8, 0):
                raise ValueError("only 8-bit greyscale is read")
            size = width, height
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines are not read")
    return lines[:, 1:].tobytes(), *size


def feature(samples: bytes) -> str:
    """Mean, deviation, entropy and 16 band shares of the samples, as text."""
    counts = np.bincount(np.frombuffer(samples, dtype=np.uint8), minlength=256)
    share, level = counts / counts.sum(), np.arange(256)
    mean = float((share * level).sum())
    spread = float((share * (level - mean) ** 2).sum()) ** 0.5
    used = share[share > 0]
    bands = np.rint(share.reshape(16, 16).sum(axis=1) * 1000).astype(int)
    return f"mean={mean:.3f};sd={spread:.3f};entropy={-(used * np.log2(used)).sum() + 0.0:.3f};bands={','.join(map(str, bands))}"


# -- archives -------------------------------------------------------------------------------

_LOCAL, _CENTRAL, _LAST = struct.Struct("<IHHHHHIIIHH"), struct.Struct("<IHHHHHHIIIHHHHHII"), struct.Struct("<IHHHHIIH")


class ZipBuilder:
    """A stored ZIP archive in memory."""

    def __init__(self) -> None:
        self.data, self._index, self.members = bytearray(), bytearray(), 0

    def add(self, name: str, body: bytes) -> None:
        raw, crc, at = name.encode(), zlib.crc32(body), len(self.data)
        self.data += _LOCAL.pack(0x04034B50, 20, 0x800, 0, 0, 0x21, crc, len(body), len(body), len(raw), 0) + raw + body
        self._index += _CENTRAL.pack(0x02014B50, 20, 20, 0x800, 0, 0, 0x21, crc, len(body), len(body), len(raw), 0, 0, 0, 0, 0, at) + raw
        self.members += 1

    def close(self) -> bytes:
        at = len(self.data)
        return bytes(self.data + self._index + _LAST.pack(0x06054B50, 0, 0, self.members, self.members, len(self._index), at, 0))


def directory(uri: str, size: int) -> list[tuple[str, int, int, int]]:
    """(name, offset, size, crc) of the members, from the end of the file."""
    tail = fetch(uri, max(0, size - _LAST.size), _LAST.size)
    mark, _, _, _, count, length, at, _ = _LAST.unpack(tail)
    if mark != 0x06054B50:
        raise ValueError(f"{uri} has no central directory")
    index, out, pos = fetch(uri, at, length), [], 0
    for _ in range(count):
        fields = _CENTRAL.unpack_from(index, pos)
        pos += _CENTRAL.size
        out.append((index[pos : pos + fields[10]].decode(), fields[16], fields[8], fields[7]))
        pos += fields[10] + fields[11] + fields[12]
    return out


def member_of(data: bytes | memoryview, size: int, crc: int, name: str) -> bytes:
    """A member from the bytes that begin at its local header, which must agree with the directory."""
    raw = name.encode()
    if len(data) < _LOCAL.size:
        raise ValueError(f"member {name!r} is cut short")
    fields = _LOCAL.unpack_from(data)
    at = _LOCAL.size + fields[9] + fields[10]
    if fields[0] != 0x04034B50 or bytes(data[_LOCAL.size : _LOCAL.size + fields[9]]) != raw:
        raise ValueError(f"no member {name!r} where the directory has it")
    body = bytes(data[at : at + size])
    if len(body) != size or zlib.crc32(body) != crc:
        raise ValueError(f"member {name!r} is damaged")
    return body


def read_member(uri: str, offset: int, size: int, crc: int, name: str) -> bytes:
    """One member by its offset, through a handle of its own."""
    return member_of(fetch(uri, offset, _LOCAL.size + len(name.encode()) + size), size, crc, name)


def write_archives(rows: DataFrame, folder: str, name: str, payload: str, most_bytes: int = 48 << 20) -> DataFrame:
    """Store payloads as PNG members, named member number / name; one row for each archive: file, members."""

    ship(rows.sparkSession)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, ZipBuilder()

        def close() -> pa.RecordBatch:
            nonlocal number, held
            file, count = f"part-{part:06d}-{number:04d}.zip", held.members
            put(f"{folder}/{file}", held.close())
            number, held = number + 1, ZipBuilder()
            return pa.RecordBatch.from_pydict({"file": [file], "members": pa.array([count], pa.int64())})

        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.add(f"{'' if key is None else key}.{len(data or b'')}.png", encode_png(padded(data or b"")))
                if len(held.data) >= most_bytes or held.members >= MOST_MEMBERS:
                    yield close()
        if held.members:
            yield close()

    return rows.select(F.col(name).cast("string").alias("n"), F.col(payload).cast("binary").alias("p")).mapInArrow(tidy(written), "file string, members long")


@dataclass
class Range(InputPartition):
    uri: str
    size: int
    start: int
    end: int


class ArchiveSource(DataSource):
    """format("media_archive").load(folder); options rangeBytes, retries, onError (fail or row)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "name string, n_bytes long, media binary, payload binary, width int, height int, feature string, uri string, offset long, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", 16 << 20)))
        self.retries = int(options.get("retries", 3))
        self.as_rows = options.get("onerror", options.get("onError", "fail")) == "row"

    def partitions(self) -> list[Range]:
        cuts = [(uri, size, at) for uri, size in list_files(self.folder, ".zip") for at in range(0, size, self.range_bytes)]
        return [Range(uri, size, at, min(size, at + self.range_bytes)) for uri, size, at in cuts] or [Range("", 0, 0, 0)]

    def _decoded(self, uri: str, member: tuple[str, int, int, int], held: memoryview) -> dict:
        """A member out of the bytes at hand; where they fail, by its own offset, `retries` times."""
        name, offset, size, crc = member
        key, n_bytes, _ = name.rsplit(".", 2)
        row = {"name": key or None, "n_bytes": int(n_bytes), "uri": uri, "offset": offset}
        for left in range(self.retries, -1, -1):
            try:
                media = member_of(held, size, crc, name) if left == self.retries else read_member(uri, offset, size, crc, name)
                payload, width, height = decode_png(media)
                return {**row, "media": media, "payload": payload, "width": width, "height": height, "feature": feature(payload), "error": None}
            except (OSError, ValueError, zlib.error, struct.error) as failure:
                if not left:
                    if self.as_rows:
                        return {**row, "media": None, "payload": None, "width": None, "height": None, "feature": None, "error": str(failure)}
                    raise
                time.sleep(0.05 * (self.retries - left))

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("name", pa.string()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("width", pa.int32()), ("height", pa.int32()), ("feature", pa.string()), ("uri", pa.string()), ("offset", pa.int64()), ("error", pa.string())])
        own = sorted((m for m in (directory(partition.uri, partition.size) if partition.uri else ()) if partition.start <= m[1] < partition.end), key=lambda m: m[1])
        rows, held, data, base = [], 0, b"", 0
        for i, member in enumerate(own):
            end = member[1] + _LOCAL.size + len(member[0].encode()) + member[2]
            if end > base + len(data):  # the next members that fill READ_BYTES, or this one alone, in one request
                base = member[1]
                fits = [m[1] + _LOCAL.size + len(m[0].encode()) + m[2] for m in own[i : i + 4096]]
                until = max([e for e in fits if e - base <= READ_BYTES], default=end)
                try:
                    data = fetch(partition.uri, base, max(until, end) - base)
                except OSError:  # each member then tries by itself
                    data = b""
            rows.append(self._decoded(partition.uri, member, memoryview(data)[member[1] - base : end - base]))
            held += len(rows[-1]["payload"] or b"") + member[2]
            if held >= 8 << 20 or len(rows) >= 4096:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").options(**options).load(folder)


def store_payloads(rows: DataFrame, name: str, payload: str) -> str:
    """Write the archives of rows and return their folder."""
    folder = scratch(rows.sparkSession, "media")
    discard(stored(write_archives(rows, folder, name, payload), "media-files"))
    return folder
