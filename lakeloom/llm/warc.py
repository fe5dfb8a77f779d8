"""Legacy ARC archives, their conversion to WARC, and reading WARC back.

ARC files start with a version block whose first line gives the version and whose last
line names the fields of the record header lines; records follow, each a header line, a
body of the declared length and a line feed. Version 1 lines have five fields, version
2 lines ten. The converter reads the version from the file, checks the declared lengths and
writes an equivalent WARC/1.1 file: a warcinfo record, then a response for each record (or
a revisit, where another record with the same payload stands for it) with an identifier
derived from the record's name, an ISO timestamp, and block and payload digests. Every
record is a gzip member of its own, in both formats.

Archives live in the shared folder and are written by tasks, one row about each record comes
back. A null payload is empty; a null name is written as "-" and read back as null. Names and
payloads may repeat; of equal names each is a record. An empty table gives no files and an empty result. Bytes outside
printable ASCII in urls are percent-encoded, because ARC lines are split at blanks. Only the
three columns named are read, so others cannot clash. A payload is held whole, with its record and compressed, in the
task at hand, and a file holds at least one record; a payload of 2 GB or more does not fit a value of Spark's and fails there.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archives import fetch, list_files, put
from .common import discard, drop_folder, scratch, ship, spread_join, stored, tidy

FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:lakeloom:record")
EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 1


def _member(data: bytes) -> bytes:
    return gzip.compress(data, LEVEL, mtime=0)


def inflate(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int]:
    """The gzip member at an offset, and where it ends."""
    stream, view, out = zlib.decompressobj(31), memoryview(data), []
    start = at
    while not stream.eof:
        if at >= len(data):
            raise ValueError(f"gzip member at {start} is cut short")
        out.append(stream.decompress(view[at : at + step]))
        at = min(at + step, len(data))
    return b"".join(out), at - len(stream.unused_data)


def members(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        content, at = inflate(data, at)
        yield content


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"


# -- ARC ------------------------------------------------------------------------------------


def arc_version_block(version: int, file: str) -> bytes:
    body = f"{version} 0 lakeloom\n{FIELDS[version]}\n".encode()
    line = f"filedesc://{file} 0.0.0.0 {EPOCH:%Y%m%d%H%M%S} text/plain "
    line += f"{len(body)}\n" if version == 1 else f"200 - - 0 {file} {len(body)}\n"
    return line.encode() + body + b"\n"


def arc_record(version: int, name: str, url: str | None, payload: bytes, stamp: datetime, file: str, offset: int) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Record-Name: {name}\r\n\r\n"
    body = head.encode() + payload
    line = f"{quote(url, safe=_SAFE) if url else '-'} 0.0.0.0 {stamp:%Y%m%d%H%M%S} text/html "
    line += f"{len(body)}\n" if version == 1 else f"200 {zlib.crc32(body):08x} - {offset} {file} {len(body)}\n"
    return line.encode() + body + b"\n"


_SAFE = "".join(chr(c) for c in range(33, 127))


def parse_arc(content: bytes, fields: list[str] | None) -> tuple[dict[str, str], bytes]:
    """(header fields, body) of a record; fields None: the version block, which names them."""
    line, _, rest = content.partition(b"\n")
    values = line.decode("ascii").split(" ")
    names = fields or FIELDS[1 if len(values) == 5 else 2].split(" ")
    if len(values) != len(names):
        raise ValueError(f"ARC line has {len(values)} fields, its version {len(names)}")
    head = dict(zip(names, values, strict=True))
    size = int(head["Archive-length"])
    if len(rest) < size or rest[size:] not in (b"", b"\n"):
        raise ValueError(f"ARC record declares {size} bytes and has {len(rest)}")
    if "Checksum" in head and head["Checksum"] != "-" and int(head["Checksum"], 16) != zlib.crc32(rest[:size]):
        raise ValueError("ARC checksum differs")
    return head, rest[:size]


def arc_fields(content: bytes) -> list[str]:
    """Field names of the records behind a version block."""
    _, body = parse_arc(content, None)
    lines = body.decode("ascii").splitlines()
    version = int(lines[0].split(" ")[0])
    if version not in FIELDS or lines[1] != FIELDS[version]:
        raise ValueError(f"unknown ARC version line {lines[0]!r}")
    return lines[1].split(" ")


def split_http(body: bytes) -> tuple[bytes, bytes]:
    head, blank, payload = body.partition(b"\r\n\r\n")
    return head + blank, payload


def http_field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.lower() == name.lower().encode():
            return value.strip().decode()
    return None


# -- WARC -----------------------------------------------------------------------------------


def _sha256(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def warc_record(kind: str, identifier: str, stamp: datetime, block: bytes, fields: dict[str, str]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": identifier, "WARC-Date": f"{stamp:%Y-%m-%dT%H:%M:%SZ}", **fields, "WARC-Block-Digest": "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(), "Content-Length": str(len(block))}
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def warc_info(file: str) -> bytes:
    block = f"software: lakeloom\r\nformat: WARC File Format 1.1\r\nconvertedFrom: {file}\r\n".encode()
    return warc_record("warcinfo", record_id(f"info/{file}"), EPOCH, block, {"WARC-Filename": file, "Content-Type": "application/warc-fields"})


def convert_record(head: dict[str, str], body: bytes, original: str | None) -> bytes:
    """The WARC record for an ARC record; `original` is the name of the record it revisits."""
    http, payload = split_http(body)
    name = http_field(http, "X-Record-Name") or "-"
    stamp = datetime.strptime(head["Archive-date"], "%Y%m%d%H%M%S").replace(tzinfo=UTC)
    fields = {"WARC-Target-URI": head["URL"], "WARC-IP-Address": head["IP-address"], "WARC-Payload-Digest": _sha256(payload), "Content-Type": "application/http;msgtype=response"}
    if original is None:
        return warc_record("response", record_id(name), stamp, body, fields)
    return warc_record("revisit", record_id(name), stamp, http, {**fields, "WARC-Profile": PROFILE, "WARC-Refers-To": record_id(original), "WARC-Refers-To-Name": original})


def parse_warc(content: bytes) -> tuple[dict[str, str], bytes]:
    head, blank, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not blank or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if len(rest) < size:
        raise ValueError("WARC block is cut short")
    block = rest[:size]
    if (want := fields.get("WARC-Block-Digest", "")).startswith("sha1:") and want[5:] != base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError("WARC block digest differs")
    return fields, block


# -- tasks ----------------------------------------------------------------------------------


def write_arcs(rows: DataFrame, folder: str, name: str, url: str, payload: str, most_bytes: int = 32 << 20) -> DataFrame:
    """Write ARC files of at most about most_bytes of bodies; one row for each record.

    Rows: file, at (offset), name, size, digest. Files of even number have version 1, others 2.
    """
    ship(rows.sparkSession)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size, about = TaskContext.get().partitionId(), 0, bytearray(), 0, []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, size, about
            if about:
                put(f"{folder}/{file()}", bytes(held))
                yield pa.RecordBatch.from_pylist(about, schema=pa.schema([("file", pa.string()), ("at", pa.int64()), ("name", pa.string()), ("size", pa.int64()), ("digest", pa.string())]))
                number, held, size, about = number + 1, bytearray(), 0, []

        def file() -> str:
            return f"part-{part:06d}-{number:04d}.arc.gz"

        for batch in batches:
            for key, address, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, version = (data or b""), 1 + (part + number) % 2
                if not held:
                    held += _member(arc_version_block(version, file()))
                stamp = EPOCH + timedelta(seconds=len(about))
                about.append({"file": file(), "at": len(held), "name": key, "size": len(data), "digest": hashlib.sha256(data).hexdigest()})
                held += _member(arc_record(version, "-" if key is None else key, address, data, stamp, file(), len(held)))
                size += len(data) + 256  # the lines around a payload count too, so that empty ones fill a file
                if size >= most_bytes:
                    yield from close()
        yield from close()

    columns = rows.select(F.col(name).cast("string").alias("n"), F.col(url).cast("string").alias("u"), F.col(payload).cast("binary").alias("p"))
    return columns.mapInArrow(tidy(written), "file string, at long, name string, size long, digest string")


def convert_arcs(plan: DataFrame, files: int, source: str, target: str) -> DataFrame:
    """Convert ARC files by a plan (file, at, original), one task each; one row for each WARC file: file, records.

    A file is read from its start to its end. Only the records that revisit others are handed over as a list,
    which is no longer than the file's records: at 256 bytes a record counts towards most_bytes, some 130,000.
    """
    ship(plan.sparkSession)
    kind = "struct<at:bigint,original:string>"
    revisits = F.when(F.col("original").isNotNull(), F.struct("at", "original"))
    jobs = plan.groupBy("file").agg(F.collect_list(revisits).cast(f"array<{kind}>").alias("revisits")).repartition(max(1, files))

    def converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                originals = {x["at"]: x["original"] for x in held}
                data = fetch(f"{source}/{name}")
                block, at = inflate(data, 0)
                fields, to, n = arc_fields(block), name.replace(".arc.gz", ".warc.gz"), 0
                out = bytearray(_member(warc_info(to)))
                while at < len(data):
                    began = at
                    content, at = inflate(data, began)
                    out += _member(convert_record(*parse_arc(content, fields), originals.get(began)))
                    n += 1
                put(f"{target}/{to}", bytes(out))
                yield pa.RecordBatch.from_pydict({"file": [to], "records": pa.array([n], pa.int64())})

    return jobs.mapInArrow(tidy(converted), "file string, records long")


def read_warcs(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all WARC files of a folder: name, url, kind, size, digest, refers_to, payload (null for revisits).

    The digest of a response is computed from the bytes read and must be the declared one.
    """
    ship(spark)
    files = list_files(folder, ".warc.gz")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("name", pa.string()), ("url", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                for content in members(fetch(path)):
                    fields, block = parse_warc(content)
                    kind = fields["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    http, payload = split_http(block)
                    declared = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else declared
                    size = len(payload) if kind == "response" else int(http_field(http, "Content-Length") or 0)
                    if digest != declared or size != int(http_field(http, "Content-Length") or 0):
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from what is declared")
                    name, url = http_field(http, "X-Record-Name"), fields["WARC-Target-URI"]
                    rows.append({"name": None if name == "-" else name, "url": None if url == "-" else url, "kind": kind, "size": size, "digest": digest, "refers_to": fields.get("WARC-Refers-To-Name"), "payload": payload if kind == "response" else None})
                    held += size
                    if held >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    listed = spark.createDataFrame([(u,) for u, _ in files], "path string").repartition(max(1, len(files)))
    return listed.mapInArrow(tidy(read), "name string, url string, kind string, size long, digest string, refers_to string, payload binary")


def archive(rows: DataFrame, name: str, url: str, payload: str, least_bytes: int = 100) -> str:
    """Write rows as ARC, convert to WARC with revisits, return the WARC folder.

    Of records with equal payloads of least_bytes or more, that with the least name (an
    integer) is the response and the others revisit it. Records without a name never stand
    for others.
    """
    spark = rows.sparkSession
    source, target = scratch(spark, "arc"), scratch(spark, "warc")
    index = stored(write_arcs(rows, source, name, url, payload), "arc-index")
    first = index.filter((F.col("size") >= least_bytes) & F.col("name").isNotNull()).groupBy("digest", "size").agg(F.min(F.col("name").cast("long")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = stored(first, "arc-first")
    found = spread_join(index, first.drop("n"), ["digest", "size"], first, index.count(), "left")
    original = F.when(F.col("first") != F.coalesce(F.col("name").cast("long"), F.lit(-1)), F.col("first").cast("string"))
    files = len(list_files(source, ".arc.gz"))
    done = stored(convert_arcs(found.withColumn("original", original), files, source, target), "warc-files")
    if done.agg(F.sum("records")).first()[0] not in (None, index.count()):
        raise ValueError("the WARC files do not hold as many records as the ARC files")
    discard(index, first, done)
    drop_folder(spark, source)
    return target
