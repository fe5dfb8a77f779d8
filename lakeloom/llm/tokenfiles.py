"""Flat token files and the lengths of the documents in them, found by their separators.

A token file is little-endian unsigned 16- or 32-bit ids, one document after the other, each
closed by the end-of-document id; there is no index. A scan cuts the files into blocks of
`block_tokens`, searches each block for the end id with one vectorised comparison, and
yields the block's summary (ids before its first separator, ids behind its last one,
separators) and the lengths of the documents that lie inside it. A prefix scan over the
summaries of a file then carries the open document from block to block: it gives the number of
documents before each block and what has been read of the document that its head continues.

Ids behind the last separator of a file are an unfinished document, reported with
closed = false. A file without ids has no documents. Writing: null texts are empty documents,
which are an end id alone; a text's own end ids, if the tokenizer has a text for them, would
split it, so they are escaped by encoding that text in two parts. Ids of rows go to a
companion table in the order of the file, which the scan does not read; null ids stay null and repeated rows are
documents of their own. A very long text is encoded in one piece and closes its file; a document may cover any number of
blocks. Empty files give no blocks, an empty table gives no files and an empty result. Only id and text are read, so
other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .archives import fetch, list_files, put
from .common import ship, tidy
from .tokens import encoder
from .words import slices


def write_token_files(docs: DataFrame, folder: str, key: str, text: str, tokenizer: str, end_id: int, end_text: str = "<|endoftext|>", width: int = 2, most_tokens: int = 16_000_000) -> DataFrame:
    """Write files of up to about most_tokens; one row for each document: file, number, id."""
    ship(docs.sparkSession)
    kind = {2: "<u2", 4: "<u4"}[width]

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, False)
        part, number, held, size, keys = TaskContext.get().partitionId(), 0, [], 0, []
        end = np.array([end_id], dtype=kind).tobytes()

        def close() -> pa.RecordBatch:
            nonlocal number, held, size, keys
            file = f"part-{part:06d}-{number:04d}.tok"
            put(f"{folder}/{file}", b"".join(held))
            out = pa.RecordBatch.from_arrays([pa.array([file] * len(keys)), pa.array(np.arange(len(keys))), pa.array(keys, pa.int64())], names=["file", "number", "id"])
            number, held, size, keys = number + 1, [], 0, []
            return out

        for batch in batches:
            texts = batch.column(1).fill_null("")
            for a, b in slices(texts, 2 << 20):
                raw = texts.slice(a, b - a).cast(pa.binary()).to_pylist()
                whole = coder.encode([x for t in raw for x in _without(t, end_text)])
                at = 0
                for row, t in zip(batch.column(0).slice(a, b - a).to_pylist(), raw, strict=True):
                    n = len(_without(t, end_text))
                    ids = np.frombuffer(b"".join(whole[at : at + n]), dtype="<u4").astype(kind)
                    at += n
                    held += [ids.tobytes(), end]
                    size += len(ids) + 1
                    keys.append(row)
                if size >= most_tokens:
                    yield close()
        if keys:
            yield close()

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(tidy(written), "file string, number long, id long")


def _without(raw: bytes, end_text: str) -> list[bytes]:
    """raw in parts that do not hold end_text, each of which has its first character cut off."""
    mark = end_text.encode()
    if not mark or mark not in raw:
        return [raw]
    pieces = raw.split(mark)
    return [x for i, p in enumerate(pieces) for x in ([p] if not i else [mark[:1], mark[1:] + p])]


def _block(ids: np.ndarray, end_id: int) -> tuple[int, int, np.ndarray]:
    """(ids before the first separator, ids behind the last, lengths of what lies between)."""
    at = np.flatnonzero(ids == end_id)
    if not len(at):
        return len(ids), 0, at
    return int(at[0]), len(ids) - 1 - int(at[-1]), np.diff(at) - 1


def scan_token_files(spark: SparkSession, folder: str, end_id: int, width: int = 2, block_tokens: int = 1 << 21) -> DataFrame:
    """One row for each document: file, number (its place in the file), n_tokens (without the end), closed."""
    ship(spark)
    kind = {2: "<u2", 4: "<u4"}[width]
    files, step = list_files(folder, ".tok"), block_tokens * width
    number = F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long"))).alias("block", "at")
    plan = spark.createDataFrame([f for f in files if f[1]], "uri string, size long").select("uri", number)
    plan = plan.repartition(max(1, sum(-(-size // step) for _, size in files)))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, block, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(fetch(uri, at, block_tokens * width), dtype=kind)
                head, tail, inner = _block(ids, end_id)
                seps = int((ids == end_id).sum()) if not len(inner) else len(inner) + 1
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([block], pa.int32()), pa.array([head], pa.int64()), pa.array([tail], pa.int64()), pa.array([seps], pa.int64()), pa.array([inner.tolist()], pa.list_(pa.int64()))], names=["uri", "block", "head", "tail", "seps", "inner"])

    rows = plan.mapInArrow(tidy(scanned), "uri string, block int, head long, tail long, seps long, inner array<long>")
    before = Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    # The scan's state is (separators so far, ids since the last one). A block with separators sets
    # the second to its tail; one without adds its length, which is its head.
    summed = rows.withColumn("group", F.sum((F.col("seps") > 0).cast("int")).over(upto))
    inside = Window.partitionBy("uri", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    summed = summed.withColumn("open", F.sum(F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("head"))).over(inside))
    files = Window.partitionBy("uri").orderBy("block")
    state = summed.withColumns({"first": F.coalesce(F.sum("seps").over(before), F.lit(0)), "carried": F.coalesce(F.lag("open").over(files), F.lit(0)), "last": F.lead("block").over(files).isNull()})
    lengths = F.when(F.col("seps") > 0, F.concat(F.array(F.col("carried") + F.col("head")), F.col("inner"))).otherwise(F.array().cast("array<long>"))
    ended = F.transform(lengths, lambda x: F.struct(x.alias("n_tokens"), F.lit(True).alias("closed")))
    rest = F.when(F.col("last") & (F.col("open") > 0), F.array(F.struct(F.col("open").alias("n_tokens"), F.lit(False).alias("closed")))).otherwise(F.array().cast("array<struct<n_tokens:long,closed:boolean>>"))
    found = state.select("uri", "first", F.posexplode(F.concat(ended, rest)).alias("i", "x"))
    return found.select(F.element_at(F.split("uri", "/"), -1).alias("file"), (F.col("first") + F.col("i")).alias("number"), "x.n_tokens", "x.closed")
