"""Session helpers shared by the corpus operators: shared folders, lineage cuts, splits, tables."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.shared import drop_folder, scratch_folder


HOT_KEYS = 4096


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a context, so that they need no copy of their own.

    Every function that hands one of this package's own to tasks calls this first.
    """
    context = spark.sparkContext
    if getattr(context, "_lakeloom_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="lakeloom-code-")) / "lakeloom.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, str(Path(root.name) / file.relative_to(root)))
    context.addPyFile(str(target))
    context._lakeloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder."""
    ship(spark)
    return scratch_folder(spark, label)


def stored(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends there."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what stored() wrote for these, which nothing may read any more."""
    for df in frames:
        drop_folder(df.sparkSession, df._stored_path)


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def least_hashed(df: DataFrame, key: str, k: int, n: int) -> DataFrame:
    """The k rows of least hash of their key, of about n rows.

    Rows whose hash is too large to be among them go first, so a task hands on its share of
    some 2 * k rows and not k rows of its own.
    """
    spread = F.xxhash64(key)
    if n > 4 * k:
        df = df.filter(F.pmod(spread, F.lit(1 << 31)) < int((1 << 31) * 2 * k / n))
    return df.orderBy(F.pmod(spread, F.lit(1 << 31)), key).limit(k)


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], sizes: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """many joined with few on keys (inner or left), the rows of a hot key dealt to several tasks.

    few has one row for each key; sizes gives n, the rows of many by key, and total is their sum. A key of more
    than total / HOT_KEYS rows is cut into parts of that size, and few's row is repeated for each. There are fewer than
    HOT_KEYS such keys, with at most twice as many parts, so the list of them is broadcast. Rows with null keys,
    which match nothing, are dealt out too.
    """
    most = max(1, total // HOT_KEYS)
    hot = sizes.filter(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("_parts"))
    # One more row, of key 0 and one part, which changes nothing: without hot keys too the list is then not empty,
    # and the plan, and what each join in it is seen to do, stays the same.
    zero = many.sparkSession.range(1).select(*[F.col("id").cast(sizes.schema[k].dataType).alias(k) for k in keys], F.lit(1).alias("_parts"))
    hot = F.broadcast(hot.union(zero).groupBy(*keys).agg(F.max("_parts").alias("_parts")))
    number = F.monotonically_increasing_id()
    blank = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    part = F.when(blank, F.pmod(number, F.lit(HOT_KEYS))).otherwise(F.coalesce(F.pmod(number, "_parts"), F.lit(0)))
    dealt = many.join(hot, keys, "left").withColumn("_part", part.cast("int")).drop("_parts")
    copies = few.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies, [*keys, "_part"], how).drop("_part")


Batches = Iterator[pa.RecordBatch]


def thin(batches: Batches, rows: int = 512) -> Batches:
    """The same rows in smaller batches, where a row brings long texts or is passed on whole."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tidy(fn: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """fn, after which the worker gives back memory that Arrow and malloc keep for later.

    Spark reuses its Python workers, so what one stage leaves behind counts in the next.
    """

    def run(batches: Batches) -> Batches:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # no such call in this C library
            pass

    return run


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and hand it to `body` as a lambda variable.

    A plain nested Column would be inlined into the lambdas of higher-order
    functions and evaluated again for each array element.
    """
    return F.transform(F.array(value), body)[0]
