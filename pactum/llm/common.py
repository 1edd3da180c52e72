"""Helpers shared by the operators of this subpackage.

Conventions that hold for every operator here:

* the id and text columns are read by name; every other column of the input
  is ignored, or carried untouched inside one struct column ``row`` (so that
  an extra column can never clash with a result column);
* a NULL text is an empty text;
* Python code runs inside Spark tasks on Arrow batches and keeps no more than
  one bounded block of a batch in memory; freed memory goes back (``frugal``).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.session import scratch_path

#: Bytes of text handled at once by vectorised code; a longer text is a block of its own.
BLOCK_BYTES = 1 << 21
#: Bytes of text that ``map_rows`` hands on at once: its callers hold words as Python objects.
MAP_BYTES = 1 << 19
#: The same for words that numpy handles together by length: a small block has few of a length.
WORD_BYTES = 1 << 22
#: Bytes in an Arrow batch for Python (Spark's own bound is 64 MB): each task holds one in the
#: JVM's direct buffers, which grow by doubling, and one in its worker, and both keep that memory.
BATCH_BYTES = 4 << 20
BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of batches after which a worker gives back what it has freed, as it does at the end of a task.
GIVE_BACK_BYTES = 8 << 20
#: Bits of a filter that names rows to be looked at more closely (1 MiB, whatever the input).
FILTER_BITS = 1 << 23


def bound_batches(spark: SparkSession) -> bool:
    """From now on at most ``BATCH_BYTES`` in an Arrow batch, or one row, unless the session has
    a bound of its own: was it set here?  Spark reads it when a frame is run, not when it is made."""
    fresh = spark.conf.get(BYTES_KEY, None) is None
    if fresh:
        spark.conf.set(BYTES_KEY, str(BATCH_BYTES))
    return fresh


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """The same for what is run inside."""
    fresh = bound_batches(spark)
    try:
        yield
    finally:
        if fresh:
            spark.conf.unset(BYTES_KEY)


@cache
def _malloc_trim() -> Callable[[int], int] | None:
    """The C library's, where it has one (glibc)."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


def give_back() -> None:
    """Freed memory that Arrow's pool and the C library keep for later goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := _malloc_trim():
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
           ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, in a worker that gives freed memory back now and then, and at the
    end: Spark keeps workers for later tasks, and beside an executor's heap they would keep their most."""
    def paced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 0
        for batch in batches:
            size += batch.nbytes
            yield batch
            if size >= GIVE_BACK_BYTES:
                size = 0
                give_back()

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(paced(batches))
        finally:
            give_back()

    return wrapped


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back with its schema: cuts
    the lineage, and a lost executor costs only the tasks that read it."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("error").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these frames: only when everything
    that reads them has been written itself."""
    for df in frames:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_row(df: DataFrame, inputs: dict[str, Column], carry: bool) -> DataFrame:
    """Only the named input columns, plus every original column as struct ``row``."""
    cols = [c.alias(k) for k, c in inputs.items()]
    if carry:
        cols.append(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    return df.select(*cols)


def map_rows(df: DataFrame, inputs: dict[str, Column], fields: list[T.StructField],
             make: Callable[[], Callable[[pa.RecordBatch], dict]], carry: bool = False,
             limit: int = MAP_BYTES) -> DataFrame:
    """One result row per input row.

    ``make()`` is called once per task and returns a function from a batch of
    ``inputs`` to ``{field name: list or array}``.  Input columns whose name is
    also in ``fields`` are passed through.  With ``carry`` the result also has
    the struct ``row`` of all original columns.  ``limit``: bytes of text that
    the function gets at once (or one row).
    """
    src = with_row(df, inputs, carry)
    schema = T.StructType([*fields, *([T.StructField("row", src.schema["row"].dataType)] if carry else [])])
    names = [f.name for f in schema]
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in row_blocks(batch, limit=limit):
                got = step(part)
                yield pa.RecordBatch.from_arrays(
                    [as_arrow(got[n] if n in got else part.column(n), arrow.field(n).type if n != "row" else None)
                     for n in names], names=names)

    return src.mapInArrow(frugal(run), schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType([f for f in schema if f.name != "row"]))


def as_arrow(values, kind: pa.DataType | None) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if kind is None or values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def row_blocks(batch: pa.RecordBatch, col: str = "text", limit: int = BLOCK_BYTES * 4) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold at most ``limit`` bytes of text, or one row."""
    if col not in batch.schema.names or batch.num_rows == 0:
        if batch.num_rows:
            yield batch
        return
    sizes = text_offsets(batch.column(batch.schema.names.index(col)))[0]
    for a, b in spans(sizes, limit):
        yield batch.slice(a, b - a)


def spans(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive [a, b) over ``len(offsets) - 1`` items of at most ``limit`` each span, or one item."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = b


def text_offsets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a NULL is zero bytes long."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, kind)[col.offset: col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], buf[offsets[0]: offsets[-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (finaliser with fixed odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def likely_members(rows: DataFrame, key: Column, members: DataFrame, member: Column) -> Column:
    """Names a broadcast filter of fixed size (``FILTER_BITS`` / 64 rows) over
    ``member`` of ``members``; returns ``rows`` with a boolean ``_maybe``."""
    def spot(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))

    words = (members.select(spot(member).alias("s")).groupBy(F.shiftright("s", 6).alias("_w"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"),
                                           F.col("s").bitwiseAND(F.lit(63)).cast("int"))).alias("_m")))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), spot(key).bitwiseAND(F.lit(63)).cast("int"))
    return (rows.withColumn("_w", F.shiftright(spot(key), 6)).join(F.broadcast(words), "_w", "left")
            .withColumn("_maybe", F.coalesce(F.col("_m").bitwiseAND(bit) != 0, F.lit(False))).drop("_w", "_m"))
