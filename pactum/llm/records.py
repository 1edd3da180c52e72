"""Token ids as length-delimited binary records with a separate offset index.

A shard is two files.  ``<shard>.rec`` holds framed records one after another:

    uint64  payload length          (all little-endian)
    uint32  masked checksum of the eight length bytes
    payload
    uint32  masked checksum of the payload

The payload is one serialized sequence: int64 document id, uint16 flags (1: the
document has an id), uint16 bytes per token id (2 or 4), then the token ids.
``<shard>.idx`` holds the uint64 start of each record, and the end of the file:
a shuffled reader fetches record i with two lookups and one ranged read.

A checksum is a CRC-32 masked by rotation and a constant, so that a checksum
stored inside checksummed data does not weaken it.

Documents are range-partitioned on (id, text hash) and sorted, so shards follow
each other in ascending id order.  Each task streams to files of its own
attempt and returns one manifest row; the manifest is what Spark commits, so a
lost or repeated attempt leaves at most files that no manifest names.

Defined results: a NULL or empty text is one record with the end id only; a
NULL id is kept, sorts first and is flagged; rows of one id follow each other
by text hash; an empty table makes no record.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactum.llm.common import materialize
from pactum.llm.subwords import encoder
from pactum.session import scratch_path

END_ID = 1
#: Fixed values of the file format.
MASK_DELTA = 0xA282EAD8
HEADER = struct.Struct("<qHH")
FRAME = struct.Struct("<QI")
#: Bytes written or read at once, about.
CHUNK_BYTES = 4 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def unframe(record: bytes) -> bytes:
    """The payload of one record; raises when a checksum or the length is wrong."""
    if len(record) < 16:
        raise ValueError("record is cut off")
    size, check = FRAME.unpack_from(record)
    if check != masked(record[:8]) or size + 16 != len(record):
        raise ValueError("record length is damaged")
    payload = record[12: 12 + size]
    if struct.unpack_from("<I", record, 12 + size)[0] != masked(payload):
        raise ValueError("record payload is damaged")
    return payload


def serialize(doc_id: int | None, ids: np.ndarray) -> bytes:
    return HEADER.pack(doc_id or 0, int(doc_id is not None), ids.dtype.itemsize) + ids.tobytes()


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags, width = HEADER.unpack_from(payload)
    return (doc_id if flags & 1 else None), np.frombuffer(payload, f"<u{width}", offset=HEADER.size)


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The store of a qualified path (file, HDFS, object store) and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pa.fs.FileSystem.from_uri(path)


def qualified(spark: SparkSession, path: str) -> str:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(jpath).toString()


MANIFEST = "shard int, file string, n_records bigint, n_bytes bigint, n_tokens bigint"


def write_records(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = END_ID,
                  shards: int | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write the shards under ``path`` (a new
    scratch folder by default).  Returns the manifest: one row per shard."""
    spark = docs.sparkSession
    root = qualified(spark, path or scratch_path(spark, "records"))
    fs, inner = file_system(root)
    fs.create_dir(inner, recursive=True)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = keyed.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        name = f"part-{shard:06d}-{uuid.uuid4().hex}"
        store, folder = file_system(root)
        words, at, tokens, starts = None, 0, 0, [0]
        out, held, size = None, [], 0
        for batch in batches:
            if words is None:
                words = encoder(tokenizer)
                end = np.array([end_id], words.kind)
                out = store.open_output_stream(f"{folder}/{name}.rec")
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.concatenate([words.array(text.as_py() or ""), end])
                record = frame(serialize(doc_id, ids))
                held.append(record)
                size += len(record)
                tokens += len(ids)
                at += len(record)
                starts.append(at)
                if size >= CHUNK_BYTES:
                    out.write(b"".join(held))
                    held, size = [], 0
        if words is not None:
            out.write(b"".join(held))
            out.close()
            with store.open_output_stream(f"{folder}/{name}.idx") as index:
                index.write(np.array(starts, "<u8").tobytes())
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard, "file": f"{root}/{name}", "n_records": len(starts) - 1, "n_bytes": at, "n_tokens": tokens}],
                schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_records", pa.int64()),
                                  ("n_bytes", pa.int64()), ("n_tokens", pa.int64())]))

    return materialize(ordered.mapInArrow(run, MANIFEST), "records-manifest")


def offsets(file: str) -> np.ndarray:
    """Record starts of one shard, and the end of the file."""
    store, inner = file_system(f"{file}.idx")
    with store.open_input_stream(inner) as f:
        return np.frombuffer(f.read(), "<u8").astype(np.int64)


def read_one(file: str, starts: np.ndarray, i: int) -> tuple[int | None, np.ndarray]:
    """Record ``i`` of a shard, by its offset alone."""
    store, inner = file_system(f"{file}.rec")
    with store.open_input_file(inner) as f:
        return parse(unframe(f.read_at(int(starts[i + 1] - starts[i]), int(starts[i]))))


def read_records(manifest: DataFrame) -> DataFrame:
    """Every record of the shards in ``manifest``, checked: shard, record, doc_id,
    start (ids in all records before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    shards = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                starts, base = offsets(row["file"]), row["base"]
                store, inner = file_system(row["file"] + ".rec")
                with store.open_input_file(inner) as f:
                    a = 0
                    while a < len(starts) - 1:
                        b = max(a + 1, int(np.searchsorted(starts, starts[a] + CHUNK_BYTES, side="right")) - 1)
                        raw = f.read_at(int(starts[b] - starts[a]), int(starts[a]))
                        cols: list[list] = [[], [], [], []]
                        for x, y in zip((starts[a:b] - starts[a]).tolist(), (starts[a + 1: b + 1] - starts[a]).tolist()):
                            doc_id, ids = parse(unframe(raw[x:y]))
                            for col, value in zip(cols, (doc_id, base, len(ids), ids.astype("<u4").tobytes())):
                                col.append(value)
                            base += len(ids)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row["shard"]] * (b - a), pa.int32()), pa.array(range(a, b), pa.int64()),
                             *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]],
                            names=["shard", "record", "doc_id", "start", "n_tokens", "ids"])
                        a = b

    return shards.select("shard", "file", "base").repartition(n).mapInArrow(
        run, "shard int, record bigint, doc_id bigint, start bigint, n_tokens bigint, ids binary")
