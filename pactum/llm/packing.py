"""Best-fit packing by exact-complement hashing over the histogram of lengths.

Documents become pieces of at most ``capacity`` token ids.  Which piece goes
where depends on lengths only, so the plan is made from the histogram of
lengths (at most ``capacity`` numbers, whatever the corpus): it is a list of
patterns, each a multiset of lengths with a multiplicity.

A pattern starts with the longest length left.  Its gap is looked up in the
index of available lengths, of sums of two, and of sums of three; a combination
that fills the gap exactly closes the pattern.  If there is none, the longest
length that fits is added and the smaller gap is looked up again; when nothing
fits, the pattern stays with its residual gap (best fit).  A pattern is used as
often as the counts allow, so each one exhausts a length.

Pieces are numbered within their length (position inside the task that made
them, plus a running sum over tasks), and a table with one row per pattern and
length turns that number into sequence and offset.  No piece is shuffled for
it, and a length that a third of all pieces share is no group anywhere.

Defined results: a NULL or empty text is one piece with the end id only; equal
rows are packed each for itself; the id is passed through, NULL included; an
empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactum.llm.common import frugal, materialize, row_blocks
from pactum.llm.subwords import encoder

CAPACITY = 4096
END_ID = 1
#: The table of running sums (one row per task and length) is broadcast up to
#: this many rows, which are counted; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


class Stock:
    """How many pieces of each length are left, with lookups of exact sums."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.sums: np.ndarray | None = None

    def has(self, combination: list[int]) -> bool:
        return all(self.left[n] >= combination.count(n) for n in set(combination))

    def fill(self, gap: int) -> list[int] | None:
        """One, two or three lengths that sum up to ``gap``, all in stock."""
        if self.left[gap] > 0:
            return [gap]
        there = self.left > 0
        a = np.flatnonzero(there[1:gap] & there[gap - 1: 0: -1]) + 1
        for n in a[::-1][:2].tolist():  # only (n, n) can fail, for want of a second one
            if self.has([n, gap - n]):
                return [n, gap - n]
        if self.sums is None:  # which sums two lengths in stock can make
            size = 2 * len(there)
            f = np.fft.rfft(there.astype(np.float64), size)
            self.sums = np.fft.irfft(f * f, size) > 0.5
        a = np.flatnonzero(there[1:gap] & self.sums[gap - 1: 0: -1]) + 1
        for n in a[::-1].tolist():
            rest = gap - n
            b = np.flatnonzero(there[1:rest] & there[rest - 1: 0: -1]) + 1
            for m in b[::-1][:4].tolist():
                if self.has([n, m, rest - m]):
                    return [n, m, rest - m]
        return None

    def take(self, pattern: dict[int, int], times: int) -> None:
        for n, k in pattern.items():
            self.left[n] -= k * times
            if self.left[n] == 0:
                self.sums = None


def plan(counts: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: copies}, times) that use up ``counts`` (index 0 unused,
    last index = capacity)."""
    capacity = len(counts) - 1
    stock, out = Stock(counts), []
    for longest in range(capacity, 0, -1):
        while stock.left[longest] > 0:
            pattern, gap = {longest: 1}, capacity - longest
            stock.left[longest] -= 1
            held = [longest]
            while gap > 0:
                got = stock.fill(gap)
                if got is None:
                    fits = np.flatnonzero(stock.left[1: gap + 1]) + 1
                    if not len(fits):
                        break
                    # The longest that fits, but not so many that the last gap can't be looked up.
                    n = int(fits[-1])
                    got = [n] * max(1, min(int(stock.left[n]), gap // n) - 3)
                for n in got:
                    stock.left[n] -= 1
                    pattern[n] = pattern.get(n, 0) + 1
                    gap -= n
                held += got
            for n in held:  # put back, then take as often as it goes
                stock.left[n] += 1
            times = min(int(stock.left[n]) // k for n, k in pattern.items())
            stock.take(pattern, times)
            out.append((pattern, times))
    return out


def slots(patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """One row per pattern and length, sorted by (length, first): pieces number
    ``first ..`` of this length lie ``copies`` to a sequence from ``sequence`` on, at ``offset``."""
    rows, used, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for n, k in pattern.items():
            rows.append((n, used.get(n, 0), sequence, k, offset))
            used[n] = used.get(n, 0) + k * times
            offset += n * k
        sequence += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "copies", "offset"), cols.T))


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of the encoded documents, written once: doc_id, piece, start,
    length, ids (little-endian unsigned 32-bit), ids_crc32, and the piece's task and number in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        end = np.array([end_id], "<u4")
        seen = np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            for part in row_blocks(batch):
                out: list[list] = [[] for _ in range(7)]
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.concatenate([words.array(text or "").astype("<u4"), end])
                    for k, a in enumerate(range(0, len(ids), capacity)):
                        own = ids[a: a + capacity]
                        raw = own.tobytes()
                        for col, x in zip(out, (doc_id, k, a, len(own), raw, zlib.crc32(raw), int(seen[len(own)]))):
                            col.append(x)
                        seen[len(own)] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(
                        [*out, [task] * len(out[0])],
                        [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32()])],
                    names=["doc_id", "piece", "start", "length", "ids", "ids_crc32", "nth", "task"])

    made = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        frugal(run), "doc_id bigint, piece int, start bigint, length bigint, ids binary, ids_crc32 bigint, nth bigint, task int")
    return materialize(made, "pieces")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
         with_ids: bool = True) -> DataFrame:
    """Per piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, and ids unless ``with_ids`` is false."""
    stored = pieces(docs, path, capacity, end_id)
    per_task = stored.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = materialize(per_task.select("task", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")),
                       "piece-bases")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in base.groupBy("length").agg(F.sum("n")).collect():  # at most ``capacity`` rows
        counts[length] = n
    small = base.count() <= BROADCAST_ROWS
    base = base.drop("n")
    numbered = stored.join(F.broadcast(base) if small else base, ["task", "length"])
    return place(numbered.withColumn("rank", F.col("base") + F.col("nth")), slots(plan(counts)), with_ids)


def place(numbered: DataFrame, table: dict[str, np.ndarray], with_ids: bool) -> DataFrame:
    """Add sequence_id and offset to pieces by their number within their length
    (``rank``).  The slot table has one row per pattern and length."""
    kinds = {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint",
             **({"ids": "binary"} if with_ids else {})}
    shared = numbered.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        keys = t["length"] << 48 | t["first"]
        for batch in batches:
            rank, length = batch.column("rank").to_numpy(), batch.column("length").to_numpy()
            at = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            nth, copies = rank - t["first"][at], t["copies"][at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kinds], pa.array(t["sequence"][at] + nth // copies),
                 pa.array(t["offset"][at] + nth % copies * length)], names=[*kinds, "sequence_id", "offset"])

    return numbered.select(*kinds, "rank").mapInArrow(
        frugal(run), ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", sequence_id bigint, offset bigint")
