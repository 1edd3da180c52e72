"""Suffix-array dedup: remove every byte that a repeated 100-byte string covers.

A 100-byte string that also starts earlier (smaller id, or same document and
earlier) is a repeat; all bytes that repeats cover are removed.  Matches are
judged on the input and don't cross documents.  A whole-corpus suffix array
would move eight bytes for each byte of text; instead:

1. *Copies.*  Documents of the same text are one text, kept by its smallest id.
2. *Suffix buckets.*  The bucket of a 100-byte string is its anchor: the 32-byte
   gram with the least hash inside it.  Equal strings have equal anchors, and an
   anchor serves about 35 starts in a row, so one number in 35 is shuffled.
   Anchors that occur once end here.
3. *Contexts.*  For the others, the bytes around the anchor are taken from the
   text.  Of equal contexts the first one stays; the rest are repeats as a whole.
4. *Blockwise suffix sort.*  Contexts that share an anchor and differ are sorted
   by :mod:`pactum.llm.cover_sort`, one range of buckets at a time, long ties
   by the ranks of the difference-cover sample.
5. *Removal.*  Runs of repeats become byte spans; only texts with spans are read
   again and cut.

An anchor with more than ``HOT_CONTEXTS`` different contexts is not given to one
task: its strings are spread by their own hash and the first of each is found
with a window over that string.

Defined results: a NULL or empty text has no bytes; a text of fewer than 100
bytes is never touched; rows with the same id and text are one document and get
the same result; rows without an id come last; an empty table gives an empty
table.  Cut texts lose the remains of a character that a span cuts in two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.llm.common import frugal, likely_members, materialize, mix64, row_blocks, text_offsets
from pactum.llm.cover_sort import repeats
from pactum.llm.shingles import _BACK, _STEP, _powers, _tables

LENGTH = 100
GRAM = 32
#: Bytes of text hashed at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19
#: Bytes of contexts sorted at once, about.
SORT_BYTES = 2 << 20
#: Different contexts of one anchor that one task may sort.
HOT_CONTEXTS = 10_000
_NO_ID = (1 << 63) - 1
_BYTE = np.random.default_rng(20240301).integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each position on."""
    n = len(buf)
    power, back = _tables(BLOCK_BYTES) if n <= BLOCK_BYTES else (_powers(_STEP, n), _powers(_BACK, n))
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[buf] * power[:n])])
    return mix64((total[GRAM:] - total[:-GRAM]) * back[: n - GRAM + 1])


def anchors(offsets: np.ndarray, buf: np.ndarray, length: int = LENGTH) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each text: (anchor hashes, first start, last start) of the runs of
    starts that share an anchor, in order."""
    none = np.zeros(0, np.int64)
    empty = (np.zeros(0, np.uint64), none, none)
    if len(buf) < length:
        return [empty] * (len(offsets) - 1)
    h = gram_hashes(buf)
    bits = np.uint64(int(len(h)).bit_length())
    low = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)  # ties: the leftmost
    span, have = length - GRAM + 1, 1
    while 2 * have <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have:])
    where = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    change = np.flatnonzero(where[1:] != where[:-1]) + 1
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        last = b - length
        if last < a:
            out.append(empty)
            continue
        inner = change[np.searchsorted(change, a, side="right"): np.searchsorted(change, last, side="right")]
        first = np.concatenate([[a], inner])
        out.append((h[where[first]], first - a, np.concatenate([inner - 1, [last]]) - a))
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in row_blocks(batch, limit=BLOCK_BYTES):
            yield part, *text_offsets(part.column("text"))


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(id, th, text, runs) -> the contexts of the named runs.  Inside a batch
    equal contexts are one: the later ones leave as repeats at once."""
    for part, offsets, buf in _texts(batches):
        first: dict[tuple[int, bytes], tuple] = {}
        rows = []
        runs = part.column("runs")
        for i, (own, (key, lo, hi)) in enumerate(zip(
                zip(part.column("id").to_pylist(), part.column("th").to_pylist()), anchors(offsets, buf, length))):
            text = buf[offsets[i]: offsets[i + 1]].tobytes()
            for k in sorted(set(runs[i].as_py())):
                a, b = int(lo[k]), int(hi[k])
                ctx = text[a: b + length]
                name, now = (int(key[k].view(np.int64)), ctx), (*own, a, b)
                old = first.get(name)
                if old is None or now[:3] < old[:3]:
                    first[name] = now
                    now = old
                if now is not None and now[:3] != first[name][:3]:
                    rows.append((None, *now, None))
        rows += [(key, *at, ctx) for (key, ctx), at in first.items()]
        if rows:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                             names=["key", "id", "th", "lo", "hi", "ctx"])


def _sorted_repeats(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by key -> runs of repeated starts.  Whole keys are taken
    together, up to about ``SORT_BYTES`` of contexts at a time."""
    held: list[tuple] = []
    size = 0

    def finish() -> pa.RecordBatch | None:
        rows = sorted(set(held), key=lambda r: r[1:4])  # position in the text = order of occurrence
        text = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        n = np.array([len(r[5]) for r in rows])
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        count = n - length + 1
        row = np.repeat(np.arange(len(rows)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        late = np.flatnonzero(repeats(text, begin[row] + nth, length))
        if not len(late):
            return None
        cut = np.flatnonzero((np.diff(late) != 1) | (np.diff(row[late]) != 0)) + 1
        a, b = late[np.concatenate([[0], cut])], late[np.concatenate([cut - 1, [len(late) - 1]])]
        which = [rows[i] for i in row[a].tolist()]
        base = np.array([r[3] for r in which])
        return pa.RecordBatch.from_arrays(
            [pa.array([r[1] for r in which], pa.int64()), pa.array([r[2] for r in which], pa.int64()),
             pa.array(base + nth[a]), pa.array(base + nth[b])], names=["id", "th", "lo", "hi"])

    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "th", "lo", "hi", "ctx"))):
            if held and size >= SORT_BYTES and r[0] != held[-1][0]:
                got = finish()
                if got is not None:
                    yield got
                held, size = [], 0
            held.append(r)
            size += len(r[5])
    if held:
        got = finish()
        if got is not None:
            yield got


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds id (no id: the largest number) and th (hash of the text)."""
    return docs.select("*", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("id"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))


def repeated_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, th, lo, hi): runs of starts of repeated strings, in texts that are
    not copies of another; ``docs`` as from ``_keyed`` (id, th, text)."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs whose anchor occurs again in the block are surely shared: of
        them only the first is counted, so a frequent anchor stays a few rows."""
        for part, offsets, buf in _texts(batches):
            th = part.column("th").to_numpy()
            got = anchors(offsets, buf, length)
            once = np.sort(np.unique(th, return_index=True)[1])
            key = np.concatenate([got[i][0] for i in once])
            size = np.array([len(got[i][0]) for i in once])
            run = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
            _, first, inverse, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            again = n[inverse] > 1
            count = ~again
            count[first] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(th[once], size)), pa.array(run.astype(np.int32)), pa.array(key.view(np.int64)),
                 pa.array(again), pa.array(count)], names=["th", "run", "key", "again", "counted"])

    long = docs.where(F.octet_length("text") >= length)
    rows = long.select("th", "text").mapInArrow(frugal(keys), "th bigint, run int, key bigint, again boolean, counted boolean")
    # Rows that needn't be counted are spread by a salt.
    window = "OVER (PARTITION BY key, salt)"
    shared = (rows.selectExpr("th", "run", "key", "again", "CASE WHEN counted THEN 0 ELSE xxhash64(th, run) END AS salt")
              .selectExpr("th", "run", "again", f"min(th) {window} AS a", f"max(th) {window} AS b",
                          f"min(run) {window} AS c", f"max(run) {window} AS d")
              .where("again OR a < b OR c < d").groupBy("th").agg(F.collect_set("run").alias("runs")))
    firsts = long.groupBy("th").agg(F.min("id").alias("id"))
    wanted = materialize(shared.join(firsts, "th"), "suffix-runs")
    texts = likely_members(long.select("id", "th", "text"), F.col("th"), wanted, F.col("th")).where("_maybe")
    ctx = materialize(texts.select("id", "th", "text").join(wanted, ["id", "th"])
                      .mapInArrow(frugal(lambda it: _contexts(it, length)),
                                  "key bigint, id bigint, th bigint, lo bigint, hi bigint, ctx binary"), "suffix-contexts")
    at_once = ctx.where("ctx IS NULL").select("id", "th", "lo", "hi")
    ranked = (ctx.where("ctx IS NOT NULL")
              .selectExpr("*", "dense_rank() OVER (PARTITION BY key, ctx ORDER BY id, th, lo) AS nth"))
    later = ranked.where("nth > 1").select("id", "th", "lo", "hi")
    different = ranked.where("nth = 1").drop("nth").selectExpr("*", "count(1) OVER (PARTITION BY key) AS n")
    different = materialize(different.where("n > 1"), "suffix-buckets")
    sortable = (different.where(F.col("n") <= HOT_CONTEXTS).drop("n")
                .repartition("key").sortWithinPartitions("key"))
    found = sortable.mapInArrow(frugal(lambda it: _sorted_repeats(it, length)), "id bigint, th bigint, lo bigint, hi bigint")
    hot = (different.where(F.col("n") > HOT_CONTEXTS)
           .select("id", "th", "lo", "ctx", F.explode(F.sequence(F.lit(0), (F.col("hi") - F.col("lo")).cast("int"))).alias("o"))
           .selectExpr("id", "th", "lo + o AS lo", f"substring(ctx, o + 1, {length}) AS w")
           .selectExpr("id", "th", "lo", "lo AS hi", "dense_rank() OVER (PARTITION BY w ORDER BY id, th, lo) AS nth"))
    return (at_once.unionByName(later).unionByName(found)
            .unionByName(hot.where("nth > 1").drop("nth")))


def merge(lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of starts -> maximal byte spans [start, end)."""
    order = np.argsort(lo, kind="stable")
    start, end = lo[order], np.maximum.accumulate(hi[order] + length)
    new = np.concatenate([[True], start[1:] > end[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])
    return start[new], end[last]


def kept_bytes(text: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    return b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(text)]))


def _with_runs(keyed: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``keyed`` (id, th, text and others) that have no repeated string for sure, and
    the others with their runs and whether they are copies of an earlier text."""
    runs = repeated_runs(keyed.select("text", "id", "th"), length)
    spans = materialize(runs.groupBy("id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("runs")), "suffix-spans")
    firsts = keyed.groupBy("th").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"),
                                     F.max("id").alias("last")).where("first < last").select("th", "first")
    firsts = materialize(firsts, "suffix-firsts")
    # Texts without spans and without copies are done where they are read.
    some = spans.select("th").union(firsts.select("th"))
    marked = likely_members(keyed, F.col("th"), some, F.col("th"))
    joined = (marked.where("_maybe").drop("_maybe").join(spans, ["id", "th"], "left").join(firsts, "th", "left")
              .withColumn("copy", F.coalesce(F.col("id") > F.col("first"), F.lit(False))))
    return marked.where("NOT _maybe").drop("_maybe"), joined


def _cut(text: bytes, copy: bool, found: pa.Scalar, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The spans to remove from one text."""
    if copy and len(text) >= length:
        return np.zeros(1, np.int64), np.array([len(text)])
    if found.is_valid and len(found):
        v = found.values
        return merge(v.field("lo").to_numpy(), v.field("hi").to_numpy(), length)
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, spans (array of start and end byte), kept_text."""
    keyed = _keyed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")))
    alone, joined = _with_runs(keyed, length)
    alone = alone.select("doc_id", "text", F.lit(None).cast(joined.schema["runs"].dataType).alias("runs"),
                         F.lit(False).alias("copy"))
    both = alone.unionByName(joined.select(*alone.columns))
    schema = ("doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
              "spans array<struct<start: bigint, end: bigint>>, kept_text string")
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_blocks(batch):
                rows = []
                offsets, buf = text_offsets(part.column("text"))
                copies = part.column("copy").to_pylist()
                for i, found in enumerate(part.column("runs")):
                    text = buf[offsets[i]: offsets[i + 1]].tobytes()
                    start, end = _cut(text, copies[i], found, length)
                    kept = kept_bytes(text, start, end)
                    rows.append((len(text), len(text) - len(kept), len(start), hashlib.sha256(kept).hexdigest(),
                                 [{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist())],
                                 kept.decode("utf-8", "ignore")))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span_type, pa.string()]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], names=["doc_id", *names])

    return both.mapInArrow(frugal(cut), schema)


def cut_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of ``docs`` with their texts cut, and a last column of removed bytes; a text that is nothing
    but repeats goes with its row.  Rows without repeats stay as they are and never leave the JVM; of the
    others, the text travels once and the rest of the row beside it."""
    others = [c for c in docs.columns if c != "text"]
    keyed = _keyed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"),
                               F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("row")))
    alone, joined = _with_runs(keyed, length)
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType()), keyed.schema["row"]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_blocks(batch):
                texts, removed, stays = [], [], []
                copies = part.column("copy").to_pylist()
                for text, copy, found in zip(part.column("text"), copies, part.column("runs")):
                    old = (text.as_py() or "").encode()
                    start, end = _cut(old, copy, found, length)
                    kept = kept_bytes(old, start, end) if len(start) else old
                    removed.append(len(old) - len(kept))
                    texts.append(kept.decode("utf-8", "ignore") if len(start) else text.as_py())
                    stays.append(removed[-1] == 0 or len(kept) > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(texts, pa.string()), pa.array(removed, pa.int64()), part.column("row")],
                    names=["text", "n_removed", "row"]).filter(pa.array(stays))

    rows = joined.select("text", "runs", "copy", "row").mapInArrow(frugal(cut), schema).unionByName(
        alone.select("text", F.lit(0).cast("bigint").alias("n_removed"), "row"))
    return rows.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns],
                       F.col("n_removed").alias("removed" + "_" * max(map(len, docs.columns))))  # no column's name
