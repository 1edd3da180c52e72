"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersection.

Two documents link when 100 * |A and B| >= 75 * |A or B| over their sets of
five-word shingles.  No link is lost:

1. *Classes.*  Documents with the same set are one class (128-bit checksum).
2. *Keys.*  In any fixed order of all shingles, linked sets share a shingle
   among their first ``n - ceil(0.75 n) + 1``.  The order puts shingles that
   many texts hold last, so common passages don't make common keys.  Only the keys of
   classes are spread out, one row a class, and facts of a key (its least and
   greatest class) are partial aggregates joined back, never a window: a key of
   very many classes is split by the join.
3. *First links.*  Each class is paired with a centre of its key, which is linear
   in the keys; pairs that survive the size and the bitmap bound are verified, and
   connected components made of them.  First one centre serves all keys alike, then,
   for keys of several components, every key has one of its own.
4. *Tiles.*  What is left are pairs of one key in different components.  Keys with
   the same least class and three bands of set sizes (bands grow by 4/3, so
   partners lie in the same band or the next) make a tile, which is compared
   inside tasks, in chunks, under the size bound and the bitmap bound: only
   likely pairs leave a task.  Of keys that the same classes hold one is enough.
   A chunk with many likely pairs for its classes (pages of one template just below
   the threshold) gives its classes instead; it is compared exactly as a whole
   inside a task, and only a spanning forest of its links leaves that.
5. *Verification.*  Exact intersection of the two sorted shingle arrays, made
   again from the texts of the documents concerned.

Bitmap bound: each set is hashed to a bitmap of parities (a shingle flips its bit)
whose width fits its band.  Every bit in which two bitmaps differ is at least one
shingle that only one side has, so the overlap is at most
``(|A| + |B| - differing bits) / 2``.

Defined results: a NULL, empty or wordless text has an empty set and links
with nothing; rows without an id link with nothing and have a NULL component;
rows of one id are one document of the graph; repeated rows are one class; an
empty table gives an empty table; a very long text is hashed as a block of its
own, whole.  Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.llm.common import bounded_batches, frugal, likely_members, materialize, release, row_blocks, text_offsets
from pactum.llm.graph import components
from pactum.llm.shingles import BLOCK_BYTES, fingerprint, shingle_sets

#: A shingle is counted as frequent in a chunk of hashes from this many sets on.
FREQUENT = 4
CHUNK_HASHES = 4 << 20
#: Width of a bitmap for each shingle of the largest set of its band: the wider,
#: the fewer shingles of a difference hide behind others.
BITS_PER_SHINGLE = 1
#: Classes, and shingles of them, in a chunk of a tile; pairs whose bitmaps are compared at once.
TILE_ROWS = 1024
TILE_SHINGLES = 1 << 20
SURVIVOR_ROWS = 50_000
#: Likely pairs for each class of a chunk from which on the chunk is compared as a whole,
#: and the different shingles taken at once then.
DENSE = 4
DENSE_COLUMNS = 2048
#: Turns in which every key of several components has a centre of its own.
STAR_TURNS = 2
#: Most frequent shingles that are broadcast, 16 bytes each.  They only order
#: the keys: links don't depend on which shingles are among them.
MAX_FREQUENT = 1 << 20


def _bands() -> np.ndarray:
    """First set size of each band: 1, 2, 3, 5, 7, 10, .. (the next is just over 4/3 of the last)."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(4 * out[-1] // 3 + 1)
    return np.array(out, np.int64)


BANDS = _bands()


def bitmap(own: np.ndarray, band: int) -> np.ndarray:
    """The set hashed to ``BITS_PER_SHINGLE`` times the next power of two over the band's
    sizes; a bit tells whether an odd number of shingles fell on it."""
    width = max(64, BITS_PER_SHINGLE << int(BANDS[band + 1] - 1).bit_length())
    bits = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").view("<i8")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in row_blocks(batch, limit=BLOCK_BYTES):
            yield part, shingle_sets(*text_offsets(part.column("text")))


def frequent(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes sorted, counts) of those that stand in ``FREQUENT`` of the sets or more; takes the sets
    out of the list.  Beside the hashes, sorted in their place, only the frequent ones take memory."""
    hashes = np.concatenate(held)
    held.clear()
    hashes.sort()
    key = np.unique(hashes[FREQUENT - 1:][hashes[FREQUENT - 1:] == hashes[: max(len(hashes) - FREQUENT + 1, 0)]])
    return key, np.searchsorted(hashes, key, side="right") - np.searchsorted(hashes, key)


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes sorted, counts) of the shingles that many different sets hold, at
    most ``MAX_FREQUENT`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        size = 0

        def finish() -> pa.RecordBatch:
            key, n = frequent(held)
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

        for _, sets in _sets(batches):
            for own in sets:
                f = fingerprint(own)
                if f not in seen:
                    seen.add(f)
                    held.append(own)
                    size += len(own)
            if size >= CHUNK_HASHES:
                yield finish()
                held, size = [], 0
                seen.clear()
        if held:
            yield finish()

    got = (docs.select("text").mapInArrow(frugal(run), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "key").limit(MAX_FREQUENT).toArrow())
    key = got.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    return key[order], got.column("n").to_numpy()[order]


def signatures(docs: DataFrame) -> DataFrame:
    """Per row: doc_id (and any other long), n_shingles, two checksums of the set, its keys, band and bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, count = shared.value
        for part, sets in _sets(batches):
            rows = []
            for own in sets:
                n = len(own)
                if n == 0:
                    rows.append((0, 0, 0, 0, [], []))
                    continue
                size = n - (3 * n + 3) // 4 + 1
                keys = own[:size]
                if len(often):
                    at = np.minimum(np.searchsorted(often, own), len(often) - 1)
                    rank = np.where(often[at] == own, count[at], 0)
                    if rank.any():
                        keys = own[np.argsort(rank, kind="stable")[:size]]
                band = int(np.searchsorted(BANDS, n, side="right")) - 1
                rows.append((n, *fingerprint(own), band, keys.view(np.int64), bitmap(own, band)))
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 2]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in own_columns], *[pa.array(c, t) for c, t in zip(cols, kinds)]],
                names=[*own_columns, "n_shingles", "f1", "f2", "band", "keys", "bits"])

    own_columns = [c for c in docs.columns if c != "text"]
    return docs.mapInArrow(frugal(run), "".join(f"{c} bigint, " for c in own_columns) + "n_shingles bigint, f1 bigint, "
                                "f2 bigint, band int, keys array<bigint>, bits array<bigint>")


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows, words) narrowed to ``width`` words by halving."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def tile_survivors(rows: dict, chunk: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one tile that share a key, lie in different components, and pass
    the size and the bitmap bound, each pair once: (first, second) row numbers.
    ``rows``: id, n, c, band, chunk, bits (list of arrays), keys (list of arrays)."""
    same = chunk[0] == chunk[1]
    side = [np.flatnonzero(rows["chunk"] == k) for k in chunk]
    place = np.full(len(rows["id"]), -1)
    share = np.zeros((len(side[0]), len(side[1])), bool)
    key = np.concatenate(rows["keys"])
    owner = np.repeat(np.arange(len(rows["keys"])), [len(k) for k in rows["keys"]])
    order = np.argsort(key, kind="stable")
    owner, cuts = owner[order], np.flatnonzero(np.diff(key[order])) + 1
    for s in side:
        place[s] = np.arange(len(s))
    for own in np.split(owner, cuts):
        if len(own) > 1:
            x, y = own[rows["chunk"][own] == chunk[0]], own[rows["chunk"][own] == chunk[1]]
            share[np.ix_(place[x], place[y])] = True
    a, b = np.nonzero(share)
    a, b = side[0][a], side[1][b]
    n, c, band = rows["n"], rows["c"], rows["band"]
    go = (c[a] != c[b]) & (4 * n[a] >= 3 * n[b]) & (4 * n[b] >= 3 * n[a]) & (np.abs(band[a] - band[b]) <= 1)
    # Two sets of the tile's last band also meet in the next tile.
    go &= (band[a] != band[b]) | (band[a] != rows["tile"] * 2 + 2)
    if same:
        go &= a < b
    a, b = a[go], b[go]
    keep = np.zeros(len(a), bool)
    for x in np.unique(band):
        for y in (x - 1, x, x + 1):
            pick = np.flatnonzero((band[a] == x) & (band[b] == y))
            if not len(pick):
                continue
            members = [np.unique(m) for m in (a[pick], b[pick])]
            bits = [np.array([rows["bits"][i] for i in m.tolist()]) for m in members]
            width = min(bits[0].shape[1], bits[1].shape[1])
            bits = [fold(m, width).view(np.uint64) for m in bits]
            for k in range(0, len(pick), SURVIVOR_ROWS):
                p = pick[k: k + SURVIVOR_ROWS]
                diff = np.bitwise_count(bits[0][np.searchsorted(members[0], a[p])]
                                        ^ bits[1][np.searchsorted(members[1], b[p])]).sum(axis=1, dtype=np.int64)
                keep[p] = 7 * diff <= n[a[p]] + n[b[p]]
    return a[keep], b[keep]


def forest(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the links between ``left`` and ``right``, row numbers of ``sets``.
    Overlaps are counted exactly: products of the 0/1 table (set, shingle), some columns at a time."""
    ends = np.unique(np.concatenate([left, right]))
    size = np.array([len(sets[i]) for i in ends])
    all_, owner = np.concatenate([sets[i] for i in ends]), np.repeat(np.arange(len(ends)), size)
    value, column, held = np.unique(all_, return_inverse=True, return_counts=True)
    several = held[column] > 1
    column, owner = (np.cumsum(held > 1) - 1)[column[several]], owner[several]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    at_l, at_r = np.searchsorted(ends, left), np.searchsorted(ends, right)
    both = np.zeros((len(left), len(right)), np.int64)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, DENSE_COLUMNS):
        a, b = np.searchsorted(column, [k, k + DENSE_COLUMNS])
        table = np.zeros((len(ends), DENSE_COLUMNS), np.float32)
        table[owner[a:b], column[a:b] - k] = 1
        both += (table[at_l] @ table[at_r].T).astype(np.int64)
    link = np.zeros((len(ends), len(ends)), bool)
    link[np.ix_(at_l, at_r)] = 100 * both >= 75 * (size[at_l][:, None] + size[at_r][None, :] - both)
    link |= link.T
    fresh, edges = np.ones(len(ends), bool), []
    for root in range(len(ends)):
        if not fresh[root]:
            continue
        fresh[root], todo = False, [root]
        while todo:
            x = todo.pop()
            found = np.flatnonzero(link[x] & fresh)
            fresh[found] = False
            edges += [(int(ends[x]), int(ends[y])) for y in found]
            todo += found.tolist()
    return edges


def by_group(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of each group of consecutive rows that agree in the integer columns ``names``."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names], axis=1)
        cuts = np.concatenate([[0], 1 + np.flatnonzero((key[1:] != key[:-1]).any(axis=1)), [len(key)]])
        for x, y in zip(cuts[:-1], cuts[1:]):
            if y > x:
                now = tuple(key[x].tolist())
                if held and now != held_key:
                    yield held_key, pa.Table.from_batches(held)
                    held = []
                held_key = now
                held.append(batch.slice(x, y - x))
    if held:
        yield held_key, pa.Table.from_batches(held)


#: The group of a chunk, or pair of chunks, of a tile.
GROUP = ["lo", "tile", "i", "j"]


def tile_pairs(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, f1, c) -> likely pairs that share a key across components, and the rows of chunks
    with many of them, written: a, af, b, bf (pairs), lo, tile, i, j, chunk (NULL but for rows
    of such chunks, where a and af tell the class and b, bf are NULL).

    Lists with the same least class come together, so that a pair which shares
    many keys is met a few times only.  A tile is such a group and three bands
    of set sizes (2t, 2t + 1, 2t + 2); a class is one row of it, with its keys
    and its bitmap.  A tile of more than ``TILE_ROWS`` classes is cut into
    chunks, and each pair of chunks is a task's group of its own."""
    least = lists.groupBy("key").agg(F.min("f1").alias("lo"))
    grouped = lists.join(least, "key").groupBy("lo", "f1", "c").agg(F.collect_list("key").alias("keys"))
    tiled = materialize(grouped.join(classes.select("f1", "id", "n", "band"), "f1"), "jaccard-tiles")
    half = F.floor(F.col("band") / 2).cast("int")
    rows = tiled.withColumn("tile", F.explode(
        F.when(F.col("band") % 2 == 0, F.array(half, half - 1)).otherwise(F.array(half))))
    size = (rows.groupBy("lo", "tile").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).where("m > 1")
            .select("lo", "tile", F.greatest(F.ceil(F.col("m") / TILE_ROWS), F.least(
                "m", F.ceil(F.col("s") / TILE_SHINGLES))).cast("int").alias("of")))
    rows = (rows.join(size, ["lo", "tile"])
            .withColumn("chunk", F.pmod(F.xxhash64("f1"), F.col("of")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
            .withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other")))
    # The bitmaps join last: they are shuffled to their tiles once.
    rows = (rows.join(classes.select("f1", "id", "bits"), ["f1", "id"])
            .select(*GROUP, "f1", "id", "n", "c", "band", "chunk", "bits", "keys")
            .repartition(*GROUP).sortWithinPartitions(*GROUP))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, t in by_group(batches, GROUP):
            got = {k: t.column(k).to_numpy() for k in ("id", "n", "c", "band", "chunk")}
            got |= {k: [x.values.to_numpy() for x in t.column(k)] for k in ("bits", "keys")}
            a, b = tile_survivors(got | {"tile": group[1]}, group[2:])
            f1 = t.column("f1").to_numpy()
            if len(a) > DENSE * len(f1):
                m = len(f1)
                some = [pa.array(got["id"]), pa.array(f1), *[pa.nulls(m, pa.int64())] * 2,
                        *[pa.array(np.full(m, g)) for g in group], pa.array(got["chunk"].astype(np.int64))]
            else:
                some = [*[pa.array(x) for x in (got["id"][a], f1[a], got["id"][b], f1[b])],
                        *[pa.nulls(len(a), pa.int64())] * 5]
            yield pa.RecordBatch.from_arrays(some, names=["a", "af", "b", "bf", *GROUP, "chunk"])

    found = rows.mapInArrow(frugal(run), "a bigint, af bigint, b bigint, bf bigint, lo bigint, tile bigint, i bigint, j bigint, "
                                 "chunk bigint")
    # The same pair from two groups may come in either order.
    swap = F.col("af") > F.col("bf")
    found = found.select(
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("bf")).otherwise(F.col("af")).alias("af"),
        F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), F.when(swap, F.col("af")).otherwise(F.col("bf")).alias("bf"),
        *GROUP, "chunk")
    pairs = materialize(found.distinct(), "jaccard-pairs")
    release(tiled)
    return pairs


def dense_links(chunks: DataFrame, own: DataFrame) -> DataFrame:
    """A spanning forest (a, b) of the links within each chunk, or pair of chunks, of
    ``chunks`` (lo, tile, i, j, chunk, id, f); ``own``: id, f, and the sorted set."""
    rows = (chunks.join(own, ["id", "f"]).select(*GROUP, "chunk", "f", "own").repartition(*GROUP)
            .sortWithinPartitions(*GROUP, "f"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, t in by_group(batches, GROUP):
            f, chunk = t.column("f").to_numpy(), t.column("chunk").to_numpy()
            first = np.concatenate([[True], f[1:] != f[:-1]])  # a class may stand on several rows of its document
            f, chunk = f[first], chunk[first]
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x, go in zip(t.column("own"), first) if go]
            edges = forest(sets, np.flatnonzero(chunk == group[2]), np.flatnonzero(chunk == group[3]))
            yield pa.RecordBatch.from_arrays([pa.array([f[x] for x, _ in edges], pa.int64()),
                                              pa.array([f[y] for _, y in edges], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(frugal(run), "a bigint, b bigint")


def differing(a: Column, b: Column) -> Column:
    """Number of bits in which two bitmaps differ; the wider one is folded to
    the width of the other (widths of neighbouring bands differ by 2 at most)."""
    def fold(x: Column, y: Column) -> Column:
        half = F.size(y)
        return F.when(F.size(x) > half, F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half),
                                                   lambda p, q: p.bitwiseXOR(q))).otherwise(x)
    return F.aggregate(F.zip_with(fold(a, b), fold(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                       F.lit(0), lambda s, x: s + x)


def likely(a: str, b: str) -> Column:
    """Size and bitmap bound for columns of two sets in the same or neighbouring bands."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return ((4 * na >= 3 * nb) & (4 * nb >= 3 * na) & (F.abs(F.col(f"{a}.band") - F.col(f"{b}.band")) <= 1)
            & (7 * differing(F.col(f"{a}.bits"), F.col(f"{b}.bits")) <= na + nb))


def one_key_per_list(keys: DataFrame) -> DataFrame:
    """Keys that the same classes hold give the same pairs: the rows of one key
    of each such list (told by count, ends and two sums of hashes)."""
    h = F.xxhash64("f1")
    lists = keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"), F.min("f1").alias("lo"), F.max("f1").alias("hi"),
        F.sum(F.shiftright(h, 32)).alias("s"), F.sum(h.bitwiseAND(F.lit(0x7FFFFFFF))).alias("t"))
    chosen = lists.groupBy("m", "lo", "hi", "s", "t").agg(F.min("key").alias("key")).select("key")
    return keys.join(chosen, "key", "left_semi")


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, af, b, bf: class document and checksum) that link, and links that
    connect the linked classes of dense chunks (see ``tile_pairs``), as checksums (a, b), written."""
    ends = pairs.select(F.col("a").alias("id")).union(pairs.where("b IS NOT NULL").select("b"))
    texts = likely_members(docs.where("doc_id IS NOT NULL"), F.col("doc_id"), ends, F.col("id")).where("_maybe")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([fingerprint(s)[0] for s in sets], pa.int64()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "f", "own"])

    own = materialize(texts.select("doc_id", "text").mapInArrow(frugal(arrays), "id bigint, f bigint, own binary"), "jaccard-sets")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("xa"), batch.column("xb"))):
                x = np.frombuffer(x.as_buffer(), np.uint64)
                y = np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                hit[i] = 100 * both >= 75 * (len(x) + len(y) - both)
            yield batch.filter(pa.array(hit)).select(["af", "bf"]).rename_columns(["a", "b"])

    left = own.select(F.col("id").alias("a"), F.col("f").alias("af"), F.col("own").alias("xa"))
    right = own.select(F.col("id").alias("b"), F.col("f").alias("bf"), F.col("own").alias("xb"))
    alone = pairs.where("b IS NOT NULL").select("a", "af", "b", "bf")
    both = alone.join(right, ["b", "bf"]).join(left, ["a", "af"]).select("af", "bf", "xa", "xb")
    found = both.mapInArrow(frugal(exact), "a bigint, b bigint")
    if "chunk" in pairs.columns:
        dense = pairs.where("chunk IS NOT NULL").select(*GROUP, "chunk", F.col("a").alias("id"), F.col("af").alias("f"))
        found = found.union(dense_links(dense, own))
    links = materialize(found, "jaccard-links")
    release(own)
    return links


def _linked_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``_connect`` in batches of bounded size: a pair of sets is large, and all of it runs here."""
    with bounded_batches(docs.sparkSession):
        return _connect(docs)


def _connect(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Checksums of the rows' sets, the classes, links (a, b) between classes, told by
    f1, that connect all linked ones, and the components (id, component_id) of them."""
    signed = materialize(signatures(docs), "jaccard-signatures")
    linked = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    whole = materialize(
        linked.groupBy("f1", "f2", F.col("n_shingles").alias("n"))
        .agg(F.min("doc_id").alias("id"), F.first("band").alias("band"), F.first("bits").alias("bits"),
             F.first("keys").alias("keys")), "jaccard-whole")
    rows = materialize(signed.drop("band", "keys", "bits"), "jaccard-rows")
    release(signed)
    classes = materialize(whole.drop("keys"), "jaccard-classes")
    spread = whole.select(F.explode("keys").alias("key"), "f1", "n")
    shared = materialize(
        spread.groupBy("key").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi")).where("lo < hi").select("key", "lo"),
        "jaccard-shared")
    keys = materialize(likely_members(spread, F.col("key"), shared, F.col("key")).where("_maybe").drop("_maybe")
                       .join(shared, "key"), "jaccard-keys")
    release(whole, shared)
    near = (4 * F.col("n") >= 3 * F.col("zn")) & (4 * F.col("zn") >= 3 * F.col("n"))

    def sides(pairs: DataFrame) -> DataFrame:
        """(lo, f1) checksum pairs -> likely pairs of classes."""
        x = pairs.join(classes.select("f1", F.struct("id", "f1", "n", "band", "bits").alias("p")), "f1")
        y = x.join(classes.select(F.col("f1").alias("lo"), F.struct("id", "f1", "n", "band", "bits").alias("q")), "lo")
        return y.where(likely("p", "q")).select(
            F.col("q.id").alias("a"), F.col("q.f1").alias("af"), F.col("p.id").alias("b"), F.col("p.f1").alias("bf"))

    def mixed(rows: DataFrame, found: DataFrame) -> DataFrame:
        """(key, f1, n, c) of the keys whose classes lie in different components ``c``."""
        of_class = found.select(F.col("id").alias("f1"), F.col("component_id").alias("c"))
        told = rows.select("key", "f1", "n").join(of_class, "f1", "left").withColumn("c", F.coalesce("c", "f1"))
        several = told.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
        return told.join(several, "key", "left_semi").select("key", "f1", "n", "c")

    def join_up(links: DataFrame | None, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        more = verify(docs, pairs)
        release(pairs)
        links = more if links is None else links.union(more)
        return links, materialize(components(links), "jaccard-components")

    # One centre for all keys first: the class with the least checksum of the key.
    first = (keys.where("f1 != lo").select("lo", "f1", "n").distinct()
             .join(classes.select(F.col("f1").alias("lo"), F.col("n").alias("zn")), "lo").where(near))
    first = materialize(sides(first.select("lo", "f1")), "jaccard-pairs")
    links, found = join_up(None, first)
    # Then another centre for every key: a class meets about as many members of a
    # group as it has keys, so few groups are left in pieces.
    several = materialize(mixed(keys, found), "jaccard-mixed")
    release(keys)
    lists = materialize(one_key_per_list(several), "jaccard-lists")
    release(several)
    for turn in range(STAR_TURNS):
        centre = lists.groupBy("key").agg(F.min(F.struct(
            F.xxhash64("f1", "key", F.lit(turn)), F.col("f1").alias("lo"), F.col("c").alias("zc"), F.col("n").alias("zn"))).alias("z"))
        stars = (lists.join(centre.select("key", "z.lo", "z.zc", "z.zn"), "key")
                 .where((F.col("zc") != F.col("c")) & near).select("lo", "f1").distinct())
        pairs = materialize(sides(stars), "jaccard-pairs")
        if pairs.isEmpty():
            release(pairs)
            break
        links, found = join_up(links, pairs)
        left = materialize(mixed(lists, found), "jaccard-lists")
        release(lists)
        lists = left
    # Last, every pair of one key that is still in different components.
    third = tile_pairs(lists, classes)
    if third.isEmpty():
        release(third)
    else:
        links, found = join_up(links, third)

    release(lists)
    return rows, classes, links, found


def _by_row(signed: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """The rows with ``root``, the number of their component of classes, and its smallest id."""
    root = found.select(F.col("id").alias("f1"), F.col("component_id").alias("root")).join(classes.select("f1", "id"), "f1")
    least = root.groupBy("root").agg(F.min("id").alias("least"))
    class_of = (classes.select("f1", "f2", F.col("n").alias("n_shingles"), "id")
                .join(root.select("f1", "root").join(least, "root"), "f1", "left")
                .select("f1", "f2", "n_shingles", F.coalesce("root", "f1").alias("root"),
                        F.coalesce("least", "id").alias("class_component")))
    out = signed.join(class_of, ["f1", "f2", "n_shingles"], "left")
    return out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.when(
        F.col("doc_id").isNotNull(), F.col("class_component"))).otherwise(F.col("doc_id")))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed, classes, links, found = _linked_classes(docs)
    # An id on several rows is one document: its rows share the smallest component.
    several = materialize(classes.groupBy("id").agg(F.min("f1").alias("a"), F.count(F.lit(1)).alias("m"))
                          .where("m > 1").select("id", "a"), "jaccard-same-id")
    if not several.isEmpty():
        found = materialize(components(links.union(
            classes.join(several, "id").select("a", F.col("f1").alias("b")))), "jaccard-components")
    return _by_row(signed, classes, found).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) without near-duplicates:
    of each component the text with the smallest id stays, once; if that id has
    several texts of the component, the one with the least hash.  A row is judged
    by its own text: other texts of its id stay or go by themselves.  Rows of one
    id and text are one; rows without an id stay."""
    doc_id, th = F.col("doc_id").cast("bigint"), F.xxhash64(F.coalesce("text", F.lit("")))
    signed, classes, _, links = _linked_classes(docs.select(doc_id.alias("doc_id"), "text", th.alias("th")))
    found = materialize(_by_row(signed, classes, links).where("doc_id IS NOT NULL").select(
        "doc_id", "th", "component_id", F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("th")).alias("root")),
        "jaccard-kept")
    gone = found.where("component_id < doc_id").select("doc_id", "th", F.lit(False).alias("stays"))
    left = found.where("component_id = doc_id")
    twice = left.groupBy("doc_id", "root").agg(F.min("th").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    concerned = materialize(gone.union(left.join(twice, ["doc_id", "root"]).select(
        "doc_id", "th", F.col("th") == F.col("first"))).distinct(), "jaccard-gone")
    rows = docs.select(doc_id.alias("id"), th.alias("th"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # Only rows that the fixed-size filter names are shuffled to meet the list.
    rows = likely_members(rows, F.xxhash64("id", "th"), concerned, F.xxhash64("doc_id", "th"))
    named = rows.where("_maybe").join(concerned.withColumnRenamed("doc_id", "id"), ["id", "th"], "left")
    clear = rows.where("NOT _maybe").select("row").union(named.where("stays IS NULL").select("row"))
    single = named.where("stays").groupBy("id", "th").agg(F.first("row").alias("row")).select("row")
    return clear.union(single).select("row.*")
