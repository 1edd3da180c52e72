"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, exact rerank.

1. *Learn* (bounded sample): alternate between binary codes of the unit vectors
   and the orthogonal rotation that fits them best (Procrustes).  One rotation
   gives ``dim`` bits; several starts give several.  The vectors aren't centred:
   the angle between two vectors, which the threshold is about, would change.
2. *Index every row*: the code is cut into ``n_tables`` keys of ``key_bits``
   bits; table t groups the rows with equal key t.  ``key_bits`` grows with
   the counted rows (about ``BUCKET_ROWS`` rows a bucket); ``n_tables`` is set
   so that a pair exactly at the threshold meets with probability ``RECALL`` in
   at least one table, closer pairs almost surely.  That is measured on ``TRIALS``
   simulated partners of sampled rows that no rotation was fitted on.  Keys get
   shorter if ``MAX_TABLES`` tables don't reach it.  A vector length with at most
   ``TILE_ROWS`` different vectors is one bucket, compared as a whole.
3. *Rerank*: inside a bucket all rows are compared by cosine of the original
   vectors in double precision.  A pair is counted in the first table where
   its keys agree, so in no other.  Only sums per row and a spanning forest of
   the linked rows leave a task, never the pairs.

A bucket of more than ``TILE_ROWS`` rows is cut into chunks, and each pair of
chunks is a group of its own; a task never holds more than two chunks.  Equal
vectors are one class first; their members are added back as counts.

Defined results: vectors that are NULL, empty, all zero or hold NULL or
non-finite components link with nothing (n_links 0, own component, kept); rows
without an id are returned with n_links 0 and NULL component; equal rows of one
id are one vector, different vectors of one id add up their links and take the
smaller component; vectors of different length never link; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.common import materialize
from pactum.llm.graph import components

THRESHOLD = 0.9
#: Rows that the rotations are learned from, for each vector length.
SAMPLE_ROWS = 4096
#: Sampled rows beside them whose simulated partners show the recall, and partners in all.
TRIAL_ROWS, TRIALS = 1024, 16384
RECALL = 0.98
BUCKET_ROWS = 64
MIN_KEY_BITS, MAX_KEY_BITS = 6, 24
MAX_TABLES = 128
TILE_ROWS = 1024
ITERATIONS = 15


def itq_rotation(x: np.ndarray, seed: int, iterations: int = ITERATIONS) -> np.ndarray:
    """An orthogonal matrix R that brings ``x @ R`` close to its signs."""
    rng = np.random.default_rng(seed)
    r = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(iterations):
        u, _, vt = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
        r = (u @ vt).T
    return r


class Index:
    """Rotations and key layout for one vector length."""

    def __init__(self, sample: np.ndarray, n_rows: int, threshold: float):
        self.key_bits = 0
        self.n_tables = 1
        self.rotations: list[np.ndarray] = []
        self.mean = 0.0
        if n_rows <= TILE_ROWS or len(sample) < 2:  # one bucket: every pair is compared
            return
        held = max(1, min(TRIAL_ROWS, len(sample) // 4))
        trial, sample = sample[:held], sample[held:]
        # Codes are taken about the mean, so that each bit halves the rows, unless
        # the average cosine reaches the threshold: then most pairs are links, and
        # about their mean even the closest would fall apart.
        mean = sample.mean(axis=0)
        self.mean = mean if mean @ mean < threshold else 0.0
        rounds = -(-TRIALS // held)
        bits_a, bits_b = np.zeros((held, 0), bool), np.zeros((rounds, held, 0), bool)
        widest = int(np.clip(np.ceil(np.log2(n_rows / BUCKET_ROWS + 1)), MIN_KEY_BITS, MAX_KEY_BITS))
        for self.key_bits in range(widest, 0, -1):
            met = np.zeros((rounds, held), bool)
            for t in range(MAX_TABLES):
                while bits_a.shape[1] < (t + 1) * self.key_bits:
                    r = itq_rotation(sample - self.mean, seed=len(self.rotations))
                    self.rotations.append(r)
                    bits_a = np.concatenate([bits_a, (trial - self.mean) @ r >= 0], axis=1)
                    bits_b = np.concatenate([bits_b, [(x - self.mean) @ r >= 0 for x in partners(trial, rounds, threshold)]], axis=2)
                cut = slice(t * self.key_bits, (t + 1) * self.key_bits)
                met |= (bits_a[:, cut] == bits_b[:, :, cut]).all(axis=2)
                # Rows differ in their chance: the error of the mean is that of the mean over rows.
                if met.mean() - 2 * met.mean(axis=0).std() / np.sqrt(held) >= RECALL:
                    self.n_tables = t + 1
                    del self.rotations[-(-self.n_tables * self.key_bits // trial.shape[1]):]
                    return
        self.key_bits = 0
        self.rotations = []

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(rows, n_tables) int32 keys."""
        if not self.key_bits:
            return np.zeros((len(unit), 1), np.int32)
        bits = np.concatenate([(unit - self.mean) @ r >= 0 for r in self.rotations], axis=1)
        weights = 1 << np.arange(self.key_bits)
        cuts = bits[:, : self.n_tables * self.key_bits].reshape(len(unit), self.n_tables, self.key_bits)
        return (cuts @ weights).astype(np.int32)


def partners(x: np.ndarray, rounds: int, threshold: float) -> Iterator[np.ndarray]:
    """``rounds`` times one vector exactly at the threshold from each row; the same at every call."""
    for k in range(rounds):
        away = np.random.default_rng([7, k]).standard_normal(x.shape)
        away -= (away * x).sum(1, keepdims=True) * x
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
        yield threshold * x + np.sqrt(1 - threshold ** 2) * away


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def learn(classes: DataFrame, threshold: float) -> dict[int, Index]:
    """One index per vector length with more than ``TILE_ROWS`` rows, from at
    most ``SAMPLE_ROWS`` + ``TRIAL_ROWS`` of them; the other lengths need none."""
    out = {}
    wanted = SAMPLE_ROWS + TRIAL_ROWS
    for dim, n in classes.groupBy("dim").count().where(F.col("count") > TILE_ROWS).collect():  # one row per vector length
        share = int((1 << 40) * min(1.0, 2 * wanted / n))
        rows = (classes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("cls", F.lit(1)), F.lit(1 << 40)) < share))
                .orderBy(F.xxhash64("cls"), "cls").select("v").limit(wanted).toArrow())
        if rows.num_rows:
            out[dim] = Index(unit_rows(_matrix(rows.column("v").combine_chunks(), dim)), n, threshold)
    return out


def _forest(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Component number (smallest index) of each of ``len(ids)`` rows linked by (a, b)."""
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(rows: dict[str, np.ndarray], threshold: float, table: int, chunk: tuple[int, int]) -> tuple:
    """One tile: (cls, linked vectors) and (cls, cls) forest edges.  Pairs are
    taken between two different chunks, or inside one."""
    x, keys, weight, ids, own = rows["x"], rows["keys"], rows["n"], rows["cls"], rows["chunk"]
    if chunk[0] == chunk[1]:
        ia = ib = np.arange(len(x))
    else:
        ia, ib = np.flatnonzero(own == chunk[0]), np.flatnonzero(own == chunk[1])
    a, b = np.nonzero(x[ia] @ x[ib].T >= threshold)
    a, b = ia[a], ib[b]
    if chunk[0] == chunk[1]:
        a, b = a[a < b], b[a < b]
    fresh = np.ones(len(a), bool)
    for t in range(table):  # pairs that met before
        fresh &= keys[a, t] != keys[b, t]
    a, b = a[fresh], b[fresh]
    links = np.bincount(a, weight[b], len(x)) + np.bincount(b, weight[a], len(x))
    label = _forest(a, b, ids)
    moved = np.flatnonzero(label != np.arange(len(x)))
    return links.astype(np.int64), ids[moved], ids[label[moved]]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    v = F.transform(F.col("embedding"), lambda e: e.cast("double"))
    good = (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & (F.abs(e) < float("inf")) & ~F.isnan(e)) \
        & F.exists(v, lambda e: e != 0.0)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"),
                          F.when(F.coalesce(good, F.lit(False)), v).alias("v"))
    usable = rows.where("v IS NOT NULL AND vec_id IS NOT NULL").distinct()
    classes = materialize(usable.groupBy("v").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
                          .withColumn("dim", F.size("v")).withColumn("cls", F.monotonically_increasing_id()),
                          "itq-classes")
    shared = spark.sparkContext.broadcast(learn(classes, threshold))
    whole = Index(np.zeros((0, 1)), 0, threshold)  # one bucket for a length without an index of its own

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                own = shared.value.get(dim, whole)
                x = unit_rows(_matrix(part.column("v"), dim))
                keys = own.keys(x)
                rep = np.tile(np.arange(len(x)), own.n_tables)
                yield pa.RecordBatch.from_arrays(
                    [part.column("cls").take(pa.array(rep)), part.column("n").take(pa.array(rep)),
                     part.column("dim").take(pa.array(rep)),
                     pa.array(np.repeat(np.arange(own.n_tables, dtype=np.int32), len(x))), pa.array(keys.T.ravel()),
                     pa.array([keys[i].tobytes() for i in rep], pa.binary())],
                    names=["cls", "n", "dim", "t", "key", "keys"])

    entries = classes.mapInArrow(index, "cls bigint, n bigint, dim int, t int, key int, keys binary")
    entries = materialize(entries, "itq-keys")
    size = entries.groupBy("dim", "t", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    # Chunks of a bucket by row hash; every pair of chunks is one tile.
    tiled = (entries.join(size, ["dim", "t", "key"])
             .withColumn("c", F.ceil(F.col("m") / TILE_ROWS).cast("int"))
             .withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("c")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
             .select("cls", "n", "dim", "t", "key", "keys", "chunk",
                     F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j")))
    tiled = (tiled.join(classes.select("cls", "v"), "cls")
             .repartition("dim", "t", "key", "i", "j").sortWithinPartitions("dim", "t", "key", "i", "j"))

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_key = None

        def finish() -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks()
            dim, t, _, i, j = held_key
            got = {"x": unit_rows(_matrix(part.column("v").combine_chunks(), dim)),
                   "keys": np.array([np.frombuffer(b, np.int32) for b in part.column("keys").to_pylist()]),
                   "n": part.column("n").to_numpy(), "cls": part.column("cls").to_numpy(),
                   "chunk": part.column("chunk").to_numpy()}
            links, a, b = compare(got, threshold, t, (i, j))
            some = links > 0
            ids, none = got["cls"][some], np.zeros(some.sum(), np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids, a])), pa.array(np.concatenate([links[some], np.zeros_like(a)])),
                 pa.array(np.concatenate([ids, b]))], names=["cls", "links", "other"])

        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("dim", "t", "key", "i", "j")], axis=1)
            cuts = np.concatenate([[0], 1 + np.flatnonzero((key[1:] != key[:-1]).any(axis=1)), [len(key)]])
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b > a:
                    now = tuple(int(k) for k in key[a])
                    if held and now != held_key:
                        yield finish()
                        held = []
                    held_key = now
                    held.append(batch.slice(a, b - a))
        if held:
            yield finish()

    found = materialize(tiled.mapInArrow(tiles, "cls bigint, links bigint, other bigint"), "itq-links")
    linked = found.groupBy("cls").agg(F.sum("links").alias("links"))
    comp = components(found.where("cls <> other").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    per_class = materialize(classes.select("cls", "first_id", "n", "v").join(linked, "cls", "left")
                            .join(comp.select(F.col("id").alias("cls"), F.col("component_id").alias("root")), "cls", "left")
                            .select("v", F.coalesce("links", F.lit(0)).alias("links"), "n", "first_id",
                                    F.coalesce("root", "cls").alias("root")), "itq-classes")
    least = per_class.groupBy("root").agg(F.min("first_id").alias("component_id"))
    per_class = per_class.join(least, "root")
    per_row = (usable.join(per_class, "v")
               .groupBy("vec_id").agg(F.sum(F.col("links") + F.col("n") - 1).alias("n_links"),
                                      F.min("component_id").alias("component_id")))
    rest = rows.join(per_row, "vec_id", "left")
    comp_id = F.coalesce("component_id", "vec_id")
    return rest.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                       comp_id.alias("component_id"),
                       F.coalesce(comp_id == F.col("vec_id"), F.lit(True)).alias("kept"))
