"""Exact, parallel ranks and selections without a single-partition window.

A global ``row_number()`` with no partition is planned as
``Exchange SinglePartition``: one task sorts everything.  Instead:

* ``dense_ids`` (W1: ids 1..N in the order of a unique key): range-partition
  on the full key (a hot leading key value is split across partitions because
  the key is unique), sort inside partitions, tag rows with their partition
  and position, write the tagged rows once to the shared scratch folder (so
  the sampled range bounds are fixed), then add each partition's base from a
  table of per-partition counts (at most ``num_partitions`` rows, broadcast).
* ``group_row_number`` (W3, W7, W8, L3): dense ids over (group, order), less the
  first of the group; ``hash_rank`` is that over a seeded hash of the key, on
  rows of the group, the hash and the key alone.
* ``smallest`` (L2, L4, R4: the first n rows of an order): a threshold by repeated
  narrowing.  Each pass counts the values of an interval in ``BINS`` equal bins
  and goes on with the bin in which the n-th value lies; only the rows up to
  the threshold, n and a few, are ever shuffled, ranked or written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactum.session import scratch_path

#: Bins counted in one pass; that many numbers reach the driver.
BINS = 4096
#: Rows above the wanted ones that are ranked rather than counted once more, at least.
SPARE = 10_000
#: Hex digits of a hash that make its number.
HASH_DIGITS = 15


def dense_ids(df: DataFrame, order_cols: list[str], id_col: str = "id",
              num_partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = (
        df.repartitionByRange(n, *order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    path = scratch_path(spark, "dense-ids")
    tagged.write.mode("error").parquet(path)
    stored = spark.read.parquet(path)
    counts = stored.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # At most ``n`` rows: one per range partition.
    bases = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_base"),
    )
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (
        stored.join(F.broadcast(bases), "_pid")
        .withColumn(id_col, (F.col("_base") + local + 1).cast("bigint"))
        .drop("_pid", "_mid", "_base")
    )


def seeded_hash(key: Column, seed: int | str) -> Column:
    """md5 of ``'<seed>:' || key`` as lowercase hex (Spark and DuckDB agree)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_number(h: Column) -> Column:
    """The leading digits of a hex hash as a BIGINT in its order, from 0 to 16 ** HASH_DIGITS - 1."""
    return F.conv(F.substring(h, 1, HASH_DIGITS), 16, 10).cast("bigint")


def hash_rank(keys: DataFrame, key_col: str, seed: int | str, rank_col: str = "rank",
              group_cols: list[str] | None = None, total_col: str | None = None,
              hash_col: Column | None = None) -> DataFrame:
    """Group columns, key and its rank 1..n (per group) by ``md5(seed:key)`` then key;
    key unique per group.  ``total_col``: the number of keys (per group)."""
    group_cols = group_cols or []
    h = hash_col if hash_col is not None else seeded_hash(F.col(key_col), seed)
    narrow = keys.select(*group_cols, key_col, F.unhex(h).alias("_h"))
    ided = dense_ids(narrow, [*group_cols, "_h", key_col], "_gid").drop("_h")
    # One row per group; a group's ids follow each other.
    groups = ided.groupBy(*group_cols).agg(F.min("_gid").alias("_first"), F.count(F.lit(1)).alias("_total"))
    ranked = ided.join(groups, group_cols) if group_cols else ided.crossJoin(F.broadcast(groups))  # of one row
    ranked = ranked.withColumn(rank_col, (F.col("_gid") - F.col("_first") + 1).cast("bigint"))
    return ranked.select(*group_cols, key_col, rank_col, *([F.col("_total").alias(total_col)] if total_col else []))


def smallest(df: DataFrame, value: Column, n: int, low: int | None = None, high: int | None = None,
             spare: int = SPARE) -> DataFrame:
    """The rows of ``df`` up to a threshold of ``value`` (a BIGINT) that holds at least the ``n``
    smallest, and not many more: less than ``max(n, spare)``, unless that many share one value.
    ``low`` and ``high`` bound the values, if known.  Rows without a value are none of them."""
    values = df.select(value.alias("v")).where("v IS NOT NULL")
    if n <= 0:
        return df.where(F.lit(False))
    if low is None or high is None:
        low, high = values.agg(F.min("v"), F.max("v")).first()
        if low is None:
            return df.where(F.lit(False))
    need = n
    while True:
        width = (high - low) // BINS + 1
        place = F.expr(f"(cast(v AS decimal(38, 0)) - ({low}BD)) div {width}BD")  # any two BIGINTs have a difference
        counts = dict(values.where(F.col("v").between(low, high)).groupBy(place.alias("b")).count().collect())  # BINS at most
        found = 0
        for b in sorted(counts):
            if found + counts[b] >= need:
                break
            found += counts[b]
        else:
            return df.where(value <= high)  # there are no more than n
        low, high, need = low + b * width, min(high, low + (b + 1) * width - 1), need - found
        if width == 1 or counts[b] <= max(n, spare):
            return df.where(value <= high)


def group_row_number(df: DataFrame, group_cols: list[str], order_cols: list[str],
                     col: str = "rn") -> DataFrame:
    """Row number 1..n inside each group without a per-group window, so a
    group holding a third of all rows is still split across tasks: global
    dense ids over (group, order) minus the group's first id (a partial
    aggregate), joined back on the group key (AQE splits a skewed side)."""
    ided = dense_ids(df, [*group_cols, *order_cols], "_gid")
    first = ided.groupBy(*group_cols).agg(F.min("_gid").alias("_first"))
    return (ided.join(first, group_cols)
            .withColumn(col, (F.col("_gid") - F.col("_first") + 1).cast("bigint"))
            .drop("_gid", "_first"))
