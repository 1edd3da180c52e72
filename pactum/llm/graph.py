"""Connected components of an edge table by alternating large-star / small-star steps.

Each step is one aggregate for the smallest neighbour and one join; a node
with many neighbours is pre-aggregated and its join side split by Spark's skew
join.  The edge table is written to the shared folder after each step; only
two numbers (row count and a checksum) reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.common import materialize


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step over (u, v) with u > v."""
    if small:  # u with its smaller neighbours: all of them, and u, point to the smallest
        least = edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        moved = edges.join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.where("u > v").union(least.select(F.col("n"), F.col("m"))).distinct()
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy(F.col("u").alias("n")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every id that occurs in ``edges`` (a, b longs, any
    order, repeats and loops allowed); component_id is the smallest id reachable."""
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                      .where("u > v").distinct(), "cc")
    mark = None
    while True:
        now = materialize(_star(_star(now, small=False), small=True), "cc")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == mark:
            break
        mark = tuple(new)
    ids = now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return ids.union(now.select(F.col("v"), F.col("v"))).distinct()
