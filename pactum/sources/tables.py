"""Reading the driver's parquet tables (one file per table) with column pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)
# Tables whose rows carry long text: per-row work (regex, tokenising, nested
# transforms) dominates, so a scan with too few splits is spread out.
TEXT_TABLES = ("documents", "pages", "conversations", "benchmark")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one driver table.  Callers select the columns they need right
    after, so Catalyst prunes the parquet ReadSchema to those columns."""
    if name not in DRIVER_TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition only when the scan yields fewer partitions than
    the cluster can run at once (e.g. a file with a single row group).  A
    large input already has many splits and is returned unchanged, so no
    shuffle is added at scale."""
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    have = df.rdd.getNumPartitions()
    return df.repartition(want) if have < want else df


def text_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Pruned scan of a text table, spread over the cluster when needed."""
    df = table(spark, sf_dir, name)
    if cols:
        df = df.select(*cols)
    return spread(df) if name in TEXT_TABLES else df
