"""Benchmark means and trajectory groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.operators.search import stable_double

ID_COLUMNS = ("trajectory_id", "scenario_id")
MEAN_PLACES = 9


def numeric_metric_columns(df: DataFrame) -> list[str]:
    """int/float columns only (null-typed and id columns left out)."""
    numeric = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, numeric) and f.name not in ID_COLUMNS]


def benchmark_means(metrics: DataFrame, status_col: str = "status") -> DataFrame:
    """One row -- the mean of every numeric metric over valid runs and
    ``n_trajectories`` (valid runs).  With no valid run the means are NULL and
    ``n_trajectories`` is 0.  One global aggregate: partial sums per task."""
    valid = metrics.filter(F.col(status_col) == "valid")
    cols = numeric_metric_columns(metrics)
    return valid.agg(*[stable_double(F.avg(c), MEAN_PLACES).alias(c) for c in cols],
                     F.count(F.lit(1)).alias("n_trajectories"))


def union_metrics(frames: list[DataFrame]) -> DataFrame:
    """U4: metric rows whose keys differ are stacked by name, missing -> NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def run_counts(metrics: DataFrame, status_col: str = "status") -> DataFrame:
    """A10: valid and error counts."""
    return metrics.agg(F.count_if(F.col(status_col) == "valid").alias("num_valid"),
                       F.count_if(F.col(status_col) != "valid").alias("num_errors"))


def trajectory_groups(metrics: DataFrame) -> DataFrame:
    """The runs of one scenario form a group (the unit of a training
    step); per group: size, reward mean / spread, and successes."""
    valid = metrics.filter(F.col("status") == "valid")
    return valid.groupBy("scenario_id").agg(
        F.count(F.lit(1)).alias("n_runs"),
        stable_double(F.avg("reward"), MEAN_PLACES).alias("mean_reward"),
        stable_double(F.min("reward"), MEAN_PLACES).alias("min_reward"),
        stable_double(F.max("reward"), MEAN_PLACES).alias("max_reward"),
        stable_double(F.stddev_pop("reward"), 6).alias("std_reward"),
        F.sum((F.col("clause_text_correct") * F.col("found_correct_contract")).cast("bigint")).alias("n_correct"))


def log_runs(metrics: DataFrame, path: str, model: str, split: str) -> None:
    """Append the valid runs of one benchmark to the run log, laid out by
    model and split.  A failed append leaves no committed files (the write
    commit protocol), and the caller only warns, as the original does."""
    (metrics.filter(F.col("status") == "valid")
     .withColumn("model", F.lit(model)).withColumn("split", F.lit(split))
     .write.mode("append").partitionBy("model", "split").parquet(path))
