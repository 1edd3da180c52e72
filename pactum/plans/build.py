"""End-to-end data preparation as Spark jobs, step by step:

1. ``convert``   raw nested JSON -> validated contracts (processed JSON Lines
                 + nested parquet) and a rejects report            (S1-S3, P1-P7)
2. ``build``     processed contracts -> contracts / annotations tables with
                 integrity checks, and the search index             (S5-S9, W1, A3, A4)
3. ``scenarios`` tables -> scenarios split by contract, dataset by split
                                                                     (J2, P13, split, S10)

Every step reads the previous step's output from storage and writes its own;
paths are arguments.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pactum.operators import scenarios as scen_ops
from pactum.operators import tables as table_ops
from pactum.operators import textindex as ti
from pactum.schemas import SPLIT_SEED, TRAIN_RATIO
from pactum.sources import nested_json as nj


def convert(spark: SparkSession, input_path: str, out_dir: str, max_contracts: int | None = None,
            json_lines: bool = False) -> dict:
    """Validate raw contracts; write ``processed`` (JSON Lines), ``nested``
    (parquet) and ``rejects`` (parquet).  Returns the counts."""
    raw = nj.read_lines(spark, input_path) if json_lines else nj.read_envelope(spark, input_path)
    flagged = nj.validate(raw, max_contracts=max_contracts)
    path = f"{out_dir}/flagged"
    flagged.write.mode("overwrite").parquet(path)           # validated once, read by both outputs
    flagged = spark.read.parquet(path)
    good, rejects = nj.good_and_rejects(flagged)
    nj.write_processed_lines(good, f"{out_dir}/processed")
    nj.write_processed_parquet(good, f"{out_dir}/nested")
    rejects.write.mode("overwrite").parquet(f"{out_dir}/rejects")
    counts = flagged.groupBy("status").count().collect()    # at most three rows
    return {r["status"]: r["count"] for r in counts}


def build(spark: SparkSession, processed_dir: str, out_dir: str, overwrite: bool = False,
          index_buckets: int = ti.INDEX_BUCKETS, envelope: bool = False) -> dict:
    """Tables and index from the processed contracts (re-validated on load),
    given as JSON Lines or, with ``envelope``, as ``{"data": [..]}`` files.

    Skipped, before anything is read, only when tables and index are both
    there; an index that a failure left out is built from the stored tables."""
    if not overwrite and table_ops.is_complete(spark, f"{out_dir}/tables"):
        if not table_ops.committed(spark, f"{out_dir}/index/postings", f"{out_dir}/index/doc_stats"):
            _write_index(spark, out_dir, index_buckets)
        return {"skipped": True}
    raw = nj.read_envelope(spark, processed_dir) if envelope else nj.read_lines(spark, processed_dir)
    good, _ = nj.good_and_rejects(nj.validate(raw, mode="processed"))
    contracts = table_ops.contracts_table(good)              # ids 1..N in input order
    ids = contracts.select(F.col("contract_seq"), F.col("id").alias("contract_id"))
    nested = good.join(ids, "contract_seq")
    annotations = table_ops.annotations_table(nested)
    result = table_ops.write_tables(contracts, annotations, f"{out_dir}/tables", overwrite=overwrite)
    _write_index(spark, out_dir, index_buckets)
    return result


def _write_index(spark: SparkSession, out_dir: str, buckets: int) -> None:
    stored = spark.read.parquet(f"{out_dir}/tables/contracts").select(
        F.col("id").alias("contract_id"), "title", "full_text")
    ti.write_index(stored, f"{out_dir}/index", buckets=buckets)


def scenarios(spark: SparkSession, tables_dir: str, out_path: str, train_ratio: float = TRAIN_RATIO,
              seed: int = SPLIT_SEED) -> None:
    """Scenario dataset split by contract, written by split."""
    ann = spark.read.parquet(f"{tables_dir}/annotations")
    con = spark.read.parquet(f"{tables_dir}/contracts")
    split = scen_ops.split_scenarios(scen_ops.scenarios(ann, con), train_ratio, seed)
    scen_ops.write_scenarios(split, out_path)


def score_runs(spark: SparkSession, turns_path: str, scenarios_path: str, tables_dir: str,
               out_dir: str, replies_path: str | None = None, max_turns: int = 10) -> None:
    """Logged runs -> rubric, metrics (per run) and the benchmark means.

    ``turns_path``: parquet in the ``TURNS`` shape of ``pactum.schemas``;
    ``replies_path``: judge replies (trajectory_id, turn, reply,
    judge_prompt_tokens, judge_completion_tokens), optional."""
    from pactum.functions import scoring
    from pactum.operators import benchmark as bench_ops
    from pactum.operators import runs as run_ops

    turns = spark.read.parquet(turns_path)
    scen = spark.read.parquet(scenarios_path)
    ids = spark.read.parquet(f"{tables_dir}/contracts").select(F.col("id").alias("contract_id"))
    replies = spark.read.parquet(replies_path) if replies_path else None
    rubric = run_ops.rubric(run_ops.classified_turns(turns, scen, ids, replies, max_turns), max_turns)
    metrics = scoring.metrics(rubric, max_turns)
    metrics.write.mode("overwrite").parquet(f"{out_dir}/metrics")
    stored = spark.read.parquet(f"{out_dir}/metrics")
    bench_ops.benchmark_means(stored).write.mode("overwrite").parquet(f"{out_dir}/means")
