"""Scenarios, the group-safe split, seeded samples and the training schedule
(J2, P13, A1, A2, W7, W8, L2-L5, J5, U2, U3, R1-R4, F22)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.operators.ids import HASH_DIGITS, dense_ids, hash_number, hash_rank, seeded_hash, smallest
from pactum.schemas import (EVAL_STEPS, GROUPS_PER_STEP, NUM_EPOCHS, SCENARIO_COLUMNS,
                            SPLIT_SEED, TRAIN_RATIO, TRAJECTORIES_PER_GROUP)


def scenarios(annotations: DataFrame, contracts: DataFrame) -> DataFrame:
    """J2 + P13: annotations joined to contract titles (``full_text`` is pruned
    from the scan); ``scenario_id = annotation_id``; rows with a null field are dropped."""
    c = contracts.select(F.col("id").alias("contract_id"), F.col("title").alias("contract_title"))
    joined = annotations.join(c, "contract_id", "inner")
    out = joined.select(
        F.col("id").alias("scenario_id"), "contract_id", "contract_title",
        F.col("id").alias("annotation_id"), "clause_type",
        F.col("text").alias("ground_truth_clause_text"), "start_char", "end_char")
    return out.dropna(subset=SCENARIO_COLUMNS)


def contract_split(scen: DataFrame, train_ratio: float = TRAIN_RATIO, seed: int = SPLIT_SEED,
                   mode: str = "exact") -> DataFrame:
    """(contract_id, contract_rank, split) over the distinct contracts of the scenarios.

    ``exact``: contracts ranked by md5(seed:contract_id); the first
    ``floor(n * ratio)`` are train (double arithmetic, as Python's int()).
    ``threshold``: train when the hash falls below ratio * 16**8 -- no rank,
    approximate size, stable when contracts are added."""
    ids = scen.select("contract_id").distinct()
    if mode == "threshold":
        h = F.conv(F.substring(seeded_hash(F.col("contract_id"), seed), 1, 8), 16, 10).cast("double")
        return ids.select("contract_id", F.lit(None).cast("bigint").alias("contract_rank"),
                          F.when(h < F.lit(float(train_ratio)) * F.lit(16.0 ** 8), "train")
                          .otherwise("test").alias("split"))
    ranked = hash_rank(ids, "contract_id", seed, rank_col="contract_rank", total_col="_n")
    n_train = F.floor(F.col("_n").cast("double") * F.lit(float(train_ratio)))
    return ranked.select("contract_id", "contract_rank",
                         F.when(F.col("contract_rank") <= n_train, "train").otherwise("test").alias("split"))


def split_scenarios(scen: DataFrame, train_ratio: float = TRAIN_RATIO, seed: int = SPLIT_SEED,
                    mode: str = "exact") -> DataFrame:
    """Scenarios with a ``split`` column (U2); a contract is in exactly one split."""
    return scen.join(contract_split(scen, train_ratio, seed, mode), "contract_id")


def split_disjointness(split: DataFrame) -> DataFrame:
    """U3 as a report: contracts and scenarios per split and the number of
    contracts in both splits (the size of train ids INTERSECT test ids; must
    be 0).  One pass: a per-contract partial aggregate, then a global one."""
    per_contract = split.groupBy("contract_id").agg(
        F.count_if(F.col("split") == "train").alias("_tr"),
        F.count_if(F.col("split") == "test").alias("_te"))
    return per_contract.agg(
        F.count_if(F.col("_tr") > 0).alias("n_train_contracts"),
        F.count_if(F.col("_te") > 0).alias("n_test_contracts"),
        F.sum("_tr").alias("n_train_scenarios"),
        F.sum("_te").alias("n_test_scenarios"),
        F.count_if((F.col("_tr") > 0) & (F.col("_te") > 0)).alias("n_overlap_contracts"))


def sample_scenarios(split: DataFrame, which: str = "train", limit: int | None = None,
                     shuffle: bool = False, seed: int = SPLIT_SEED) -> DataFrame:
    """S11 + L2 + L4 + R4: one split (partition-pruned when read from a
    ``split=`` layout), optionally in seeded shuffled order, then the first
    ``limit`` rows.  ``sample_rank`` is the position; without shuffle the order
    is ``scenario_id``.  With a limit only the rows up to an exact threshold are ranked
    and moved; without one, ranks are made on keys alone and joined back."""
    if limit is not None and limit < 0:
        raise ValueError("limit must be >= 0")
    rows = split.filter(F.col("split") == which)
    key = F.col("scenario_id").cast("bigint")
    if limit is None:
        if shuffle:
            ranks = hash_rank(rows.select("scenario_id"), "scenario_id", seed, rank_col="sample_rank")
        else:
            ranks = dense_ids(rows.select("scenario_id"), ["scenario_id"], "sample_rank")
        return rows.join(ranks, "scenario_id")
    if shuffle:
        h = seeded_hash(F.col("scenario_id"), seed)
        chosen = smallest(rows, hash_number(h), limit, 0, 16 ** HASH_DIGITS - 1).withColumn("_h", F.unhex(h))
        ranked = dense_ids(chosen, ["_h", "scenario_id"], "sample_rank").drop("_h")
    else:
        ranked = dense_ids(smallest(rows, key, limit), ["scenario_id"], "sample_rank")
    return ranked.filter(F.col("sample_rank") <= limit)


def training_schedule(sample: DataFrame, num_epochs: int = NUM_EPOCHS,
                      groups_per_step: int = GROUPS_PER_STEP,
                      trajectories_per_group: int = TRAJECTORIES_PER_GROUP,
                      eval_steps: int = EVAL_STEPS, initial_step: int = 0,
                      seed: int = SPLIT_SEED) -> DataFrame:
    """Every epoch visits every scenario once in a fresh seeded
    order, cut into steps of ``groups_per_step`` (a trailing partial step is
    kept); each scenario is fanned out to ``trajectories_per_group`` runs;
    steps before ``initial_step`` are skipped on resume; ``eval_before`` marks
    the steps preceded by an evaluation."""
    per_epoch = sample.select("scenario_id", F.explode(F.sequence(F.lit(0), F.lit(num_epochs - 1))).alias("epoch"))
    h = seeded_hash(F.concat_ws(":", F.col("epoch").cast("string"), F.col("scenario_id").cast("string")), seed)
    ranked = hash_rank(per_epoch, "scenario_id", seed, rank_col="epoch_rank",
                       group_cols=["epoch"], total_col="_n", hash_col=h)
    steps_per_epoch = F.ceil(F.col("_n") / F.lit(groups_per_step)).cast("bigint")
    epoch_step = F.floor((F.col("epoch_rank") - 1) / F.lit(groups_per_step)).cast("bigint")
    sched = ranked.select(
        F.col("epoch").cast("bigint").alias("epoch"),
        epoch_step.alias("epoch_step"),
        (F.col("epoch") * steps_per_epoch + epoch_step).alias("global_step"),
        "scenario_id")
    sched = sched.filter(F.col("global_step") >= initial_step)
    sched = sched.withColumn(
        "eval_before", (F.col("global_step") > initial_step) & (F.pmod(F.col("global_step"), F.lit(eval_steps)) == 0))
    return sched.select("*", F.explode(F.sequence(F.lit(1), F.lit(trajectories_per_group))).alias("run_idx")) \
        .withColumn("run_idx", F.col("run_idx").cast("bigint"))


SCENARIO_INT_COLUMNS = ("scenario_id", "contract_id", "annotation_id", "start_char", "end_char")


def write_scenarios(split: DataFrame, path: str) -> None:
    """The scenario dataset with whole-number ids/offsets (64 bits: no id
    wraps or fails at any size) and string texts, laid out by ``split`` so a
    reader of one split prunes the other."""
    cols = [F.col(c).cast("bigint").alias(c) if c in SCENARIO_INT_COLUMNS else F.col(c).cast("string").alias(c)
            for c in SCENARIO_COLUMNS]
    split.select(*cols, "split").write.mode("overwrite").partitionBy("split").parquet(path)


def read_scenarios(spark, path: str, which: str) -> DataFrame:
    """One split by partition pruning; rows with a field that fails the
    typed conversion (NULL after the cast) are skipped, as the loader skips
    rows it cannot convert."""
    df = spark.read.parquet(path).filter(F.col("split") == which)
    return df.dropna(subset=list(SCENARIO_COLUMNS))


def evaluation_points(schedule: DataFrame, initial_step: int = 0) -> DataFrame:
    """The steps preceded by an evaluation plus one final evaluation after
    the last step: (global_step, kind) with kind 'periodic' / 'final'."""
    steps = schedule.select("global_step", "eval_before").distinct()
    periodic = steps.filter(F.col("eval_before")).select("global_step", F.lit("periodic").alias("kind"))
    last = steps.agg(F.max("global_step").alias("m"))
    final = last.select(F.coalesce(F.col("m") + 1, F.lit(initial_step)).alias("global_step"),
                        F.lit("final").alias("kind"))
    return periodic.unionByName(final)
