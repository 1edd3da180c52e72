"""Ids, split, lookup properties (FIXTURES.md sections 5 and 7)."""

from pyspark.sql import functions as F

from pactum.operators import ids
from pactum.operators import lookup
from pactum.operators import scenarios as S


def test_dense_ids_with_hot_key(spark):
    # a third of all rows share one leading key value
    rows = [(0 if i % 3 == 0 else i, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k BIGINT, j BIGINT")
    out = ids.dense_ids(df, ["k", "j"], "id").orderBy("id").collect()
    assert [r["id"] for r in out] == list(range(1, 3001))
    assert [(r["k"], r["j"]) for r in out] == sorted(rows)


def test_group_row_number(spark):
    rows = [(u, t) for u in range(5) for t in range(u * 10, u * 10 + 7)] + [(9, t) for t in range(500)]
    df = spark.createDataFrame(rows, "u BIGINT, t BIGINT")
    out = ids.group_row_number(df, ["u"], ["t"], "rn").collect()
    for r in out:
        assert r["rn"] == r["t"] - (r["u"] * 10 if r["u"] < 9 else 0) + 1


def _scen(spark, n_contracts):
    rows = [(c * 10 + s, c) for c in range(1, n_contracts + 1) for s in range(3)]
    return spark.createDataFrame(rows, "scenario_id BIGINT, contract_id BIGINT")


def test_split_sizes_and_disjoint(spark):
    for n, ratio, n_train in ((10, 0.8, 8), (100, 0.29, 28)):
        sp = S.contract_split(_scen(spark, n), ratio)
        got = {r["split"]: r["count"] for r in sp.groupBy("split").count().collect()}
        assert got["train"] == n_train and got["test"] == n - n_train
    split = S.split_scenarios(_scen(spark, 50))
    rep = S.split_disjointness(split).first()
    assert rep["n_overlap_contracts"] == 0
    assert rep["n_train_contracts"] == 40


def test_split_deterministic(spark):
    a = {r["contract_id"]: r["split"] for r in S.contract_split(_scen(spark, 40)).collect()}
    b = {r["contract_id"]: r["split"] for r in S.contract_split(_scen(spark, 40)).collect()}
    assert a == b
    c = {r["contract_id"]: r["split"] for r in S.contract_split(_scen(spark, 40), seed=7).collect()}
    assert c != a


def test_sample_limits(spark):
    split = S.split_scenarios(_scen(spark, 20))
    assert S.sample_scenarios(split, "train", 0, shuffle=True).count() == 0
    n_train = split.filter("split = 'train'").count()
    assert S.sample_scenarios(split, "train", 10_000, shuffle=True).count() == n_train
    ranks = [r["sample_rank"] for r in S.sample_scenarios(split, "train", 5).collect()]
    assert sorted(ranks) == [1, 2, 3, 4, 5]


def test_lookup_statuses(spark):
    c = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "contract_id BIGINT, title STRING, full_text STRING")
    req = spark.createDataFrame([(1, 1), (2, -1), (3, 0), (4, 1000000), (5, None)],
                                "request_id BIGINT, contract_id BIGINT")
    st = {r["request_id"]: r["status"] for r in lookup.read_by_id(req, c).collect()}
    assert st == {1: "ok", 2: "invalid_id", 3: "invalid_id", 4: "not_found", 5: "invalid_id"}


def test_training_schedule(spark):
    split = S.split_scenarios(_scen(spark, 10))
    sample = S.sample_scenarios(split, "train", None, shuffle=True)
    n = sample.count()
    sch = S.training_schedule(sample, num_epochs=2, groups_per_step=4, trajectories_per_group=3, eval_steps=2)
    assert sch.count() == n * 2 * 3
    steps = sch.select("epoch", "global_step").distinct().groupBy("epoch").count().collect()
    assert all(r["count"] == -(-n // 4) for r in steps)
    resumed = S.training_schedule(sample, num_epochs=2, groups_per_step=4, initial_step=3)
    assert resumed.agg(F.min("global_step")).first()[0] == 3


def test_write_read_scenarios_prunes(spark, tmp_path):
    split = S.split_scenarios(_scen(spark, 20).select(
        "scenario_id", "contract_id", F.lit("t").alias("contract_title"), F.col("scenario_id").alias("annotation_id"),
        F.lit("c").alias("clause_type"), F.lit("x").alias("ground_truth_clause_text"),
        F.lit(0).cast("bigint").alias("start_char"), F.lit(1).cast("bigint").alias("end_char")))
    path = str(tmp_path / "scen")
    S.write_scenarios(split, path)
    test = S.read_scenarios(spark, path, "test")
    assert dict(test.dtypes)["scenario_id"] == "bigint"
    assert test.count() == split.filter("split = 'test'").count()
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "split" in plan


def test_evaluation_points(spark):
    split = S.split_scenarios(_scen(spark, 30))
    sample = S.sample_scenarios(split, "train", None, shuffle=True)
    sch = S.training_schedule(sample, num_epochs=2, groups_per_step=4, eval_steps=5)
    pts = sorted((r["global_step"], r["kind"]) for r in S.evaluation_points(sch).collect())
    n_steps = sch.agg(F.max("global_step")).first()[0] + 1
    assert pts[-1] == (n_steps, "final")
    assert [p for p, k in pts if k == "periodic"] == [s for s in range(1, n_steps) if s % 5 == 0]


def test_write_tables_guard(spark, tmp_path):
    from pactum.operators import tables as T
    import pytest
    c = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id BIGINT, title STRING, full_text STRING")
    a = spark.createDataFrame([(1, 1, "q", "x", 0, 1)],
                              "id BIGINT, contract_id BIGINT, clause_type STRING, text STRING, start_char BIGINT, end_char BIGINT")
    out = str(tmp_path / "db")
    assert T.write_tables(c, a, out) == {"skipped": False}
    assert T.write_tables(c, a, out) == {"skipped": True}      # built and committed: skip
    assert T.write_tables(c, a, out, overwrite=True) == {"skipped": False}
    dup = spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], "id BIGINT, title STRING, full_text STRING")
    with pytest.raises(ValueError, match="duplicate"):
        T.write_tables(dup, a, str(tmp_path / "db2"))


def test_half_built_tables_are_rebuilt(spark, tmp_path):
    from pactum.operators import tables as T
    c = spark.createDataFrame([(1, "a", "x")], "id BIGINT, title STRING, full_text STRING")
    a = spark.createDataFrame([(1, 1, "q", "x", 0, 1)],
                              "id BIGINT, contract_id BIGINT, clause_type STRING, text STRING, start_char BIGINT, end_char BIGINT")
    out = str(tmp_path / "db")
    c.write.parquet(f"{out}/contracts")          # contracts committed, annotations missing
    assert T.write_tables(c, a, out) == {"skipped": False}
    assert spark.read.parquet(f"{out}/annotations").count() == 1


def test_threshold_split_mode(spark):
    scen = _scen(spark, 400)
    a = {r["contract_id"]: r["split"] for r in S.contract_split(scen, 0.8, mode="threshold").collect()}
    b = {r["contract_id"]: r["split"] for r in S.contract_split(scen, 0.8, mode="threshold").collect()}
    assert a == b
    share = sum(v == "train" for v in a.values()) / len(a)
    assert 0.7 < share < 0.9
    # stable when contracts are added: existing contracts keep their split
    more = {r["contract_id"]: r["split"] for r in S.contract_split(_scen(spark, 500), 0.8, mode="threshold").collect()}
    assert all(more[c] == s for c, s in a.items())
