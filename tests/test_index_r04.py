"""The upkept index is read without a shuffle of its postings."""

from pactum.streaming.index_upkeep import IndexStore


def test_live_contracts_meet_postings_without_a_shuffle(spark, tmp_path):
    """F14"""
    store = IndexStore(spark, str(tmp_path / "index"))
    store.build(spark.createDataFrame([(i, f"t{i}", "a b a") for i in range(20)], "contract_id BIGINT, title STRING, full_text STRING"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        postings = store.read("postings")
        plan = postings._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert postings.count() == 20 * 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
