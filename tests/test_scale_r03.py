"""Findings of round 3: running sums computed once, index blocks without a shuffle of rows, replies said once."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from pactum.operators import blockindex
from pactum.operators import tables as table_ops
from pactum.operators.flatten import exclusive_sums
from pactum.plans import common as C
from pactum.session import scratch_root

from .conftest import SF_SMALL


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_exclusive_sums_of_any_length(spark):
    rng = random.Random(3)
    rows = [(n, [rng.randrange(100) for _ in range(n)]) for n in (0, 1, 2, 63, 64, 65, 128, 129, 5000)] + [(-1, None)]
    df = spark.createDataFrame(rows, "n INT, a ARRAY<BIGINT>")
    got = {r.n: r.s for r in df.select("n", exclusive_sums(F.col("a")).alias("s")).collect()}
    for n, a in rows:
        assert got[n] == (None if a is None else [sum(a[:i]) for i in range(n)])


def test_exclusive_sums_take_their_argument_once(spark):
    lens = F.transform(F.split("t", ","), lambda x: F.length(x).cast("bigint"))
    df = spark.createDataFrame([("a,bb,ccc",)], "t STRING").select(exclusive_sums(lens).alias("s"))
    assert df.first().s == [0, 1, 3]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 1


def test_annotations_are_flattened_once(spark):
    """The stage that numbers them reads stored rows, not the texts."""
    seen = []
    nested = C.nested(spark, SF_SMALL)
    table_ops.annotations_table(nested)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    for f in fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(fs):
        seen.append(f.getPath().getName())
    assert any(re.match(r"annotations-[0-9a-f]{32}$", n) for n in seen)


@pytest.fixture
def contracts(spark):
    rows = [(i, f"Lease {i} lease", "the the lease " * (i % 5) + f"w{i}") for i in range(200)] + [(7, "Again", "the x"), (300, None, None)]
    return spark.createDataFrame(rows, "contract_id BIGINT, title STRING, full_text STRING")


def test_blocks_of_repeated_ids_and_titles(spark, contracts, tmp_path):
    blockindex.build_block_index(contracts, str(tmp_path))
    blocks = blockindex.BlockIndex(spark, str(tmp_path)).table("blocks")
    got = {(r.token, r.block): r for r in blocks.collect()}
    first = got["lease", 0]
    assert first.ids == list(range(64)) and first.title[6] == [0, 2] and first.body[6] == [2]
    assert first.tfs[9] == 6 and first.title[5] == [0, 2] and first.body[5] == []
    the = got["the", 0]
    assert the.ids.count(7) == 2  # two contracts with one id, of different lengths
    assert sum(r.n for (t, _), r in got.items() if t == "lease") == 200


def test_blocks_are_not_shuffled(spark, contracts, tmp_path, monkeypatch):
    """Neither occurrences nor blocks: texts and token arrays alone."""
    ranged = []
    frame = type(contracts)
    old = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, *a: (ranged.append(self.columns), old(self, *a))[1])
    blockindex.build_block_index(contracts, str(tmp_path))
    assert ranged == [["contract_id", "title", "full_text"]]


def test_replies_are_said_once_per_contract_and_search(spark):
    """No text is joined to turns: what is read and found is digested before it meets them."""
    plan = final_plan(E.queries()["tool_reply"](spark, SF_SMALL))
    assert "full_text" not in plan and "snippet" not in plan


def test_hits_meet_queries_without_a_shuffle(spark):
    plan = final_plan(E.queries()["search_replay"](spark, SF_SMALL))
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_scenarios_are_built_once_per_query(spark, monkeypatch):
    """Runs and schedule, or runs and trajectories, share one table of annotations."""
    built = []
    old = table_ops.annotations_table
    monkeypatch.setattr(table_ops, "annotations_table", lambda *a, **k: (built.append(1), old(*a, **k))[1])
    for name in ("conversation_trajectories", "step_groups"):
        built.clear()
        E.queries()[name](spark, SF_SMALL)
        assert len(built) == 1, name


def test_contracts_are_validated_once(spark):
    assert "parse_json" not in final_plan(E.queries()["load_nested"](spark, SF_SMALL)) and \
        "try_variant_get" not in final_plan(E.queries()["load_nested"](spark, SF_SMALL))


def test_a_turn_logged_twice_is_answered_twice(spark, tmp_path):
    """Documents with one id make a run's turns twice: each reply then lists each hit twice."""
    import os
    os.makedirs(tmp_path / "sf", exist_ok=True)
    for t in os.listdir(SF_SMALL):
        if t != "documents.parquet":
            os.symlink(f"{SF_SMALL}/{t}", tmp_path / "sf" / t)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    docs.unionByName(docs.where("doc_id < 40")).write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    rows = E.queries()["tool_reply"](spark, str(tmp_path / "sf")).where("role = 'tool'").collect()
    times = {}
    for r in rows:
        times.setdefault((r.trajectory_id, r.turn), []).append(r.content_md5)
    assert any(len(v) > 1 for v in times.values())
