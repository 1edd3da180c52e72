"""The index after a change feed equals a full rebuild; batches are idempotent."""

import tempfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pactum.operators import textindex as ti
from pactum.streaming.index_upkeep import IndexStore, run_upkeep


CONTRACTS = "contract_id BIGINT, title STRING, full_text STRING"
CHANGES = "contract_id BIGINT, version BIGINT, op STRING, title STRING, full_text STRING"


def new_store(spark, rows):
    store = IndexStore(spark, tempfile.mkdtemp(prefix="pactum-idx-") + "/root")
    store.build(spark.createDataFrame(rows, CONTRACTS))
    return store


def feed_of(spark, rows):
    path = tempfile.mkdtemp(prefix="pactum-feed-") + "/f"
    spark.createDataFrame(rows, CHANGES).write.parquet(path)
    return path


def assert_equals_rebuild(spark, store, rows):
    final = spark.createDataFrame(rows, CONTRACTS)
    cols = ["contract_id", "col", "pos", "token"]
    assert sorted(map(tuple, store.read("postings").select(*cols).collect())) == \
        sorted(map(tuple, ti.postings(final).select(*cols).collect()))
    assert sorted(map(tuple, store.read("contracts").select("contract_id", "title", "full_text").collect())) == sorted(rows)
    assert sorted(map(tuple, store.read("doc_stats").select("contract_id", "doc_len").collect())) == \
        sorted(map(tuple, ti.doc_stats(final).collect()))


BASE = [(i, f"t{i}", f"text number {i} alpha") for i in range(1, 21)]


def test_upkeep_equals_rebuild(spark):
    store = new_store(spark, BASE)
    changes = [(3, 5, "upsert", "t3", "changed beta"), (4, 5, "delete", None, None), (25, 5, "upsert", "t25", "new gamma"),
               (3, 2, "upsert", "t3", "stale older version")]
    run_upkeep(spark, store, feed_of(spark, changes), tempfile.mkdtemp(prefix="pactum-ck-"))
    final = [r for r in BASE if r[0] not in (3, 4)] + [(3, "t3", "changed beta"), (25, "t25", "new gamma")]
    assert_equals_rebuild(spark, store, final)
    # a late change with an older version stays hidden
    store.apply_changes(spark.createDataFrame([(25, 1, "upsert", "t25", "late")], CHANGES), 0, "other")
    assert_equals_rebuild(spark, store, final)
    new = store.compact(tempfile.mkdtemp(prefix="pactum-idx-") + "/new")
    assert_equals_rebuild(spark, new, final)


def test_second_feed_with_a_new_checkpoint_is_not_lost(spark):
    store = new_store(spark, BASE)
    run_upkeep(spark, store, feed_of(spark, [(2, 1, "upsert", "t2", "two")]), tempfile.mkdtemp(prefix="pactum-ck-"))
    run_upkeep(spark, store, feed_of(spark, [(3, 1, "upsert", "t3", "three"), (2, 2, "delete", None, None)]),
               tempfile.mkdtemp(prefix="pactum-ck-"))
    assert_equals_rebuild(spark, store, [r for r in BASE if r[0] not in (2, 3)] + [(3, "t3", "three")])


def test_replayed_batch_replaces_itself(spark):
    store = new_store(spark, BASE)
    changes = spark.createDataFrame([(2, 1, "upsert", "t2", "two two"), (3, 1, "delete", None, None)], CHANGES)
    for _ in range(2):
        store.apply_changes(changes, 7, "run")
    assert_equals_rebuild(spark, store, [r for r in BASE if r[0] not in (2, 3)] + [(2, "t2", "two two")])


def test_build_refuses_a_used_root(spark):
    store = new_store(spark, BASE[:2])
    with pytest.raises(AnalysisException):
        store.build(spark.createDataFrame(BASE[:1], CONTRACTS))


def test_write_index_layout_skips_by_token(spark, tmp_path):
    base = spark.createDataFrame([(i, f"t{i}", f"alpha beta w{i} gamma") for i in range(1, 41)],
                                 "contract_id BIGINT, title STRING, full_text STRING")
    path = str(tmp_path / "idx")
    ti.write_index(base, path, buckets=4)
    post = spark.read.parquet(f"{path}/postings")
    assert post.count() == ti.postings(base).count()
    q = post.filter((F.col("bucket") == 1) & (F.col("token") == "w7"))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "EqualTo(token,w7)" in plan


def test_restart_resumes_without_reprocessing(spark):
    store = new_store(spark, [(1, "t1", "one")])
    feed, ck = feed_of(spark, [(2, 1, "upsert", "t2", "two")]), tempfile.mkdtemp(prefix="pactum-ck-")
    run_upkeep(spark, store, feed, ck)
    run_upkeep(spark, store, feed, ck)            # same checkpoint: nothing new
    assert_equals_rebuild(spark, store, [(1, "t1", "one"), (2, "t2", "two")])
    spark.createDataFrame([(1, 2, "delete", None, None)], CHANGES).write.mode("append").parquet(feed)
    run_upkeep(spark, store, feed, ck)            # resumes with the new file only
    assert_equals_rebuild(spark, store, [(2, "t2", "two")])


def test_search_on_stored_index_pushes_token_filter(spark, tmp_path):
    from pactum.operators import search as S
    base = spark.createDataFrame([(i, f"t{i}", f"alpha beta w{i} gamma") for i in range(1, 41)],
                                 "contract_id BIGINT, title STRING, full_text STRING")
    path = str(tmp_path / "idx")
    ti.write_index(base, path, buckets=4)
    post = spark.read.parquet(f"{path}/postings")
    stats = spark.read.parquet(f"{path}/doc_stats")
    q = spark.createDataFrame([(1, ["w7"], 10)], "query_id BIGINT, keywords ARRAY<STRING>, max_results INT")
    res = S.search(q, post, stats, base)
    assert [r["contract_id"] for r in res.collect()] == [7]
    plan = res._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(token), EqualTo(token,w7)]" in plan or "In(token" in plan




def test_equal_late_and_missing_versions(spark, tmp_path):
    """Of equal versions the later feed, file and row win, whatever the feeds are called; a change
    without a version is refused."""
    store = IndexStore(spark, str(tmp_path / "index"))
    store.build(spark.createDataFrame([(1, "t", "old"), (2, "t", "old")], "contract_id BIGINT, title STRING, full_text STRING"))

    def feed(name, rows):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(str(tmp_path / name))
        run_upkeep(spark, store, str(tmp_path / name), str(tmp_path / f"{name}-ckpt"))

    feed("zz", [(1, 5, "upsert", "t", "first"), (3, 1, "upsert", "t", "one"), (3, 1, "upsert", "t", "two"), (2, 0, "upsert", "t", "same")])
    feed("aa", [(1, 5, "upsert", "t", "second"), (2, None, "upsert", "t", "lost"), (None, 1, "upsert", "t", "nobody")])
    feed("mm", [(1, 4, "upsert", "t", "late")])
    got = {r.contract_id: r.full_text for r in store.read("contracts").collect()}
    assert got == {1: "second", 2: "same", 3: "two"}
    refused = spark.read.schema(CHANGES).parquet(f"{store.root}/rejects")
    assert sorted((r.contract_id or 0, r.full_text) for r in refused.collect()) == [(0, "nobody"), (2, "lost")]
    run_upkeep(spark, store, str(tmp_path / "aa"), str(tmp_path / "aa-ckpt"))  # nothing new: the same run, no change
    assert {r.contract_id: r.full_text for r in store.read("contracts").collect()} == got
