"""Sizes of what Python workers get at once."""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from pactum.llm import common, jaccard, packing, suffix_dedup, viterbi


def rows_at_once(docs, **options):
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType())]
    got = common.map_rows(docs, {"doc_id": F.col("doc_id"), "text": F.col("text")}, fields,
                          lambda: lambda batch: {"n": [batch.num_rows] * batch.num_rows}, **options)
    return max(r.n for r in got.collect())


def test_words_of_equal_length_come_in_large_blocks(spark, monkeypatch):
    """op7_viterbi: half a MiB at once left few words of a length to advance together."""
    docs = spark.range(20, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x "), 50_000).alias("text"))
    assert rows_at_once(docs) == 5 and rows_at_once(docs, limit=common.WORD_BYTES) == 20
    seen = []
    monkeypatch.setattr(viterbi, "map_rows", lambda *a: seen.append(a[-1]))
    viterbi.encode(docs)
    assert seen == [common.WORD_BYTES]


def test_pipeline_hands_on_small_batches(spark):
    docs = spark.range(2_500, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    before = spark.conf.get(corpus_pipeline.BATCH_KEY)
    with corpus_pipeline.small_batches(spark):
        assert rows_at_once(docs) == corpus_pipeline.BATCH_ROWS
    assert spark.conf.get(corpus_pipeline.BATCH_KEY) == before


def test_a_stage_by_itself_bounds_the_bytes_of_a_batch(spark, monkeypatch):
    """The frame of a stage is run by whoever writes it, not inside ``run``."""
    docs = spark.range(400, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20_000).alias("text"))
    monkeypatch.setattr(corpus_pipeline.line_rules, "quality_rules", lambda docs, carry: common.map_rows(
        docs, {"text": F.col("text")}, [T.StructField("n", T.LongType()), T.StructField("clean_text", T.StringType()),
                                        T.StructField("kept", T.BooleanType())],
        lambda: lambda part: {"n": [part.num_rows] * part.num_rows, "clean_text": [str(part.num_rows)] * part.num_rows,
                              "kept": [True] * part.num_rows}, carry, 1 << 30))
    before = spark.conf.get(common.BYTES_KEY, None)
    spark.conf.unset(common.BYTES_KEY)
    try:
        seen = [int(r.text) for r in corpus_pipeline.quality_rules(spark, docs, "").collect()]
        # A row's text goes twice, alone and in its row.
        assert len(seen) == 400 and max(seen) * 2 * 100_000 <= common.BATCH_BYTES + 2 * 100_000
    finally:
        spark.conf.unset(common.BYTES_KEY) if before is None else spark.conf.set(common.BYTES_KEY, before)


def test_jaccard_and_run_bound_batches_and_put_the_bound_back(spark, monkeypatch):
    before = spark.conf.get(common.BYTES_KEY, None)
    spark.conf.unset(common.BYTES_KEY)
    try:
        seen = []
        monkeypatch.setattr(jaccard, "_connect", lambda docs: seen.append(spark.conf.get(common.BYTES_KEY)))
        jaccard._linked_classes(spark.range(1))
        with corpus_pipeline.small_batches(spark):
            corpus_pipeline.bound_batches(spark)
            seen.append(spark.conf.get(common.BYTES_KEY))
        assert seen == [str(common.BATCH_BYTES)] * 2 and spark.conf.get(common.BYTES_KEY, None) is None
        spark.conf.set(common.BYTES_KEY, "1m")  # a bound of the session's own stays
        with common.bounded_batches(spark):
            assert spark.conf.get(common.BYTES_KEY) == "1m"
        assert spark.conf.get(common.BYTES_KEY) == "1m"
    finally:
        spark.conf.unset(common.BYTES_KEY) if before is None else spark.conf.set(common.BYTES_KEY, before)


def test_frequent_shingles_are_counted_in_place():
    rng = np.random.default_rng(1)
    for n, sets in ((1, 1), (3, 2), (9, 40), (300, 60)):
        held = [np.unique(rng.integers(0, n, n).astype(np.uint64) * np.uint64(1 << 60 | 1)) for _ in range(sets)]
        key, count = np.unique(np.concatenate(held), return_counts=True)
        got = jaccard.frequent(held)
        assert held == [] and (got[0] == key[count >= 4]).all() and (got[1] == count[count >= 4]).all()
        assert len(got[0]) == (count >= 4).sum()


def held_mb():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) / 1024


def test_a_worker_gives_back_what_its_task_has_freed():
    """Arrow's pool kept the most that a task had taken, for as long as the worker lived."""
    def run(batches):
        for batch in batches:
            made = [pa.array([b"x" * 1000] * 1000) for _ in range(150)]
            del made[::2]
            peak.append(held_mb())
            yield batch

    batch, peak = pa.RecordBatch.from_pydict({"n": [1, 2, 3]}), []
    common.give_back()
    before = held_mb()
    assert [b.num_rows for b in common.frugal(run)(iter([batch] * 3))] == [3] * 3
    assert max(peak) > before + 60 and held_mb() < before + 20


def test_a_worker_gives_back_within_a_long_task(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(len(seen)))
    monkeypatch.setattr(common, "GIVE_BACK_BYTES", 2_000)
    batch, seen = pa.RecordBatch.from_pydict({"n": np.arange(125)}), []  # 1,000 bytes
    for b in common.frugal(lambda batches: batches)(iter([batch] * 5)):
        seen.append(b)
    assert calls == [2, 4, 5] and all(b.equals(batch) for b in seen)


def test_all_python_work_of_the_stages_is_frugal(spark, monkeypatch):
    used, kind = [], type(spark.range(0))
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *a, **b: used.append(f.__qualname__) or plain(self, f, *a, **b))
    docs = spark.range(6, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(
        F.repeat(F.lit("some words of one text that are repeated "), 9), (F.col("id") % 2).cast("string")).alias("text"))
    rows_at_once(docs)
    assert jaccard.keep_one(docs).count() == 1
    assert suffix_dedup.cut_documents(docs).count() > 0
    assert packing.pack(docs).count() == 6
    assert len(used) > 8 and set(used) == {"frugal.<locals>.wrapped"}
