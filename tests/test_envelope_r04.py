"""Small splits of an envelope share tasks."""

import json

from pactum.sources import envelope as ev


def test_small_splits_share_tasks(spark, tmp_path):
    """a task for each split of 1,000 bytes before."""
    data = [{"title": f"t{i}", "paragraphs": [{"context": "}" * (i % 40), "qas": []}]} for i in range(3000)]
    (tmp_path / "one.json").write_text(json.dumps({"version": "v", "data": data}))
    total = (tmp_path / "one.json").stat().st_size
    with ev.splits_of(spark, 1_000):
        alone = ev.fragments(spark, str(tmp_path), 0)
        n, splits = alone.rdd.getNumPartitions(), alone.select("split").distinct().count()
    with ev.splits_of(spark, 1_000, total):
        shared = ev.fragments(spark, str(tmp_path), 0)
        assert n > 100 and shared.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism * 5
        assert shared.select("split").distinct().count() == splits
