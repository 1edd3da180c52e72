"""Ranks by hash and exact selection of the smallest values."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pactum.operators import ids


@pytest.mark.parametrize("n", [0, 1, 7, 500, 4999, 5000, 9000])
def test_smallest_holds_the_n_smallest(spark, n):
    rng = random.Random(1)
    values = [rng.choice([-2 ** 62, 0, 5, 2 ** 62]) + rng.randrange(10 ** rng.randint(1, 15)) for _ in range(5000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "id bigint, v bigint").repartition(4)
    got = sorted(r.v for r in ids.smallest(df, F.col("v"), n, spare=10).collect())
    want = sorted(values)
    assert got[:n] == want[:n] and got == want[: len(got)]
    if 0 < n < 5000:
        assert n <= len(got) <= 2 * max(n, 10) + want.count(got[-1])
    if n >= 5000:
        assert len(got) == 5000


def test_smallest_of_one_value_and_of_none(spark):
    same = spark.range(300).select(F.lit(7).cast("bigint").alias("v"))
    assert ids.smallest(same, F.col("v"), 5, spare=1).count() == 300  # ties are not told apart
    assert ids.smallest(same.where("v < 0"), F.col("v"), 5).count() == 0
    assert ids.smallest(same.where("v < 0"), F.col("v"), 5, 0, 99).count() == 0


def test_hash_rank_follows_the_hash(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"))
    got = ids.hash_rank(df, "k", 42, group_cols=["g"], total_col="n").collect()
    for g in range(3):
        order = sorted((r for r in got if r.g == g), key=lambda r: r["rank"])
        want = sorted((k for k in range(1000) if k % 3 == g), key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest())
        assert [r.k for r in order] == want and [r["rank"] for r in order] == list(range(1, len(want) + 1))
        assert {r.n for r in order} == {len(want)}
    alone = {r.k: r["rank"] for r in ids.hash_rank(df, "k", 7).collect()}
    assert sorted(alone, key=alone.get) == sorted(range(1000), key=lambda k: hashlib.md5(f"7:{k}".encode()).hexdigest())
