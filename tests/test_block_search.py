"""Search over the block index: golden rows, skipped blocks, snippets, equality with the search over postings."""

import random

import pytest

from pactum.operators import blockindex, blocksearch
from pactum.operators import search as S
from pactum.operators import textindex as ti

from .test_search_golden import CORPUS, EXPECTED

CONTRACTS = "contract_id BIGINT, title STRING, full_text STRING"
QUERIES = "query_id BIGINT, keywords ARRAY<STRING>, max_results INT"


def built(spark, tmp_path_factory, rows):
    c = spark.createDataFrame(rows, CONTRACTS)
    path = str(tmp_path_factory.mktemp("blocks"))
    blockindex.build_block_index(c, path)
    return c, blockindex.BlockIndex(spark, path)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.fixture(scope="module")
def golden(spark, tmp_path_factory):
    return built(spark, tmp_path_factory, CORPUS)


def test_golden_rows(spark, golden):
    c, index = golden
    keys = list(EXPECTED)
    q = spark.createDataFrame([(i, list(k), 10) for i, k in enumerate(keys)], QUERIES)
    got = blocksearch.search_with_snippets(index, q).collect()
    for i, k in enumerate(keys):
        mine = sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])
        assert [r.contract_id for r in mine] == [e[0] for e in EXPECTED[k]]
        for r, (_, score) in zip(mine, EXPECTED[k]):
            assert r.score == pytest.approx(score, rel=1e-5)
    old = S.search_with_snippets(q, ti.postings(c), ti.doc_stats(c), c)
    assert rows_of(blocksearch.search_with_snippets(index, q)) == rows_of(old)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Frequent words in texts of very different lengths, NULL and empty columns, ids apart; some blocks are full of them."""
    rng, rows = random.Random(6), []
    for i in range(2200):
        often = 40 if (i * 3 + 1 >> 6) % 10 == 0 else 1
        words = rng.choices(["the", "law", "of", "Café", "lease", "rare", "a1"], [often, often, often, 9, 20, 0.2, 50], k=rng.choice([3, 8, 60, 200]))
        text = rng.choice([" ", ", ", ".\n"]).join(words)
        rows.append((i * 3 + 1, None if i % 97 == 0 else f"Title {i} of the", "" if i % 89 == 0 else f"...{text}!" if i % 2 else text))
    rows += [(50_000, "", None), (50_001, "the " * 300, "law " * 2000)]
    return built(spark, tmp_path_factory, rows)


BATCH = [(1, ["the"], 10), (2, ["law"], 3), (3, ["the", "law", "of"], 10), (4, ["the law", "of"], 10), (5, ["law law law"], 10),
         (6, ["rare", "cafe"], 10), (7, ["of the"], 0), (8, ["missing", "the"], 10), (9, ["the", "the"], 99), (10, ["the"], 2),
         (11, ["cafe lease the"], 10), (12, [], 10), (13, None, 10)]


def test_same_hits_and_snippets_as_over_postings(spark, corpus):
    c, index = corpus
    q = spark.createDataFrame(BATCH, QUERIES)
    old = S.search_with_snippets(q, ti.postings(c), ti.doc_stats(c), c)
    got = rows_of(blocksearch.search_with_snippets(index, q))
    assert got == rows_of(old) and len(got) > 80
    assert rows_of(blocksearch.search(index, q)) == [r[:5] for r in got]


def test_blocks_are_skipped(spark, corpus):
    _, index = corpus
    lists = spark.createDataFrame([("the", ["the"]), ("law", ["law"]), ("both", ["the law", "of"])], "query_id STRING, keywords ARRAY<STRING>")
    report = blocksearch.rank_lists(index, lists).blocks
    by_list = {r.list_key: r for r in report.groupBy("list_key").agg({"*": "count", "bound": "max"}).collect()}
    scored = {r.list_key: r["count"] for r in report.where("scored").groupBy("list_key").count().collect()}
    for name in ("the", "law", "both"):
        assert by_list[name]["count(1)"] > 20
    skipped = {name: 1 - scored[name] / by_list[name]["count(1)"] for name in scored}
    assert min(skipped.values()) > 0.1 and max(skipped.values()) > 0.4, skipped  # and the hits are the same, see above


def test_one_row_per_token_and_block(spark, corpus):
    _, index = corpus
    blocks = index.table("blocks")
    assert blocks.count() == blocks.select("token", "block").distinct().count()
    assert blocks.where("size(ids) > 64 OR size(ids) <> n OR size(ids) <> size(tfs)").count() == 0
    plan = blocksearch.search(index, spark.createDataFrame(BATCH, QUERIES))._jdf.queryExecution().toString()
    assert "Generate posexplode" not in plan


def test_empty_corpus(spark, tmp_path_factory):
    _, index = built(spark, tmp_path_factory, [])
    assert blocksearch.search(index, spark.createDataFrame(BATCH, QUERIES)).count() == 0
