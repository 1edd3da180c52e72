"""Golden rows of FIXTURES.md section 4 (BM25 ranking and snippets)."""

import pytest

from pactum.operators import search as S
from pactum.operators import textindex as ti

CORPUS = [
    (1, "Café lease agreement", "governing law of the state. the law is governing. Law!"),
    (2, "Governing memo", "law firm notes about dogs and cats"),
    (3, "Supply", "governing law governing law clause one two three four five six seven eight nine "
                  "ten eleven twelve thirteen governing law fourteen"),
    (4, "Other", "nothing here at all"),
    (5, "Other2", "plain text row"),
    (6, "o3", "zzz"),
]

EXPECTED = {
    ("governing law",): [(1, -0.7231539039466844), (3, -0.7105113531783859)],
    ("governing", "law"): [(1, -2.67249303616947e-06), (3, -2.41758241758242e-06), (2, -2.01498751041e-06)],
    ("law", "law"): [(1, -2.8843861740167e-06), (3, -2.41758241758242e-06), (2, -2.01498751041e-06)],
    ("", "law"): [(1, -1.4421930870083e-06), (3, -1.20879120879121e-06), (2, -1.00749375520e-06)],
    ("LAW.",): [(1, -1.4421930870083e-06), (3, -1.20879120879121e-06), (2, -1.00749375520e-06)],
    ("cafe",): [(1, -1.1094794712756642)],
    ("other",): [(4, -1.5960735135001176)],
    ("memo", "dogs"): [(2, -2.6180389855081034)],
    ("lease governing",): [],
    ("agreement governing",): [],
    ("o",): [],
    ("!!!",): [],
    ("",): [],
    (): [],
}


@pytest.fixture(scope="module")
def index(spark):
    c = spark.createDataFrame(CORPUS, "contract_id BIGINT, title STRING, full_text STRING")
    return c, ti.postings(c), ti.doc_stats(c)


@pytest.fixture(scope="module")
def results(spark, index):
    c, post, stats = index
    keys = list(EXPECTED)
    q = spark.createDataFrame([(i, list(k), 10) for i, k in enumerate(keys)],
                              "query_id BIGINT, keywords ARRAY<STRING>, max_results INT")
    rows = S.search_with_snippets(q, post, stats, c).collect()
    out = {k: [] for k in keys}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out[keys[r["query_id"]]].append(r)
    return out


@pytest.mark.parametrize("keywords", list(EXPECTED))
def test_bm25_golden(results, keywords):
    got = results[keywords]
    exp = EXPECTED[keywords]
    assert [r["contract_id"] for r in got] == [e[0] for e in exp]
    for r, (_, score) in zip(got, exp):
        assert r["score"] == pytest.approx(score, abs=2e-12)


def test_snippets(results):
    first = {r["contract_id"]: r["snippet"] for r in results[("governing law",)]}
    assert first[1] == "<b>governing law</b> of the state. the law is <b>governing. Law</b>!"
    assert first[3].startswith("<b>governing law</b> <b>governing law</b> clause one")
    assert first[3].endswith(" ten ... ")
    assert results[("cafe",)][0]["snippet"] == "<b>Café</b> lease agreement"
    assert results[("memo", "dogs")][0]["snippet"] == "Governing <b>memo</b>"


def test_max_results_clamp(spark, index):
    c, post, stats = index
    q = spark.createDataFrame([(1, ["law"], 2), (2, ["law"], 0), (3, ["law"], 50)],
                              "query_id BIGINT, keywords ARRAY<STRING>, max_results INT")
    n = {r["query_id"]: r["count"] for r in S.search(q, post, stats, c).groupBy("query_id").count().collect()}
    assert n == {1: 2, 2: 3, 3: 3}
