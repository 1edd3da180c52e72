"""Operators 9 and 10: URL filter and quality classifier."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactum.llm import ordinal, url_bloom

from .helpers import by_row, documents, prose

PAGES = "page_id bigint, url string, canon string, verdict string, block bigint"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "c", "v", 1) for i, u in rows], PAGES)


def test_urls(spark):
    rows = [
        (1, None), (2, ""), (3, "no scheme.org/x"), (4, "http://EXAMPLE.org/es/A?q#f"), (5, "https://a.example.org/en/12"),
        (6, "https://example.org/en/2"), (7, "http://x.com/fr/1"), (8, "http://x.com/de/1"), (9, "http://x.com"),
        (10, "http://notexample.org/es/"), (11, "http://www.spam.net/a/index.html?x=1"), (12, "https://SPAM.net/a/#y"),
        (13, "http://ok.net/a"), (13, "http://ok.net/a"), (None, "http://spam.net/a"), (14, "a://b://c.com/de/"),
        (15, "http://com/de/x"), (16, "http://spam.net/é\n漢.html"), (17, "http:///de/"), (18, "http://ÄB.com/de/"),
    ]
    listed = spark.createDataFrame([("spam.net/a",), ("spam.net/a",), (None,), ("x.com/fr/1",)], "canon string")
    got = {(r.page_id, r.host): r for r in url_bloom.filter_urls(pages(spark, rows), listed).collect()}
    seen = lambda i, h: (got[i, h].path, got[i, h].rule, got[i, h].verdict, got[i, h].listed)
    for i in (1, 2, 3):
        assert seen(i, "") == ("", None, "allow", False)
    assert seen(4, "example.org") == ("/es/A", "example.org/es/", "block", False)
    assert seen(5, "a.example.org") == ("/en/12", "example.org/en/1", "block", False)
    assert seen(6, "example.org") == ("/en/2", "org/", "allow", False)
    assert seen(7, "x.com") == ("/fr/1", "com/fr/", "allow", True)  # a rule overrides the list
    assert seen(8, "x.com") == ("/de/1", "com/de/", "block", False)
    assert seen(9, "x.com") == ("", None, "allow", False)
    assert seen(10, "notexample.org") == ("/es/", "org/", "allow", False)
    assert seen(11, "www.spam.net")[2:] == ("block", True) and seen(12, "spam.net")[2:] == ("block", True)
    assert seen(13, "ok.net")[2:] == ("allow", False) and seen(None, "spam.net")[2:] == ("block", True)
    assert seen(14, "b:") == ("//c.com/de/", None, "allow", False)
    assert seen(15, "com") == ("/de/x", "com/de/", "block", False)
    assert seen(16, "spam.net") == ("/é\n漢.html", None, "allow", False)
    assert seen(17, "") == ("/de/", None, "allow", False)
    assert seen(18, "Äb.com")[1] == "com/de/"
    assert url_bloom.filter_urls(pages(spark, rows), listed).count() == len(rows)


def test_bloom_has_no_false_negatives_and_exact_join_no_false_positives(spark):
    urls = [(i, f"http://h{i % 97}.net/p/{i}") for i in range(3000)]
    listed = url_bloom.listed_urls(pages(spark, urls[:1000]), host_pattern=".")
    got = url_bloom.filter_urls(pages(spark, urls), listed, rules=[])
    assert got.where("listed AND NOT maybe_listed").count() == 0
    assert sorted(r.page_id for r in got.where("verdict = 'block'").collect()) == list(range(1000))
    assert got.where("maybe_listed AND NOT listed").count() < 40  # 16 bits a key


def test_empty_url_tables(spark):
    none = spark.createDataFrame([], "canon string")
    assert url_bloom.filter_urls(pages(spark, []), none).count() == 0
    assert by_row(url_bloom.filter_urls(pages(spark, [(1, "http://a.net/x")]), none), "verdict") == [("allow",)]


# --- quality classifier ----------------------------------------------------------------------------

def graded(n, seed):
    """(doc_id, text, grade): a marker word lowers the grade, more of another raises it."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        grade = rng.choice([0, 1, 1, 2, 2, 2])
        words = prose(rng, rng.randint(20, 80)).split()
        words += {0: [rng.choice(["vilefoo", "vilebar", "vilebaz"])] * 2, 1: ["||", "||"], 2: []}[grade]
        rng.shuffle(words)
        out.append((i, " ".join(words), grade))
    return out


LABELS = "doc_id bigint, grade int, text string"


def test_held_out_accuracy_and_probabilities(spark):
    rows = graded(900, 1)
    docs = documents(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, g, "clash") for i, _, g in rows[:600]], LABELS)
    got = {r.doc_id: r for r in ordinal.quality_classifier(docs, labels, F.col("grade")).collect()}
    assert all(0 <= r.p_tail <= 1 and 0 <= r.expected_grade <= 2 and r.kept == (r.p_tail >= ordinal.MIN_TAIL)
               for r in got.values())
    held = rows[600:]
    assert np.mean([got[i].kept == (g == 2) for i, _, g in held]) > 0.9
    mean = [np.mean([got[i].expected_grade for i, _, g in held if g == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2]


def test_classifier_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "plain words here"), (3, "plain words here"), (None, "x " * 9), (4, "long " * 50_000)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(None, 1, ""), (1, None, ""), (99, 2, "")], LABELS)
    got = ordinal.quality_classifier(docs, labels, F.col("grade"), carry=True)
    assert got.count() == len(rows) and got.where("NOT kept OR p_tail <> 1").count() == 0
    assert got.select("row.*").columns == docs.columns
    one = spark.createDataFrame([(3, 2, ""), (4, 2, "")], LABELS)
    assert ordinal.quality_classifier(docs, one, F.col("grade")).where("NOT kept").count() == 0
    empty = documents(spark, [])
    assert ordinal.quality_classifier(empty, labels, F.col("grade")).count() == 0


def test_sample_is_bounded_and_lowest_label_counts(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(400)])
    labels = spark.createDataFrame([(i, g, "") for i in range(400) for g in (2, i % 2)], LABELS)
    got = ordinal.training_sample(docs, labels, F.col("grade"), max_train=100).collect()
    assert 40 < len(got) <= 200 and all(r.grade == r.doc_id % 2 for r in got)


def test_gradient_of_the_likelihood():
    """Thresholds stay ordered and the fit lowers the loss against the null model."""
    rows = graded(300, 2)
    hasher = ordinal.Hasher(1 << 12)
    feats = [ordinal.features(t, hasher) for _, t, _ in rows]
    y = np.array([g for _, _, g in rows])
    w, theta = ordinal.fit(np.concatenate([[0], np.cumsum([len(k) for k, _ in feats])]), np.concatenate([k for k, _ in feats]),
                           np.concatenate([v for _, v in feats]), y, 3, 1 << 12)
    assert (np.diff(theta) > 0).all()
    p = ordinal.grade_probabilities(np.array([w[k] @ v for k, v in feats]), theta)
    assert np.allclose(p.sum(axis=1), 1)
    null = np.bincount(y) / len(y)
    assert -np.log(p[np.arange(len(y)), y]).mean() < 0.5 * -(null * np.log(null)).sum()


@pytest.mark.parametrize("text", ["", "   ", "a", "A A A", "漢字 漢字", "!!! ???"])
def test_features_of_odd_texts(text):
    k, v = ordinal.features(text, ordinal.Hasher(1 << 16))
    assert len(k) == len(v) == len(set(k.tolist())) and (len(k) == 0) == (re.search(r"\S", text) is None)


def test_training_rows_are_bounded_for_a_hot_id(spark):
    from pyspark.sql import functions as F

    from pactum.llm import ordinal
    docs = spark.range(3000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "doc_id bigint, quality int")
    rows = ordinal.training_sample(docs, labels, F.col("quality"), max_train=100).collect()
    assert sorted((r.doc_id, r.grade) for r in rows) == [(0, 0), (1, 1), (2, 1)]
