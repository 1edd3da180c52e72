"""The pipeline against brute-force versions of its deterministic stages."""

import random

import corpus_pipeline as P
from pactum.llm import ordinal

from ..conftest import SF_SMALL
from .helpers import awkward_texts, documents, prose
from .test_dedup_operators import brute_jaccard, brute_suffix
from .test_text_operators import check_packing, reference_ids


def stage(name):
    return dict(P.STAGES)[name]


def texts(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


def test_stage_names_and_order():
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "quality_rules", "jaccard_join", "suffix_array_dedup",
                                        "best_fit_packing"]


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    now = docs
    for name, f in P.STAGES[:4]:
        before, now = now, f(spark, now, SF_SMALL)
        assert now.columns == docs.columns and now.schema == docs.schema, name
        rows = [(r.doc_id, r.text) for r in before.collect()]
        if name == "quality_classifier":
            labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
            kept = {r.doc_id for r in ordinal.quality_classifier(before, labels).where("kept").collect()}
            assert texts(now) == sorted(((i, t) for i, t in rows if i in kept), key=str)
        if name == "jaccard_join":
            stay = {i for i, _, c in brute_jaccard(rows) if i == c}
            assert texts(now) == sorted(((i, t) for i, t in rows if i in stay), key=str)
        if name == "suffix_array_dedup":
            size = {i: len(t.encode()) for i, t in texts(now)}
            want = {i: (n, gone, cut) for i, n, gone, cut, _ in brute_suffix(rows)}
            assert set(size) == {i for i, (n, gone, _) in want.items() if gone < n or n == 0}
            # a span may cut a character in two at either end
            assert all(0 <= want[i][0] - want[i][1] - size[i] <= 6 * want[i][2] for i in size)
        assert all(r.n_chars == len(r.text) for r in now.collect()), name
    got = P.run(spark, SF_SMALL).collect()
    check_packing(got, reference_ids([t for _, t in texts(now)]), 4096)
    assert {r.doc_id for r in got} == {i for i, _ in texts(now)}


def test_stages_on_awkward_rows(spark):
    docs = documents(spark)
    rules = stage("quality_rules")(spark, docs, SF_SMALL)
    assert rules.schema == docs.schema
    one = stage("jaccard_join")(spark, docs, SF_SMALL)
    assert one.schema == docs.schema
    cut = stage("suffix_array_dedup")(spark, one, SF_SMALL)
    assert cut.schema == docs.schema and cut.count() <= one.count()
    assert stage("best_fit_packing")(spark, cut, SF_SMALL).count() >= cut.count()
    empty = documents(spark, [])
    for name, f in P.STAGES:
        assert f(spark, empty, SF_SMALL).count() == 0, name


def test_planted_cases(spark):
    """Copies, near copies and shared passages are caught, clean documents stay whole."""
    rng = random.Random(11)
    clean = [(i, prose(rng, 150)) for i in range(20)]
    passage = prose(rng, 80)
    near = clean[0][1].split(" ")
    near[60] = "other"
    rows = clean + [(100, clean[1][1]), (101, " ".join(near)), (102, prose(rng, 90) + "\n" + passage),
                    (103, passage + "\n" + prose(rng, 90))]
    kept = stage("jaccard_join")(spark, stage("quality_rules")(spark, documents(spark, rows), SF_SMALL), SF_SMALL)
    assert {i for i, _ in texts(kept)} == {i for i, _ in rows} - {100, 101}
    cut = dict(texts(stage("suffix_array_dedup")(spark, kept, SF_SMALL)))
    assert all(cut[i] == t for i, t in clean) and passage in cut[102] and passage not in cut[103]


def test_awkward_table_has_the_awkward_cases():
    ids = [i for i, _ in awkward_texts()]
    assert None in ids and len(ids) > len(set(ids))
