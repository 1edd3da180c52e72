"""The three preparation steps end to end on a small raw file."""

import json

from pactum.plans import build as steps


def test_convert_build_scenarios(spark, tmp_path):
    raw = {"version": "v", "data": [
        {"title": f"c{i}", "paragraphs": [
            {"context": f"Alpha clause {i}. Beta part.", "qas": [
                {"id": f"q{i}", "question": "Governing Law",
                 "answers": [{"text": f"clause {i}", "answer_start": 6}], "is_impossible": False}]},
            {"context": "Second paragraph.", "qas": []}]}
        for i in range(12)] + [{"title": "empty", "paragraphs": []}, {"paragraphs": [{"context": "x"}]}]}
    src = tmp_path / "raw"
    src.mkdir()
    (src / "data.json").write_text(json.dumps(raw))
    counts = steps.convert(spark, str(src), str(tmp_path / "conv"), max_contracts=13)
    assert counts == {"ok": 12, "dropped": 1}
    assert steps.build(spark, str(tmp_path / "conv/processed"), str(tmp_path / "db")) == {"skipped": False}
    assert steps.build(spark, str(tmp_path / "conv/processed"), str(tmp_path / "db")) == {"skipped": True}
    con = spark.read.parquet(str(tmp_path / "db/tables/contracts"))
    assert sorted(r["id"] for r in con.collect()) == list(range(1, 13))
    ann = spark.read.parquet(str(tmp_path / "db/tables/annotations")).collect()
    full = {r["id"]: r["full_text"] for r in con.collect()}
    assert all(full[a["contract_id"]][a["start_char"]:a["end_char"]] == a["text"] for a in ann)
    post = spark.read.parquet(str(tmp_path / "db/index/postings"))
    assert post.filter("token = 'alpha'").count() == 12
    steps.scenarios(spark, str(tmp_path / "db/tables"), str(tmp_path / "scen"))
    s = spark.read.parquet(str(tmp_path / "scen"))
    by = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert by == {"train": 9, "test": 3}


def test_score_runs(spark, tmp_path):
    from pactum.plans import common as C
    turns, scen, ids, replies = C.run_inputs(spark, "/root/testdata/sf0.001")
    turns.drop("k").write.parquet(str(tmp_path / "turns"))
    scen.write.parquet(str(tmp_path / "scen"))
    ids.select(ids.contract_id.alias("id")).write.parquet(str(tmp_path / "tables/contracts"))
    replies.write.parquet(str(tmp_path / "replies"))
    steps.score_runs(spark, str(tmp_path / "turns"), str(tmp_path / "scen"), str(tmp_path / "tables"),
                     str(tmp_path / "out"), str(tmp_path / "replies"))
    means = spark.read.parquet(str(tmp_path / "out/means")).first()
    direct = C.rubric(spark, "/root/testdata/sf0.001").filter("status = 'valid'").count()
    assert means["n_trajectories"] == direct
