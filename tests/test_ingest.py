"""Validation cases of FIXTURES.md section 3 and offsets."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from pactum.operators import flatten as fl
from pactum.sources import nested_json as nj


def qa(i, answers=None, **kw):
    d = {"id": f"q{i}", "question": "Q", "answers": answers if answers is not None else [{"text": "b", "answer_start": 1}]}
    d.update(kw)
    return d


CONTRACTS = [
    {"title": "ok", "paragraphs": [{"context": "abc", "qas": [qa(0)]}, {"context": "de", "qas": [qa(1)]}]},
    {"title": "no paragraphs key"},
    {"title": "empty paragraphs", "paragraphs": []},
    {"title": "null paragraphs", "paragraphs": None},
    {"title": "one para without context", "paragraphs": [{"qas": []}, {"context": "xyz", "qas": []}]},
    {"title": "all paras without context", "paragraphs": [{"qas": []}]},
    {"title": "context null", "paragraphs": [{"context": None, "qas": []}]},
    {"title": "qas null", "paragraphs": [{"context": "a", "qas": None}]},
    {"paragraphs": [{"context": "a", "qas": []}]},
    {"title": "qa cases", "paragraphs": [{"context": "hello world", "qas": [
        {"question": "Q", "answers": []},                                    # no id -> dropped
        {"id": 5, "question": "Q", "answers": []},                           # int id -> dropped
        {"qa_id": "alias", "question": "Q"},                                 # kept, answers []
        {"id": "nullans", "question": "Q", "answers": None},                 # dropped
        {"id": "onebad", "question": "Q", "answers": [{"text": "h", "answer_start": 0}, {"text": "x"}]},
        {"id": "s12", "question": "Q", "answers": [{"text": "a", "answer_start": "12 "}]},
        {"id": "f12", "question": "Q", "answers": [{"text": "a", "answer_start": 12.0}]},
        {"id": "neg", "question": "Q", "answers": [{"text": "a", "answer_start": -3}]},
        {"id": "bool", "question": "Q", "answers": [{"text": "a", "answer_start": True}]},
        {"id": "plus", "question": "Q", "answers": [{"text": "a", "answer_start": "+3"}]},
        {"id": "s120", "question": "Q", "answers": [{"text": "a", "answer_start": "12.0"}]},
        {"id": "f125", "question": "Q", "answers": [{"text": "a", "answer_start": 12.5}]},
        {"id": "nul", "question": "Q", "answers": [{"text": "a", "answer_start": None}]},
        {"id": "e2", "question": "Q", "answers": [{"text": "a", "answer_start": "1e2"}]},
        {"id": "empty", "question": "Q", "answers": [{"text": "a", "answer_start": ""}]},
        {"id": "yes", "question": "Q", "is_impossible": "yes"},
        {"id": "on", "question": "Q", "is_impossible": "on"},
        {"id": "T", "question": "Q", "is_impossible": "T"},
        {"id": "one", "question": "Q", "is_impossible": 1},
        {"id": "maybe", "question": "Q", "is_impossible": "maybe"},
        {"id": "two", "question": "Q", "is_impossible": 2},
        {"id": "impnull", "question": "Q", "is_impossible": None},
    ]}]},
]


@pytest.fixture(scope="module")
def flagged_df(spark):
    d = tempfile.mkdtemp(prefix="pactum-json-")
    with open(os.path.join(d, "raw.json"), "w") as f:
        json.dump({"version": "1", "data": CONTRACTS}, f)
    return nj.validate(nj.read_envelope(spark, d))


@pytest.fixture(scope="module")
def flagged(flagged_df):
    return {r["title"] or f"#{r['contract_seq']}": r for r in flagged_df.collect()}


def test_document_status(flagged):
    st = {k: (r["status"], r["reason"]) for k, r in flagged.items()}
    assert st["ok"] == ("ok", None)
    for k in ("no paragraphs key", "empty paragraphs", "null paragraphs"):
        assert st[k] == ("dropped", "no_paragraphs")
    assert st["one para without context"][0] == "ok"
    assert st["all paras without context"][0] == "ok"
    assert st["context null"] == ("rejected", "bad_paragraph")
    assert st["qas null"] == ("rejected", "bad_paragraph")
    assert st["#8"] == ("rejected", "bad_title")


def test_paragraph_drop(flagged):
    assert [p["context"] for p in flagged["one para without context"]["paragraphs"]] == ["xyz"]
    assert flagged["all paras without context"]["paragraphs"] == []


def test_qa_rules(flagged):
    qas = {q["qa_id"]: q for q in flagged["qa cases"]["paragraphs"][0]["qas"]}
    assert set(qas) == {"alias", "s12", "f12", "neg", "bool", "plus", "s120", "yes", "on", "T", "one"}
    assert qas["alias"]["answers"] == []
    starts = {k: qas[k]["answers"][0]["answer_start"] for k in ("s12", "f12", "neg", "bool", "plus", "s120")}
    assert starts == {"s12": 12, "f12": 12, "neg": -3, "bool": 1, "plus": 3, "s120": 12}
    assert all(qas[k]["is_impossible"] for k in ("yes", "on", "T", "one"))


def test_offsets_and_full_text(flagged_df):
    good = flagged_df.filter(F.col("title") == "ok").select("contract_seq", "title", "paragraphs")
    row = good.select(fl.full_text(F.col("paragraphs")).alias("ft")).first()
    assert row["ft"] == "abc\n\n--- PARAGRAPH BREAK ---\n\nde"
    spans = fl.flat_annotations(good, keep=["contract_seq"], check_text=True).orderBy("para_idx").collect()
    assert [(s["start_char"], s["end_char"]) for s in spans] == [(1, 2), (31, 32)]
    # 'b' sits at 1 of "abc" but position 1 of "de" holds 'e': reported, not filtered
    assert [s["text_matches"] for s in spans] == [True, False]


def test_code_point_length(spark):
    assert spark.sql("select length('a😀b') n").first()["n"] == 3


def test_missing_data_key_fails(spark):
    d = tempfile.mkdtemp(prefix="pactum-json-")
    with open(os.path.join(d, "raw.json"), "w") as f:
        json.dump({"version": "1"}, f)
    with pytest.raises(Exception):
        nj.read_envelope(spark, d).collect()


def test_processed_mode_keeps_empty_and_rejects_bad_qa(spark):
    d = tempfile.mkdtemp(prefix="pactum-json-")
    rows = [{"seq": 0, "title": "a", "paragraphs": []},
            {"seq": 1, "title": "b", "paragraphs": [{"context": "x", "qas": [{"qa_id": 5, "question": "Q"}]}]},
            {"seq": 2, "title": "c", "paragraphs": [{"qas": []}]}]
    with open(os.path.join(d, "p.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows))
    st = {r["title"]: r["status"] for r in nj.validate(nj.read_lines(spark, d), mode="processed").collect()}
    assert st == {"a": "ok", "b": "rejected", "c": "rejected"}


def test_broken_json_fails(spark):
    d = tempfile.mkdtemp(prefix="pactum-json-")
    with open(os.path.join(d, "raw.json"), "w") as f:
        f.write('{"version": "1", "data": [ {"title": "x", ')
    with pytest.raises(Exception):
        nj.read_envelope(spark, d).collect()


def test_negative_max_contracts_rejected(spark):
    d = tempfile.mkdtemp(prefix="pactum-json-")
    with open(os.path.join(d, "raw.json"), "w") as f:
        json.dump({"version": "1", "data": CONTRACTS}, f)
    with pytest.raises(ValueError):
        nj.validate(nj.read_envelope(spark, d), max_contracts=-1)
    first = nj.validate(nj.read_envelope(spark, d), max_contracts=2).collect()
    assert sorted(r["contract_seq"] for r in first) == [0, 1]


def test_paragraph_bases_scan(spark):
    sizes = [0, 1, 2, 3, 7, 64, 65, 1000, 5000]
    rows = [(i, [{"context": "x" * (j % 7), "qas": []} for j in range(n)]) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "seq INT, paragraphs ARRAY<STRUCT<context STRING, qas ARRAY<STRING>>>")
    got = {r["seq"]: r["b"] for r in df.select("seq", fl.paragraph_bases(F.col("paragraphs")).alias("b")).collect()}
    for i, n in enumerate(sizes):
        exp, acc = [], 0
        for j in range(n):
            exp.append(acc)
            acc += (j % 7) + 27
        assert got[i] == exp


def test_validation_without_ansi(spark, flagged_df):
    """Same statuses with ANSI mode off (size(NULL) = -1 there)."""
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        d = tempfile.mkdtemp(prefix="pactum-json-")
        with open(os.path.join(d, "raw.json"), "w") as f:
            json.dump({"version": "1", "data": CONTRACTS}, f)
        st = sorted((r["contract_seq"], r["status"]) for r in nj.validate(nj.read_envelope(spark, d)).collect())
    finally:
        spark.conf.set("spark.sql.ansi.enabled", ansi)
    assert st == sorted((r["contract_seq"], r["status"]) for r in flagged_df.collect())


def envelope(path, name, contracts):
    path.mkdir(exist_ok=True)
    (path / name).write_text(json.dumps({"version": "v", "data": contracts}))


def contract(title, text="Alpha beta."):
    return {"title": title, "paragraphs": [{"context": text, "qas": [qa(title, [{"text": "Alpha", "answer_start": 0}])]}]}


def test_two_files_keep_their_contracts_apart(spark, tmp_path):
    from pactum.plans import build as steps

    for f in ("a", "b"):
        envelope(tmp_path / "raw", f"{f}.json", [contract(f"{f}{i}", f"Alpha {f}{i}.") for i in range(3)])
    assert steps.convert(spark, str(tmp_path / "raw"), str(tmp_path / "conv")) == {"ok": 6}
    steps.build(spark, str(tmp_path / "conv/processed"), str(tmp_path / "db"))
    con = spark.read.parquet(str(tmp_path / "db/tables/contracts"))
    assert {r["id"]: r["title"] for r in con.collect()} == dict(enumerate(["a0", "a1", "a2", "b0", "b1", "b2"], 1))
    ann = spark.read.parquet(str(tmp_path / "db/tables/annotations")).collect()
    assert sorted(r["contract_id"] for r in ann) == [1, 2, 3, 4, 5, 6]
    # the first N in all, not N of each file
    first = nj.validate(nj.read_envelope(spark, str(tmp_path / "raw")), max_contracts=4).collect()
    assert sorted(r["title"] for r in first) == ["a0", "a1", "a2", "b0"]


def test_build_reads_an_envelope_and_redoes_a_lost_index(spark, tmp_path):
    import shutil

    from pactum.plans import build as steps

    envelope(tmp_path / "proc", "p.json", [{"title": "x", "paragraphs": [{"context": "Alpha", "qas": [
        {"qa_id": "q", "question": "Q", "answers": [{"text": "Alpha", "answer_start": 0}], "is_impossible": False}]}]}])
    out = str(tmp_path / "db")
    assert steps.build(spark, str(tmp_path / "proc"), out, envelope=True) == {"skipped": False}
    shutil.rmtree(tmp_path / "db/index")  # as if the index write had failed
    assert steps.build(spark, str(tmp_path / "proc"), out, envelope=True) == {"skipped": True}
    assert spark.read.parquet(f"{out}/index/postings").filter("token = 'alpha'").count() == 1


def test_lines_without_seq_fail(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l/x.json").write_text(json.dumps(contract("t")) + "\n")
    with pytest.raises(Exception, match="seq"):
        nj.read_lines(spark, str(tmp_path / "l")).collect()


def test_data_that_is_no_list_fails(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l/x.json").write_text(json.dumps({"version": "v", "data": {"title": "t"}}))
    with pytest.raises(Exception):
        nj.read_envelope(spark, str(tmp_path / "l")).collect()


def test_rejects_like_the_original(spark, tmp_path):
    para = {"context": "abc", "qas": []}
    cases = {"text para": ["p", para], "number para": [para, 5], "null para": [None], "list para": [[1], para],
             "number qa": [{"context": "abc", "qas": [qa(1), 5]}], "null qa": [{"context": "abc", "qas": [None]}],
             "bool qa": [{"context": "abc", "qas": [True]}], "text qa": [{"context": "abc", "qas": ["id", qa(1)]}],
             "list qa": [{"context": "abc", "qas": [[], qa(1)]}],
             "big": [{"context": "abc", "qas": [qa(1, [{"text": "x", "answer_start": 3_000_000_000}])]}],
             "lax": [{"context": "abc", "qas": [
                 qa("f1", is_impossible=1.0), qa("f0", is_impossible=0.0), qa("f5", is_impossible=0.5),
                 qa("tab", [{"text": "x", "answer_start": "\t12\n"}]), qa("under", [{"text": "x", "answer_start": "1_000"}]),
                 qa("dot", [{"text": "x", "answer_start": "12."}]), qa("twice", [{"text": "x", "answer_start": "1__0"}])]}]}
    envelope(tmp_path / "r", "x.json", [{"title": t, "paragraphs": p} for t, p in cases.items()])
    got = {r["title"]: r for r in nj.validate(nj.read_envelope(spark, str(tmp_path / "r"))).collect()}
    bad = {t for t, r in got.items() if r["status"] == "rejected"}
    assert bad == {"text para", "number para", "null para", "list para", "number qa", "null qa", "bool qa"}
    assert [q["qa_id"] for q in got["text qa"]["paragraphs"][0]["qas"]] == ["q1"]
    assert [q["qa_id"] for q in got["list qa"]["paragraphs"][0]["qas"]] == ["q1"]
    assert got["big"]["paragraphs"][0]["qas"][0]["answers"][0]["answer_start"] == 3_000_000_000
    lax = {q["qa_id"]: q for q in got["lax"]["paragraphs"][0]["qas"]}
    assert set(lax) == {"qf1", "qf0", "qtab", "qunder"} and lax["qf1"]["is_impossible"] and not lax["qf0"]["is_impossible"]
    assert lax["qunder"]["answers"][0]["answer_start"] == 1000


def test_span_check_is_linear(spark):
    """A long contract: the check looks inside the paragraph, not through the full text."""
    paras = [(f"paragraph {i} text", [("Q", f"q{i}", [("text", 10 + len(str(i)) + 1)], False)]) for i in range(4000)]
    df = spark.createDataFrame([(0, "t", paras)], "contract_seq BIGINT, title STRING, paragraphs ARRAY<STRUCT<context: STRING,"
                               " qas: ARRAY<STRUCT<question: STRING, qa_id: STRING, answers: ARRAY<STRUCT<text: STRING,"
                               " answer_start: BIGINT>>, is_impossible: BOOLEAN>>>>")
    out = fl.flat_annotations(df, keep=["contract_seq"], check_text=True)
    assert out.count() == 4000 and out.filter("text_matches").count() == 4000
