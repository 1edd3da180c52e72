"""Steps that were too slow or too large at size: contracts taken apart by one cast."""

import json

from pyspark.sql import functions as F

from pactum.sources import nested_json as nj

QA = {"id": "q", "question": "Q", "answers": [{"text": "a", "answer_start": 1}, {"text": "b", "answer_start": "2"}]}
CONTRACTS = [
    {"title": "t", "paragraphs": [{"context": "abc", "qas": [QA, {**QA, "is_impossible": "yes"}, {**QA, "id": 5}]}]},
    {"title": "t", "paragraphs": [{"context": None, "qas": [QA]}]},
    {"title": "t", "paragraphs": [{"qas": [QA]}, {"context": "x", "qas": [{**QA, "answers": [5]}, {**QA, "answers": [None]}]}]},
    {"title": 5, "paragraphs": [{"context": "x", "qas": [{**QA, "answers": []}]}]},
    {"paragraphs": [{"context": "x", "qas": []}]}, {"title": "t", "paragraphs": [5]}, {"title": "t", "paragraphs": []},
    {"title": "t", "paragraphs": [{"context": "x"}, {"context": "y", "qas": [QA]}]},
    {"title": "t", "paragraphs": [{"context": "x", "qas": None}]}, {"title": "t", "paragraphs": [{"context": "x", "qas": [5, "s", []]}]},
    {"title": "t", "paragraphs": [{"context": "x", "qas": ["s", [], QA]}]},
    {"title": "t", "paragraphs": [{"context": "x", "qas": [{"id": "q", "question": "Q"}, {**QA, "answers": None}, {**QA, "answers": 3}]}]},
    {"title": "t", "paragraphs": 5}, {"title": "t", "paragraphs": None}, {"title": "t"}, 5, None, "s", [],
]


def raw(spark):
    rows = [(i, json.dumps(c)) for i, c in enumerate(CONTRACTS)]
    return spark.createDataFrame(rows, "contract_seq BIGINT, j STRING").select("contract_seq", F.parse_json("j").alias("c"))


def test_one_cast_tells_what_the_levels_tell(spark):
    """F7, F9"""
    text = lambda o: F.to_json(o, {"ignoreNullFields": "false"})
    rows = raw(spark).select("contract_seq", text(nj._contract(F.col("c"))).alias("one"),
                             text(nj._taken_apart(F.col("c"))).alias("levels")).collect()
    assert len(rows) == len(CONTRACTS) and [r.contract_seq for r in rows if r.one != r.levels] == []


def test_types_are_asked_of_scalars_only(spark):
    """the type of an object or list is the type of all that lies in it."""
    plan = nj.validate(raw(spark))._jdf.queryExecution().analyzed().toString()
    assert "schema_of_variant(c#" not in plan and "startswith(schema_of_variant" not in plan
    got = {r.contract_seq: r for r in nj.validate(raw(spark)).collect()}
    assert [got[i].reason for i in range(len(CONTRACTS))] == [
        None, "bad_paragraph", None, "bad_title", "bad_title", "bad_paragraph", "no_paragraphs", None, "bad_paragraph",
        "bad_paragraph", None, None, "paragraphs_not_a_list", "no_paragraphs", "no_paragraphs", *["not_an_object"] * 4]
    assert [len(p.qas) for p in got[0].paragraphs] == [2] and [len(p.qas) for p in got[2].paragraphs] == [0]
    assert [len(p.qas) for p in got[7].paragraphs] == [0, 1] and [len(p.qas) for p in got[10].paragraphs] == [1]
    assert [q.answers for q in got[11].paragraphs[0].qas] == [[]]
