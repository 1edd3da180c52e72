"""Envelope files read by many tasks (structural index) and by one task each, against Python's JSON reader."""

import json
import random

import pytest

from pactum.sources import envelope as ev

HARD = ["a}b", '{"data":[', "\\", '\\"', '"', "[[{{", "é漢}", "\n}", '"data":[{', "x" * 50, "", "},{", "\\}", "data"]


def value(rng, depth=0):
    kind = rng.random()
    if depth > 3 or kind < 0.5:
        return rng.choice([*HARD, 1, 2.5, None, True])
    if kind < 0.75:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice([*HARD, "k"]): value(rng, depth + 1) for _ in range(rng.randint(0, 3))}


def write_files(rng, folder, n):
    """``n`` envelopes; returns all elements in order."""
    folder.mkdir()
    want = []
    for f in range(n):
        doc = {rng.choice(["m", "version", "x}y", "[", '"data']) + str(k): value(rng) for k in range(rng.randint(0, 2))}
        doc["data"] = [rng.choice([value(rng), {"title": rng.choice(HARD), "p": value(rng)}]) for _ in range(rng.randint(0, 8))]
        doc.update({f"z{k}": value(rng) for k in range(rng.randint(0, 2))})
        want += doc["data"]
        text = json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) + rng.choice(["", "\n", "  \n"])
        (folder / f"f{f}.json").write_text(text, encoding="utf-8")
    return want


def read(spark, folder, limit):
    rows = ev.read_envelope(spark, str(folder), limit).selectExpr("contract_seq", "to_json(c) AS c").collect()
    return [(r.contract_seq, None if r.c is None else json.loads(r.c)) for r in sorted(rows, key=lambda r: r.contract_seq)]


@pytest.mark.parametrize("seed,size", [(1, 7), (2, 16), (3, 40), (4, 100), (5, 300), (6, None)])
def test_any_split_gives_the_same_contracts(spark, tmp_path, seed, size):
    want = write_files(random.Random(seed), tmp_path / "raw", 3)
    assert read(spark, tmp_path / "raw", size) == list(enumerate(want))


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    data = [{"title": f"t{i}", "paragraphs": [{"context": "}" * (i % 40), "qas": []}]} for i in range(3000)]
    (tmp_path / "raw/one.json").write_text(json.dumps({"version": "v", "data": data}))
    with ev.splits_of(spark, 10_000):
        frags = ev.fragments(spark, str(tmp_path / "raw"), 0)
        assert frags.select("split").distinct().count() > 8 and frags.rdd.getNumPartitions() > 8
        whole = ev.pieces(frags, ev.split_index(frags))
        assert whole.where("length(text) > 3000").count() == 0  # never a row larger than a contract
    assert read(spark, tmp_path / "raw", 10_000) == list(enumerate(data))


@pytest.mark.parametrize("text", [
    '{"version": "1", "data": [ {"title": "x", ', '{"version": "1"}', '{"data": {"a": 1}}', '{"meta": {"data": []}}',
    '{"data": [{"a": 1} {"b": 2}]}', '{"data": [{"a": 1}], "data": [{"b": 2}]}', '{"data": [{"a": 1}]} tail', '{"data": [{"a": "x}]}',
    '{"data": [{"a": 1},, {"b": 2}]}'])
def test_broken_files_fail(spark, tmp_path, text):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/x.json").write_text(text)
    with pytest.raises(Exception):
        read(spark, tmp_path / "raw", 9)
