"""Properties: tokeniser = Unicode rule; results independent of partitioning."""

import unicodedata

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from pactum.functions.text import tokens

from .conftest import SF_SMALL

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" \
          "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝßæø" \
          "čďěňřšťůžČŘŠŽąćęłńśźżőűăășțğışĂŐŰḍṣẓόάέήίйїЙ漢字١２"
MARKS = "\u0300\u0301\u0302\u0303\u0308\u030A\u030C\u0327\u0328"
SEPARATORS = " \n\t.,;:!?'\"-()[]{}/\\*&%$#@\u00A0\u2003"


def python_tokens(text: str) -> list[str]:
    """Reference rule: runs of letters/digits (and marks), lower-cased, accents stripped."""
    out = []
    for t in regex.findall(r"[\p{L}\p{N}][\p{L}\p{N}\p{Mn}]*", text):
        d = unicodedata.normalize("NFD", t.lower())
        out.append(unicodedata.normalize("NFC", "".join(ch for ch in d if unicodedata.category(ch) != "Mn")))
    return out


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet=LETTERS + MARKS + SEPARATORS, max_size=60), min_size=150, max_size=150))
def test_tokeniser_matches_unicode_rule(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    got = {r["i"]: r["toks"] for r in df.select("i", tokens(F.col("t")).alias("toks")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == python_tokens(t), t


def test_composed_and_decomposed_words_are_one_token(spark):
    words = ["Dvořák", "cafés", "Příliš žluťoučký", "Łódź", "naïve", "Ångström"]
    both = [(i, f, unicodedata.normalize(f, w)) for i, w in enumerate(words) for f in ("NFC", "NFD")]
    df = spark.createDataFrame(both, "i INT, f STRING, t STRING").select("i", tokens(F.col("t")).alias("t"))
    got = {}
    for r in df.collect():
        assert got.setdefault(r["i"], r["t"]) == r["t"]
    assert got[0] == ["dvorak"] and got[1] == ["cafes"]


def test_python_white_space_is_stripped(spark):
    from pactum.functions.text import py_strip

    space = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    texts = [f"{c}True{c}" for c in space] + [space + "True" + space, "True", " a b "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    got = {r["i"]: r["s"] for r in df.select("i", py_strip(F.col("t")).alias("s")).collect()}
    assert all(got[i] == t.strip() for i, t in enumerate(texts))


@pytest.mark.parametrize("name", ["build_tables", "scenario_split", "search_topk", "rubric", "load_nested"])
def test_partition_count_does_not_change_results(spark, name):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            df = E.queries()[name](spark, SF_SMALL)
            return sorted(tuple(r) for r in df.collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert run(1) == run(13)
