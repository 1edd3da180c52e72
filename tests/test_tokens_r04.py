"""A contract whose text holds no letter or digit has no first token."""

import duckdb

import __spark_entry__ as E

# (text, tokens of the body, first of them); each title has the three tokens "s", "en" and its id
TEXTS = [("", 0, None), (None, 0, None), ("--- !!! ...", 0, None), (" \t", 0, None), ("\u0301", 0, None),
         ("\n", 2, "paragraph"), ("\u00c9a, en 6", 3, "ea"), ("...x", 1, "x")]
DISTINCT = [3, 3, 3, 3, 3, 5, 4, 4]


def test_bodies_without_tokens(spark, tmp_path):
    """F1"""
    rows = [(i, text, "en", "s") for i, (text, *_) in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in E.queries()["tokens"](spark, str(tmp_path)).orderBy("contract_id").collect()]
    assert got == [(i + 1, 3, n, DISTINCT[i], first) for i, (_, n, first) in enumerate(TEXTS)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert con.execute(E.oracle_sql()["tokens"] + " ORDER BY contract_id").fetchall() == got
