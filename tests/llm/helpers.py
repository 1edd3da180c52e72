"""Small tables with the awkward cases every operator must define."""

import random

from pyspark.sql import types as T

#: documents with columns whose names clash with results or helper columns.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("kept", T.StringType()), T.StructField("row", T.IntegerType()),
    T.StructField("id", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("length", T.DoubleType())])

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 8))) for _ in range(n)]
    for i in range(7, n, 8):
        words[i] += ".\n" if i % 16 == 15 else "."
    text = " ".join(words).replace("\n ", "\n")
    return text if text.endswith(".") else text + "."


def awkward_texts(seed: int = 3) -> list[tuple[int | None, str | None]]:
    """(doc_id, text): nulls, empty, long, ties, repeated rows, copies and shared passages."""
    rng = random.Random(seed)
    base, other = prose(rng, 240), prose(rng, 180)
    passage = prose(rng, 60)
    words = base.split(" ")
    near = " ".join(words[:100] + ["changed"] + words[101:])
    return [
        (1, base), (2, base), (2, base), (3, near), (4, None), (5, ""), (6, " \n\t "), (7, "one two"),
        (8, "one two"), (9, "ONE Two"), (10, other), (None, other), (None, None), (11, passage + "\n" + prose(rng, 70)),
        (12, prose(rng, 70) + "\n" + passage), (13, passage + " " + passage), (14, "é漢😀 " * 60),
        (15, "word " * 300), (16, prose(rng, 6000)), (17, "a" * 250), (18, "x\x1cy z ß İ ſ <|endoftext|> don't"),
        (19, " ".join(words[:120])), (20, prose(rng, 49)), (21, base.upper()),
    ]


def documents(spark, rows=None):
    rows = awkward_texts() if rows is None else rows
    full = [(i, t, "no", 7, f"id-{i}", None if t is None else len(t), 1.5) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def by_row(frame, *cols):
    """Sorted rows, NULLs first."""
    return sorted((tuple(r) for r in frame.select(*cols).collect()), key=lambda r: [(x is not None, x) for x in r])
