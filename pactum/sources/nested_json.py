"""Nested question-answer JSON -> validated contracts.

The nested part is read as VARIANT, never as a typed struct: a typed read
turns "12" and 12.0 into NULL for an INT field, coerces ``context: 5`` into a
string and cannot tell a missing key from a JSON null.  ``schema_of_variant``
tells every case apart (missing key -> NULL, null -> VOID, 12 -> BIGINT,
"12" -> STRING, 12.0 -> DECIMAL(n,0), 12.5 -> DECIMAL(n,1), true -> BOOLEAN),
so each lax rule of the original validation becomes an expression; the
typed struct is produced once, after validation.

Two physical forms are read:
* the envelope ``{"version": .., "data": [contract, ..]}``, one JSON document
  per file of any size (``pactum.sources.envelope``);
* JSON Lines, one contract per line with an explicit ``seq`` (splittable; the
  form this library writes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactum.functions import toolcall as tc
from pactum.functions.text import py_strip
from pactum.operators.flatten import bound
from pactum.schemas import PROCESSED_VERSION
from pactum.sources.envelope import read_envelope  # noqa: F401

BOOL_TRUE = ("1", "on", "t", "true", "y", "yes")
BOOL_FALSE = ("0", "off", "f", "false", "n", "no")
ANSWERS = "array<struct<text: variant, answer_start: variant>>"
QAS = (f"array<struct<f: struct<question: variant, id: variant, qa_id: variant, answers: {ANSWERS}, no_answers: boolean, "
       "is_impossible: variant>, scalar: boolean>>")
CONTRACT = ("struct<title: variant, paragraphs: array<struct<context: variant, qas: array<struct<question: variant, "
            f"id: variant, qa_id: variant, answers: {ANSWERS}, is_impossible: variant>>>>>")
INT_TEXT = r"^[+-]?[0-9]+(_[0-9]+)*(\.0+)?$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines, one contract per line carrying its ``seq``.  A line without a
    whole-number ``seq`` fails the read: joins on it would lose the contract."""
    raw = spark.read.option("singleVariantColumn", "c").option("mode", "FAILFAST").json(path)
    seq = F.try_variant_get("c", "$.seq", "bigint")
    return raw.select(F.when(seq.isNull(), F.raise_error(F.lit("invalid format: a line has no 'seq'")))
                      .otherwise(seq).alias("contract_seq"), "c")


# --- lax scalar rules -----------------------------------------------------------

def lax_int(v: Column) -> Column:
    """int as the original validation accepts it, else NULL: integers,
    booleans (1/0), integral decimals/doubles and integer text (white space
    around, sign, single underscores between digits, trailing '.0' allowed)."""
    dbl = F.try_variant_get(v, "$", "double")
    s = py_strip(tc.as_str(v))
    return bound(tc.kind(v), lambda k: (
        F.when(k == "BIGINT", tc.as_long(v))
        .when(k == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
        .when((k.startswith("DECIMAL") | k.isin("DOUBLE", "FLOAT")) & (dbl == F.floor(dbl)), dbl.cast("bigint"))
        .when((k == "STRING") & s.rlike(INT_TEXT),
              F.replace(F.regexp_extract(s, r"^([+-]?[0-9_]+)", 1), F.lit("_"), F.lit("")).try_cast("bigint"))))


def lax_bool(v: Column) -> Column:
    s = F.lower(tc.as_str(v))
    n = tc.as_long(v)
    return bound(tc.kind(v), lambda k: (
        F.when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when((k == "BIGINT") & n.isin(0, 1), n == 1)
        .when((k.startswith("DECIMAL") | k.isin("DOUBLE", "FLOAT"))
              & F.try_variant_get(v, "$", "double").isin(0.0, 1.0), F.try_variant_get(v, "$", "double") == 1.0)
        .when((k == "STRING") & s.isin(*BOOL_TRUE), F.lit(True))
        .when((k == "STRING") & s.isin(*BOOL_FALSE), F.lit(False))))


def _arr(v: Column) -> Column:
    """The elements of a list, NULL for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def _fields(v: Column, *names: str) -> Column:
    """These fields of an object, each NULL when its key is missing; NULL for anything
    else.  One look at the object: ``schema_of_variant`` of an object or list reads all
    that lies in it, so ``kind`` is asked of values that should be scalars only."""
    return F.try_variant_get(v, "$", f"struct<{', '.join(f'{n}: variant' for n in names)}>")


def _str(v: Column) -> Column:
    """A string, NULL for anything else."""
    return F.when(tc.is_str(v), tc.as_str(v))


# --- QA / paragraph / contract rules -----------------------------------------------

def _answers(f: Column) -> Column:
    """Typed answers, NULL if there is no list or one answer is bad; no key is no answer."""
    typed = F.transform(f["answers"], lambda a: F.struct(
        _str(a["text"]).alias("text"), lax_int(a["answer_start"]).alias("answer_start")))
    good = bound(typed, lambda t: F.when(
        F.forall(t, lambda a: a["text"].isNotNull() & a["answer_start"].isNotNull()), t))
    return F.when(f["no_answers"], F.array().cast("array<struct<text: string, answer_start: bigint>>")).otherwise(good)


def qa_typed(f: Column) -> Column:
    """P5: the QA out of its fields, NULL if it is no object or has one bad field (or one bad
    answer).  QA key ``id`` (as written in the raw file) or ``qa_id`` (processed file)."""
    imp = f["is_impossible"]
    named = tc.is_str(f["question"]) & tc.is_str(F.coalesce(f["id"], f["qa_id"]))
    typed = F.when(named, F.struct(
        tc.as_str(f["question"]).alias("question"),
        tc.as_str(F.coalesce(f["id"], f["qa_id"])).alias("qa_id"),
        _answers(f).alias("answers"),
        F.when(imp.isNull(), F.lit(False)).otherwise(lax_bool(imp)).alias("is_impossible")))
    return bound(typed, lambda q: F.when(q["answers"].isNotNull() & q["is_impossible"].isNotNull(), q))


def _qa_fields(f: Column, answers: Column, no_answers: Column) -> Column:
    return F.struct(f["question"].alias("question"), f["id"].alias("id"), f["qa_id"].alias("qa_id"),
                    answers.alias("answers"), no_answers.alias("no_answers"), f["is_impossible"].alias("is_impossible"))


def _qa(q: Column) -> Column:
    """(f: the fields, scalar).  A QA that is a number, a boolean or null rejects the contract (the
    original fails on it); other QAs that are no object are dropped one by one."""
    def seen(f):
        scalar = bound(tc.kind(q), lambda k: ~F.coalesce((k == "STRING") | k.startswith("ARRAY"), F.lit(False)))
        answers = F.transform(_arr(f["answers"]), lambda a: _fields(a, "text", "answer_start"))
        return F.struct(F.when(f.isNotNull(), _qa_fields(f, answers, f["answers"].isNull())).alias("f"),
                        F.when(f.isNull(), scalar).otherwise(F.lit(False)).alias("scalar"))
    return bound(_fields(q, "question", "id", "qa_id", "answers", "is_impossible"), seen)


def _paragraph(p: Column) -> Column:
    """(is_object, context, ok, qas): a kept paragraph must have a string context and a list (or no) qas."""
    def seen(f):
        return bound(_arr(f["qas"]), lambda qas: F.struct(
            f.isNotNull().alias("is_object"), f["context"].alias("context"),
            (tc.is_str(f["context"]) & (f["qas"].isNull() | qas.isNotNull())).alias("ok"),
            F.coalesce(F.transform(qas, _qa), F.array().cast(QAS)).alias("qas")))
    return bound(_fields(p, "context", "qas"), seen)


def _taken_apart(c: Column) -> Column:
    """(is_object, title, not_a_list, paragraphs) of any value, level by level."""
    def seen(o):
        v = o["paragraphs"]
        return bound(_arr(v), lambda paras: F.struct(
            o.isNotNull().alias("is_object"), o["title"].alias("title"),
            (paras.isNull() & v.isNotNull() & (tc.kind(v) != "VOID")).alias("not_a_list"),  # present, not a list
            F.transform(paras, _paragraph).alias("paragraphs")))
    return bound(_fields(c, "title", "paragraphs"), seen)


def _contract(c: Column) -> Column:
    """``_taken_apart``, by one cast of the whole contract where that tells as much: every level
    taken on its own copies all that lies below.  The cast leaves NULL for a missing list, a null
    and a value of another kind alike, so a contract with one of these goes level by level."""
    def qa(q):
        return F.struct(_qa_fields(q, q["answers"], F.lit(False)).alias("f"), F.lit(False).alias("scalar"))

    def paragraph(p):
        return F.struct(p.isNotNull().alias("is_object"), p["context"].alias("context"),
                        tc.is_str(p["context"]).alias("ok"), F.transform(p["qas"], qa).alias("qas"))

    def seen(d):
        clear = F.forall(d["paragraphs"], lambda p: p["qas"].isNotNull() & F.forall(
            p["qas"], lambda q: q["answers"].isNotNull()))
        return F.when(clear, F.struct(
            F.lit(True).alias("is_object"), d["title"].alias("title"), F.lit(False).alias("not_a_list"),
            F.transform(d["paragraphs"], paragraph).alias("paragraphs"))).otherwise(_taken_apart(c))
    return bound(F.try_variant_get(c, "$", CONTRACT), seen)


def validate(raw: DataFrame, max_contracts: int | None = None, mode: str = "raw") -> DataFrame:
    """P1-P7 in one pass: (contract_seq, title, paragraphs typed, status, reason)
    with status ``ok`` / ``dropped`` / ``rejected``.

    ``raw`` (first conversion): contracts without paragraphs are dropped,
    paragraphs without a context key and invalid QAs are dropped one by one.
    ``processed`` (P7, re-validation on load): the whole contract is checked
    at once -- an empty paragraph list is valid, but a missing context or one
    invalid QA rejects the contract."""
    if max_contracts is not None and max_contracts < 0:
        raise ValueError("max_contracts must be >= 0")
    if max_contracts:  # P2: first N by input order; 0 / None = all
        raw = raw.filter(F.col("contract_seq") < max_contracts)
    def kept(o: Column) -> Column:
        if mode == "processed":
            return o["paragraphs"]
        return F.filter(o["paragraphs"], lambda p: p["is_object"] & p["context"].isNotNull())

    def verdict(o: Column) -> Column:
        paras, bad_paras = o["paragraphs"], o["not_a_list"]
        if mode == "raw":
            # explicit NULL test: size(NULL) is -1, not NULL, when ANSI mode is off
            no_paras = ~bad_paras & (paras.isNull() | (F.size(paras) == 0))
            bad_para = (F.exists(paras, lambda p: ~p["is_object"])
                        | F.exists(kept(o), lambda p: ~p["ok"] | F.exists(p["qas"], lambda q: q["scalar"])))
        else:
            no_paras = F.lit(False)
            bad_paras = bad_paras | paras.isNull()
            bad_para = F.exists(paras, lambda p: ~p["is_object"] | ~p["ok"] | F.exists(
                p["qas"], lambda q: qa_typed(q["f"]).isNull()))
        reason = (F.when(~o["is_object"], "not_an_object").when(no_paras, "no_paragraphs")
                  .when(bad_paras, "paragraphs_not_a_list").when(bad_para, "bad_paragraph")
                  .when(~tc.is_str(o["title"]), "bad_title"))
        status = bound(reason, lambda r: F.struct(
            F.when(r.isNull(), "ok").when(r == "no_paragraphs", "dropped").otherwise("rejected").alias("status"),
            r.alias("reason")))
        return status

    if mode not in ("raw", "processed"):
        raise ValueError(f"unknown mode {mode!r}")
    seen = raw.select("contract_seq", _contract(F.col("c")).alias("o"), tc.as_str(tc.field(F.col("c"), "title")).alias("title"))
    # ``bound``: a filter on the status that Spark moves below takes the contract apart once.
    judged = seen.withColumn("verdict", bound(F.col("o"), verdict))
    typed = F.transform(kept(F.col("o")), lambda p: F.struct(
        tc.as_str(p["context"]).alias("context"),
        F.filter(F.transform(p["qas"], lambda q: qa_typed(q["f"])), lambda q: q.isNotNull()).alias("qas")))
    return judged.select("contract_seq", "verdict.status", "verdict.reason", "title",
                         F.when(F.col("verdict.status") == "ok", typed).alias("paragraphs"))


def good_and_rejects(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid contracts and the rejects report, from one flagged frame."""
    good = flagged.filter(F.col("status") == "ok").select("contract_seq", "title", "paragraphs")
    bad = flagged.filter(F.col("status") != "ok").select("contract_seq", "title", "status", "reason")
    return good, bad


def write_processed_lines(nested: DataFrame, path: str) -> None:
    """S3 exchange form: JSON Lines ``{"version", "seq", "title", "paragraphs"}``
    with the QA key ``qa_id``; derived fields (full text, answer end) are not stored."""
    (nested.select(F.lit(PROCESSED_VERSION).alias("version"), F.col("contract_seq").alias("seq"),
                   "title", "paragraphs")
     .write.mode("overwrite").json(path))


def write_processed_parquet(nested: DataFrame, path: str) -> None:
    """S3 main form: nested parquet (typed, columnar, splittable)."""
    nested.select("contract_seq", "title", "paragraphs").write.mode("overwrite").parquet(path)
