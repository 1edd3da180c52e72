"""Tool-call parsing on VARIANT (F6-F9): every test the original makes on
Python values is a test on ``schema_of_variant`` here, so int vs string vs
null vs missing key are told apart exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind(v: Column) -> Column:
    """Type name of a VARIANT value: BIGINT, STRING, BOOLEAN, VOID (JSON null),
    OBJECT<..>, ARRAY<..>, DECIMAL(..), DOUBLE; NULL when the key is missing."""
    return F.schema_of_variant(v)


def field(v: Column, name: str) -> Column:
    return F.variant_get(v, f"$.{name}", "variant")


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def is_int(v: Column) -> Column:
    """Python ``isinstance(x, int)``: JSON integers and booleans."""
    return F.coalesce(kind(v).isin("BIGINT", "BOOLEAN"), F.lit(False))


def is_str(v: Column) -> Column:
    return F.coalesce(kind(v) == "STRING", F.lit(False))


def is_null_value(v: Column) -> Column:
    """Missing key or JSON null (Python ``None`` after ``dict.get``)."""
    return v.isNull() | (kind(v) == "VOID")


def as_long(v: Column) -> Column:
    return F.try_variant_get(v, "$", "bigint")


def as_str(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def first_call(tool_calls: Column) -> Column:
    """the first tool call; the rest are ignored."""
    return F.try_element_at(tool_calls, F.lit(1))


def parse_object(text: Column) -> Column:
    """JSON text -> VARIANT, NULL when not valid JSON."""
    return F.try_parse_json(text)


def embedded_object(content: Column) -> Column:
    """F8: substring from the first '{' to the last '}' of free text, parsed;
    NULL when there is no such pair or it is not valid JSON."""
    start = F.instr(content, "{")
    end = F.length(content) - F.instr(F.reverse(content), "}") + 1
    ok = (start > 0) & (F.instr(content, "}") > 0) & (start < end)
    return F.when(ok, F.try_parse_json(F.substring(content, start, end - start + 1)))


def object_keys(v: Column) -> Column:
    return F.json_object_keys(F.to_json(v))
