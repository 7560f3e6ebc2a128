"""Single-field predicates on JSON values, and redaction of fields.

The field is an exact top-level name.  A value that is no JSON object, or lacks the field, fails
every operator.  Orderings compare as numbers (quoted numerals too; JSON null is 0); equality
compares the text of strings and the raw text of other values; of repeated fields the last
counts.  The value is parsed once.  Orderings stay in column expressions.  So does equality for
values in canonical form; ``raw_text=True`` keeps the raw text of numbers and nested values
through an Arrow UDF.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ORDERINGS = {">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__"}
_SPACE, _COLON = re.compile(r"[\s,]*"), re.compile(r"\s*:\s*")
_BETWEEN = re.compile(r'("(?:[^"\\]|\\.)*")|\s+')
_NUMBER = re.compile(r"[+-]?(\d[\d_]*\.?\d*|\.\d+)([eE][+-]?\d+)?|[+-]?(inf|infinity)|nan", re.I)


def _raw_field(name: str):
    @F.pandas_udf("string")
    def raw(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _raw_member(v, name))

    return raw


class _Raw(str):
    """Raw text of a number."""


def _raw_member(value: str | None, name: str) -> str | None:
    """Unquoted string or raw text of a top-level field, the last of repeated ones; null is empty."""
    try:
        found = json.loads(value, parse_int=_Raw, parse_float=_Raw) if value is not None else None
    except ValueError:
        return None
    if not isinstance(found, dict) or name not in found:
        return None
    member = found[name]
    if member is None:
        return ""
    if isinstance(member, bool):
        return "true" if member else "false"
    if isinstance(member, str):
        return str(member)
    return _raw_nested(value, name)


def _raw_nested(value: str, name: str) -> str:
    """Source text of the last top-level member of that name, which is an object or array."""
    decoder, at, found = json.JSONDecoder(), value.index("{") + 1, ""
    space = re.compile(r"[\s,]*")
    while True:
        at = space.match(value, at).end()
        if value[at] == "}":
            return found
        key, at = decoder.raw_decode(value, at)
        at = re.compile(r"\s*:\s*").match(value, at).end()
        _, end = decoder.raw_decode(value, at)
        if key == name:
            found = value[at:end]
        at = end


def field_predicate(value: Column, field: str, op: str, operand: str, *, raw_text: bool = False) -> Column:
    """Whether the JSON value's field satisfies the operator; '' as operator is always true."""
    if op == "":
        return F.lit(True)
    if op not in ORDERINGS and op not in ("==", "!="):
        raise ValueError(f"unknown operator {op!r}")
    if op in ORDERINGS and not _NUMBER.fullmatch(operand):
        return F.lit(False)
    if raw_text and op not in ORDERINGS:
        text = _raw_field(field)(value)
        return F.coalesce(text == operand if op == "==" else text != operand, F.lit(False))

    def test(text: Column) -> Column:
        # a null member is absent from what from_json gives as text
        if op not in ORDERINGS:
            return F.coalesce(text, F.lit("")) == operand if op == "==" else F.coalesce(text, F.lit("")) != operand
        number = F.when(text.isNull(), F.lit(0.0)).otherwise(text.try_cast("double"))
        return getattr(number, ORDERINGS[op])(float(operand)) & ~F.isnan(number)

    members = F.filter(F.map_entries(F.from_json(value, "map<string,string>")), lambda e: e["key"] == field)
    return F.coalesce(F.get(F.reverse(F.transform(members, lambda e: test(e["value"]))), F.lit(0)), F.lit(False))


def _members(value: str) -> dict[str, str] | None:
    """Top-level members of a JSON object as raw text, the last of repeated ones; None for other texts."""

    def refuse(name: str):
        raise ValueError(name)

    try:
        if not isinstance(json.loads(value, parse_constant=refuse, parse_int=_Raw, parse_float=_Raw), dict):
            return None
    except (ValueError, RecursionError):
        return None
    decoder, found = json.JSONDecoder(parse_int=_Raw, parse_float=_Raw), {}
    at = _SPACE.match(value, value.index("{") + 1).end()
    while value[at] != "}":
        key, at = decoder.raw_decode(value, at)
        begin = _COLON.match(value, at).end()
        _, end = decoder.raw_decode(value, begin)
        found[key] = value[begin:end]
        at = _SPACE.match(value, end).end()
    return found


def _escaped(text: str) -> str:
    for char, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        text = text.replace(char, code)
    return text


def redacted(value: str | None, fields: list[str], mark: str) -> str | None:
    """The object with the named members replaced and keys sorted, other members as they are but for space between tokens."""
    members = None if value is None else _members(value)
    if members is None or not any(f in members for f in fields):
        return value
    members |= {f: json.dumps(mark) for f in fields if f in members}
    compact = lambda raw: _BETWEEN.sub(lambda m: m[1] or "", raw)
    ordered = sorted(members.items(), key=lambda kv: kv[0].encode("utf-8", "surrogatepass"))
    return "{" + ",".join(_escaped(json.dumps(k, ensure_ascii=False) + ":" + compact(v)) for k, v in ordered) + "}"


def redact(value: Column, fields: list[str], mark: str = "[REDACTED]") -> Column:
    """The JSON object with the named top-level fields replaced and keys sorted; other members keep their raw text.

    Values without any of the fields, and values that are no objects, pass byte by byte.  Only
    values that may hold a field, by its text or an escape, go through the Arrow UDF.
    """
    may = F.contains(value, F.lit("\\"))
    for f in fields:
        may = may | F.contains(value, F.lit(json.dumps(f, ensure_ascii=False)))

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: redacted(v, fields, mark), na_action="ignore")

    return F.when(may, run(F.when(may, value))).otherwise(value)
