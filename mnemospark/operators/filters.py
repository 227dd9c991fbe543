"""The JSON filter language on metadata, compiled to a column.

A filter is an object; its entries must all hold. ``{field: value}`` is equality, ``{field: {op: operand}}`` applies
operators, ``$and``/``$or``/``$not`` combine filters. Fields are dotted paths through objects. Every result is true or
false, never null. Numbers are equal only within their kind: 1 and 1.0 differ, as JSON texts do.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_COMPARE = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}


def metadata_variant(json_text: Column) -> Column:
    """JSON text as VARIANT; null where it doesn't parse."""
    return F.try_parse_json(json_text)


def _path(field: str) -> str:
    return "$" + "".join("['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in field.split("."))


def _get(meta: Column, field: str) -> Column:
    return F.try_variant_get(meta, _path(field), "variant")


def _kind(x: Column) -> Column:
    return F.schema_of_variant(x)


def _is_float(x: Column) -> Column:
    return (_kind(x) == "DOUBLE") | _kind(x).startswith("DECIMAL") | (_kind(x) == "FLOAT")


def _equals(x: Column, value) -> Column:
    if value is None:
        return F.is_variant_null(x)
    if isinstance(value, bool):
        return (_kind(x) == "BOOLEAN") & (F.try_variant_get(x, "$", "boolean") == F.lit(value))
    if isinstance(value, int):
        if not -(2**63) <= value < 2**63:
            return (F.to_json(x) == F.lit(str(value)))
        return (_kind(x) == "BIGINT") & (F.try_variant_get(x, "$", "bigint") == F.lit(value).cast("bigint"))
    if isinstance(value, float):
        return _is_float(x) & (F.try_variant_get(x, "$", "double") == F.lit(value))
    if isinstance(value, str):
        return (_kind(x) == "STRING") & (F.try_variant_get(x, "$", "string") == F.lit(value))
    other = F.parse_json(F.lit(json.dumps(value)))
    return (F.to_json(x) == F.to_json(other)) & (_kind(x) == _kind(other))


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _valid_regex(pattern: str) -> bool:
    jvm = SparkSession.active()._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:  # the JVM's syntax error
        return False


def _operator(x: Column, op: str, operand) -> Column:
    if op == "$eq":
        return _true(_equals(x, operand))
    if op == "$ne":
        return ~_true(_equals(x, operand))
    if op == "$exists":
        return x.isNotNull() if (operand if isinstance(operand, bool) else True) else x.isNull()
    if op in _COMPARE:
        if isinstance(operand, bool) or not isinstance(operand, (int, float)):
            return F.lit(False)
        number = (_kind(x) == "BIGINT") | _is_float(x)
        return _true(number & _COMPARE[op](F.try_variant_get(x, "$", "double"), F.lit(float(operand))))
    if op in ("$in", "$nin"):
        found = F.lit(False)
        if isinstance(operand, list):
            found = reduce(lambda a, b: a | b, [_true(_equals(x, v)) for v in operand], F.lit(False))
        return found if op == "$in" else ~found
    if op in ("$contains", "$regex"):
        if not isinstance(operand, str) or (op == "$regex" and not _valid_regex(operand)):
            return F.lit(False)
        text = F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string"))
        return _true(text.contains(operand) if op == "$contains" else text.rlike(operand))
    return F.lit(False)


def compile_filter(spec, meta: Column) -> Column:
    """The filter as a two-valued column over the VARIANT ``meta``, true at most where that isn't null."""
    return meta.isNotNull() & _matches(spec, meta)


def _matches(spec, meta: Column) -> Column:
    if not isinstance(spec, dict):
        return F.lit(False)
    parts: list[Column] = []
    for key, want in spec.items():
        if key in ("$and", "$or"):
            if not isinstance(want, list):
                parts.append(F.lit(False))
            elif key == "$and":
                parts.append(reduce(lambda a, b: a & b, [_matches(w, meta) for w in want], F.lit(True)))
            else:
                parts.append(reduce(lambda a, b: a | b, [_matches(w, meta) for w in want], F.lit(False)))
        elif key == "$not":
            parts.append(~_matches(want, meta))
        elif isinstance(want, dict):
            parts += [_operator(_get(meta, key), op, operand) for op, operand in want.items()]
        else:
            parts.append(_true(_equals(_get(meta, key), want)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))
