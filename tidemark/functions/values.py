"""Value rules: comparisons, arithmetic that keeps integers whole, fixed-point rounding, column types of table definitions."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {"=": "__eq__", "!=": "__ne__", "<>": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def compare(left: Column, op: str, right: Column) -> Column:
    if op not in _COMPARE:
        raise ValueError(f"no comparison {op}")
    return getattr(left, _COMPARE[op])(right)


def _side(x: Any) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def arithmetic(left: Any, op: str, right: Any) -> Column:
    """left op right for column names, Columns and literals; null gives null; `div` divides integers and drops what is left over."""
    a, b = _side(left), _side(right)
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    if op == "/":
        return a / b
    if op == "div":
        return F.call_function("div", a, b)
    raise ValueError(f"no operator {op}")


def fixed_point(x: Column) -> Column:
    """Rounded to the nine decimals that fixed-point numbers have."""
    return F.round(x, 9)


def same(a: Column, b: Column) -> Column:
    """Equality under which null equals null, as view keys need it."""
    return a.eqNullSafe(b)


_TYPES = {
    "tinyint": "int", "smallint": "int", "mediumint": "int", "int": "int", "integer": "int", "bigint": "bigint", "serial": "bigint",
    "float": "double", "double": "double", "real": "double", "decimal": "double", "numeric": "double",
    "char": "string", "varchar": "string", "text": "string", "tinytext": "string", "mediumtext": "string", "longtext": "string", "blob": "string", "longblob": "string", "mediumblob": "string", "binary": "string", "varbinary": "string", "enum": "string",
    "date": "timestamp_ntz", "datetime": "timestamp_ntz", "timestamp": "timestamp_ntz", "bool": "int", "boolean": "int",
}


def column_type(declared: str) -> str:
    """Spark's type for a declared one; unsigned integers are a size wider."""
    base = re.match(r"\w+", declared.strip().lower())
    kind = _TYPES.get(base[0]) if base else None
    if kind is None:
        raise ValueError(f"no column type {declared!r}")
    if "unsigned" in declared.lower():
        return {"int": "bigint", "bigint": "decimal(20,0)"}.get(kind, kind)
    return kind
