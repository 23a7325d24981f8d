"""The metadata filter language, compiled to Columns.

A filter is a mapping. {} matches all rows; several keys, and several operators on a key, must all hold. A key's value
is a scalar (equality) or a mapping of $eq, $gt, $ge, $lt, $le, $in; $and and $or take lists of mappings.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vantor.errors import InvalidArgument

OPERATORS = ("$eq", "$gt", "$ge", "$lt", "$le", "$in")
INT64 = range(-(1 << 63), 1 << 63)


def scalar(value: object) -> bool | int | float | str:
    """A checked metadata value: bool, int of 64 bits, finite float or text."""
    if isinstance(value, bool) or (isinstance(value, int) and value in INT64):
        return value
    if isinstance(value, float) and math.isfinite(value):
        return value
    if isinstance(value, str):
        value.encode()  # lone surrogates are refused
        return value
    raise InvalidArgument(f"metadata values are bool, int64, finite float or str, not {value!r}")


def validate(where: object) -> None:
    if not isinstance(where, Mapping):
        raise InvalidArgument("a filter must be a mapping")
    for key, value in where.items():
        if not isinstance(key, str):
            raise InvalidArgument("filter keys must be strings")
        if key in ("$and", "$or"):
            if not isinstance(value, list | tuple) or not value:
                raise InvalidArgument(f"{key} takes a non-empty list of filters")
            for child in value:
                validate(child)
        elif key.startswith("$"):
            raise InvalidArgument(f"unknown operator {key}")
        elif isinstance(value, Mapping):
            if not value:
                raise InvalidArgument(f"no operator for {key!r}")
            for op, operand in value.items():
                if op not in OPERATORS:
                    raise InvalidArgument(f"unknown operator {op}")
                if op == "$in":
                    if not isinstance(operand, list | tuple) or not operand:
                        raise InvalidArgument("$in takes a non-empty list")
                    list(map(scalar, operand))
                else:
                    scalar(operand)
        else:
            scalar(value)


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.StringType):
        return "text"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "int"
    if isinstance(t, T.FloatType | T.DoubleType | T.DecimalType):
        return "float"
    raise InvalidArgument(f"columns of type {t.simpleString()} can't be filtered on")


def _less(col: Column, kind: str, value: float, strict: bool) -> Column:
    """col < value (or <=), exact where a long meets a double: the double is rounded to the long next to it."""
    if kind == "int" and isinstance(value, float):
        if abs(value) >= 2.0**63:
            return F.lit(value > 0)
        edge = math.floor(value)
        return col < F.lit(edge) if strict and edge == value else col <= F.lit(edge)
    if kind == "float" and isinstance(value, int) and abs(value) > 1 << 53:
        near = float(value)
        if int(near) == value:
            return col < near if strict else col <= near
        return col <= near if int(near) < value else col < near
    return col < F.lit(value) if strict else col <= F.lit(value)


def _compare(col: Column, kind: str, op: str, operand: object) -> Column:
    value = scalar(operand)
    if (kind == "text") != isinstance(value, str):
        # neither is less than the other: $ge and $le are "not less", so that they hold
        return F.lit(op in ("$ge", "$le"))
    if kind == "text":
        return {"$eq": col == value, "$gt": col > value, "$ge": col >= value, "$lt": col < value, "$le": col <= value}[op]
    if kind == "bool":
        col, kind = col.cast("int"), "int"
    if isinstance(value, bool):
        value = int(value)
    if op == "$eq":
        return _less(col, kind, value, False) & ~_less(col, kind, value, True) if _mixed(kind, value) else col == F.lit(value)
    if not _mixed(kind, value):
        return {"$gt": col > F.lit(value), "$ge": col >= F.lit(value), "$lt": col < F.lit(value), "$le": col <= F.lit(value)}[op]
    return {"$lt": _less(col, kind, value, True), "$le": _less(col, kind, value, False), "$gt": ~_less(col, kind, value, False), "$ge": ~_less(col, kind, value, True)}[op]


def _mixed(kind: str, value: float) -> bool:
    return (kind == "int" and isinstance(value, float)) or (kind == "float" and isinstance(value, int) and abs(value) > 1 << 53)


def compile_filter(where: Mapping, schema: T.StructType, mapping: Mapping[str, Column] | None = None) -> Column:
    """The filter over a table whose columns are the metadata keys. A missing key (no column, or null) never matches.

    Comparisons stay plain Columns over the columns as stored, so that they reach the Parquet scan; a row whose column
    is null drops out as it would under a filter, and only $or and mixed types need explicit null tests.
    """
    validate(where)
    parts = [_part(k, v, schema, mapping or {}) for k, v in where.items()]
    return reduce(and_, parts) if parts else F.lit(True)


def _part(key: str, value: object, schema: T.StructType, mapping: Mapping[str, Column]) -> Column:
    if key in ("$and", "$or"):
        return reduce(and_ if key == "$and" else or_, [compile_filter(v, schema, mapping) for v in value])
    if key not in schema.fieldNames():
        return F.lit(False)
    col, kind = mapping.get(key, F.col(f"`{key}`")), _kind(schema[key].dataType)
    out = []
    for op, operand in (value if isinstance(value, Mapping) else {"$eq": value}).items():
        if op == "$in":
            out.append(reduce(or_, [_compare(col, kind, "$eq", x) for x in operand]))
        else:
            out.append(_compare(col, kind, op, operand))
    return col.isNotNull() & reduce(and_, out)


def metadata_equals(key: str, value: object, schema: T.StructType) -> Column:
    """Strict equality: the stored type must be the value's own, so that 1 is neither true nor 1.0."""
    if key not in schema.fieldNames():
        return F.lit(False)
    own = {bool: "bool", int: "int", float: "float", str: "text"}[type(scalar(value))]
    col = F.col(f"`{key}`")
    return F.coalesce(col == F.lit(value), F.lit(False)) if _kind(schema[key].dataType) == own else F.lit(False)


def compile_map_filter(where: Mapping, column: str = "metadata") -> Column:
    """The filter over metadata kept as map<string, struct<b boolean, i bigint, d double, s string>>, one field set."""
    validate(where)

    def test(key: str, op: str, operand: object) -> Column:
        value, cell = scalar(operand), F.element_at(F.col(column), F.lit(key))
        text = _compare(cell["s"], "text", op, value)
        number = F.when(cell["b"].isNotNull(), _compare(cell["b"], "bool", op, value)).when(cell["i"].isNotNull(), _compare(cell["i"], "int", op, value))
        number = number.when(cell["d"].isNotNull(), _compare(cell["d"], "float", op, value))
        return F.coalesce(F.when(cell["s"].isNotNull(), text).otherwise(number), F.lit(False))

    parts = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            parts.append(reduce(and_ if key == "$and" else or_, [compile_map_filter(v, column) for v in value]))
            continue
        for op, operand in (value if isinstance(value, Mapping) else {"$eq": value}).items():
            parts.append(reduce(or_, [test(key, "$eq", x) for x in operand]) if op == "$in" else test(key, op, operand))
    return reduce(and_, parts) if parts else F.lit(True)
