"""Whole-number helpers as Columns; arguments are longs above 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_log2(n: Column) -> Column:
    """The place of the highest bit, exactly: the length of the binary form less one."""
    return F.length(F.bin(n)) - 1


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def ceil_log2(n: Column) -> Column:
    return floor_log2(n) + F.when(is_power_of_two(n), 0).otherwise(1)


def ceil_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a + b - 1, b)


def round_up(a: Column, b: Column) -> Column:
    """The smallest multiple of b that is not below a."""
    return ceil_div(a, b) * b
