"""Scalar helpers by family: half-even rounding, angles, text fields, dates, arrays, maps, JSON, hashes, bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.operators.sampling import normal_cdf

__all__ = ["array_bincount", "chebyshev", "clip", "day_difference", "half_even", "json_number", "normal_cdf", "part", "searchsorted", "set_bits"]


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def half_even(x: Column) -> Column:
    """To the nearest integer, halves to the even one."""
    return F.rint(x)


def part(text: Column, delimiter: str, k: int) -> Column:
    """The k-th part, from 0."""
    return F.split_part(text, F.lit(delimiter), F.lit(k + 1))


def day_difference(a: Column, b: Column) -> Column:
    return F.datediff(a, b)


def searchsorted(edges: list[float], x: Column) -> Column:
    """How many edges are below x."""
    return sum((F.when(x > e, 1).otherwise(0) for e in edges), F.lit(0))


def array_bincount(values: Column, size: int) -> Column:
    """Counts of 0..size-1 in an array of small integers."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(values, lambda v: v == k)))


def json_number(text: Column, path: str) -> Column:
    return F.get_json_object(text, path).cast("double")


def set_bits(value: Column) -> Column:
    return F.bit_count(value)


def chebyshev(a: Column, b: Column) -> Column:
    return F.greatest(F.abs(a), F.abs(b))
