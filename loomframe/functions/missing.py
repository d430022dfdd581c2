"""The meanings of "missing", as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .types import FLOATING, NUMERIC


def missing(c: Column, kind: T.DataType) -> Column:
    """Null, NaN, or an empty string, list or dict: what dropping, filling and counting of missing values look at."""
    if isinstance(kind, FLOATING):
        return c.isNull() | F.isnan(c)
    if isinstance(kind, T.StringType):
        return c.isNull() | (c == "")
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def undefined(c: Column, kind: T.DataType) -> Column:
    """Null, NaN or infinite: what sketches leave out."""
    if isinstance(kind, FLOATING):
        return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return c.isNull()


def present(c: Column, kind: T.DataType) -> Column:
    """The value, or null for NaN: what aggregators look at."""
    return F.when(~F.isnan(c), c) if isinstance(kind, FLOATING) else c


def truthy(c: Column, kind: T.DataType) -> Column:
    """Python's truth of a value, never null; null and NaN are false."""
    if isinstance(kind, T.BooleanType):
        out = c
    elif isinstance(kind, FLOATING):
        out = (c != 0) & ~F.isnan(c)
    elif isinstance(kind, NUMERIC):
        out = c != 0
    elif isinstance(kind, T.StringType):
        out = c != ""
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        out = F.size(c) > 0
    else:
        out = c.isNotNull()
    return F.coalesce(out, F.lit(False))
