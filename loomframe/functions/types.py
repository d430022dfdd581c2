"""Python type tags and Spark types: mapping, inference from values, classification of text, casts."""

from __future__ import annotations

import ast
import datetime
import re
from collections.abc import Iterable

from pyspark.sql import Column, functions as F, types as T

SCALARS: dict[type, T.DataType] = {
    int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), str: T.StringType(),
    datetime.datetime: T.TimestampNTZType(), datetime.date: T.DateType(), bytes: T.BinaryType(),
}
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FLOATING = (T.FloatType, T.DoubleType)
MOMENT = (T.TimestampType, T.TimestampNTZType, T.DateType)


def tag(kind: T.DataType) -> type:
    """The Python type that a Spark type holds."""
    if isinstance(kind, T.BooleanType):
        return bool
    if isinstance(kind, FLOATING) or (isinstance(kind, T.DecimalType) and kind.scale):
        return float
    if isinstance(kind, NUMERIC):
        return int
    if isinstance(kind, MOMENT):
        return datetime.datetime
    if isinstance(kind, T.ArrayType):
        return list
    if isinstance(kind, T.MapType):
        return dict
    return str


def hint(text: str) -> T.DataType:
    """A type from a hint such as int, float, list[int] or dict{str:float}."""
    text = text.strip()
    plain = {
        "int": T.LongType(), "long": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "str": T.StringType(),
        "datetime": T.TimestampNTZType(), "list": T.ArrayType(T.StringType()), "dict": T.MapType(T.StringType(), T.StringType()),
    }
    if text in plain:
        return plain[text]
    if m := re.fullmatch(r"list\[(.+)\]", text):
        return T.ArrayType(hint(m[1]))
    if m := re.fullmatch(r"dict\{([^:]+):(.+)\}", text):
        return T.MapType(hint(m[1]), hint(m[2]))
    return T.DataType.fromDDL(text)


def spark_type(kind: type | str | T.DataType, values: Iterable = ()) -> T.DataType:
    """The Spark type of a tag; the elements of lists and dicts are inferred from ``values``."""
    if isinstance(kind, T.DataType):
        return kind
    if isinstance(kind, str):
        return hint(kind)
    if kind in SCALARS:
        return SCALARS[kind]
    if kind in (list, tuple, dict):
        known = [v for v in values if isinstance(v, kind) and len(v)]
        if known:
            return infer(known)
        return T.ArrayType(T.StringType()) if kind is not dict else T.MapType(T.StringType(), T.StringType())
    raise TypeError(f"no column type for {kind}")


def infer(values: Iterable) -> T.DataType:
    """The type of all ``values``; None counts for nothing, int and float make float, other mixtures are an error."""
    return _settled(_inferred(values))


def _settled(kind: T.DataType) -> T.DataType:
    """Strings where there was no value to tell."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_settled(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(_settled(kind.keyType), _settled(kind.valueType))
    return T.StringType() if isinstance(kind, T.NullType) else kind


def _inferred(values: Iterable) -> T.DataType:
    found: T.DataType = T.NullType()
    for v in values:
        if v is None:
            continue
        if hasattr(v, "item") and not isinstance(v, (list, dict, str)):
            v = v.item()
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
            kind: T.DataType = T.ArrayType(_inferred(v))
        elif isinstance(v, dict):
            kind = T.MapType(_inferred(v.keys()), _inferred(v.values()))
        else:
            match = next((s for t, s in SCALARS.items() if type(v) is t), None)
            if match is None:
                raise TypeError(f"no column type for a value of {type(v)}")
            kind = match
        found = _common(found, kind)
    return found


def _common(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, NUMERIC) and isinstance(b, NUMERIC):
        return T.DoubleType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_common(a.elementType, b.elementType))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(_common(a.keyType, b.keyType), _common(a.valueType, b.valueType))
    raise TypeError(f"values of types {a.simpleString()} and {b.simpleString()} in one column")


def fit(value, kind: T.DataType):
    """A Python value in the form that a column of ``kind`` takes."""
    if value is None:
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(kind, T.ArrayType):
        return [fit(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return {fit(k, kind.keyType): fit(v, kind.valueType) for k, v in value.items()}
    if isinstance(kind, FLOATING):
        return float(value)
    if isinstance(kind, T.LongType) and not isinstance(value, bool):
        return int(value)
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else str(value)
    return value


_INT, _FLOAT = re.compile(r"[+-]?\d+"), re.compile(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?")
_YEAR = re.compile(r"\b\d{4}\b")


def classify(text: str) -> type:
    """The type that a text cell looks like: int, float, list, dict, datetime (it must have a year) or str."""
    text = text.strip()
    if _INT.fullmatch(text):
        return int
    if _FLOAT.fullmatch(text):
        return float
    if text.startswith("[") and text.endswith("]"):
        return list
    if text.startswith("{") and text.endswith("}"):
        return dict
    if _YEAR.search(text) and parse_moment(text) is not None:
        return datetime.datetime
    return str


def classify_all(texts: Iterable[str]) -> type:
    """One type for a column of cells; empty cells count for nothing, int and float make float, other mixtures str."""
    kinds = {classify(t) for t in texts if t not in (None, "")}
    if len(kinds) == 1:
        return kinds.pop()
    return float if kinds == {int, float} else str


def parse_moment(text: str | None) -> datetime.datetime | None:
    """A free-form date; None where there is none to be read."""
    if not text:
        return None
    from dateutil import parser

    try:
        return parser.parse(re.sub(r"\bSept\b", "Sep", text), default=datetime.datetime(1970, 1, 1)).replace(tzinfo=None)
    except (ValueError, OverflowError):
        return None


def parse_literal(text: str | None, kind: type):
    """A list or dict written as a Python literal or as JSON; None where it is neither."""
    if not text:
        return None
    try:
        value = ast.literal_eval(text.strip())
    except (ValueError, SyntaxError):
        return None
    return value if isinstance(value, kind) else None


def text_cast(c: Column, kind: type, element: T.DataType | None = None, empty_is_zero: bool = False) -> Column:
    """A string column as another type, null where a cell does not read as one.

    Numbers, strings and ISO dates are read by Spark; free-form dates and literals of lists and dicts by Arrow-batched
    Python. ``empty_is_zero``: empty cells become 0, 0.0, an empty list or an empty dict.
    """
    trimmed = F.trim(c)
    if kind is str:
        return c
    if kind is int:
        out, zero = trimmed.try_cast("long"), F.lit(0).cast("long")
    elif kind is float:
        out, zero = trimmed.try_cast("double"), F.lit(0.0)
    elif kind is bool:
        out, zero = trimmed.try_cast("boolean"), F.lit(False)
    elif kind is datetime.datetime:
        free = F.udf(parse_moment, T.TimestampNTZType(), useArrow=True)
        out, zero = F.coalesce(trimmed.try_cast("timestamp_ntz"), free(trimmed)), F.lit(None).cast("timestamp_ntz")
    elif kind in (list, dict):
        target = element or spark_type(kind)
        read = F.udf(lambda t: fit_or_none(parse_literal(t, kind), target), target, useArrow=True)
        out = read(c)
        zero = F.array().cast(target) if kind is list else F.create_map().cast(target)
    else:
        raise TypeError(f"no cast to {kind}")
    if empty_is_zero:
        return F.when(trimmed == "", zero).otherwise(out)
    return F.when(trimmed != "", out)


def fit_or_none(value, kind: T.DataType):
    try:
        return fit(value, kind)
    except (TypeError, ValueError):
        return None
