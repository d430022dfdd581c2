"""Nested columns to flat ones and back."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..functions.missing import missing
from ..functions.types import NUMERIC, spark_type
from ..plans.order import fresh, quoted
from .frame import Frame
from .series import Series

SAMPLE = 100


def col(name: str):
    return F.col(quoted(name))


def pack(frame: Frame, columns=None, prefix=None, dtype=list, fill_na=None, remove_prefix=True, name=None) -> Frame:
    """Several columns as one list, dict or numeric array, which comes last."""
    if (columns is None) == (prefix is None):
        raise ValueError("columns or a prefix")
    names = list(columns) if columns is not None else [n for n in frame.df.columns if n.startswith(prefix)]
    frame._check(names)
    if len(names) < (1 if prefix is not None else 2):
        raise ValueError("too few columns to pack")
    if len(set(names)) != len(names):
        raise ValueError("a column is named twice")
    kinds = [frame.df.schema[n].dataType for n in names]
    values = [
        col(n) if fill_na is None else F.when(missing(col(n), k), F.lit(fill_na)).otherwise(col(n))
        for n, k in zip(names, kinds, strict=True)
    ]
    if len({k.simpleString() for k in kinds}) > 1:
        numeric = all(isinstance(k, NUMERIC) for k in kinds)
        values = [v.cast("double" if numeric else "string") for v in values]
    if dtype is dict:
        keys = [n.removeprefix(prefix).lstrip(".-_") if prefix and remove_prefix else n for n in names]
        packed = F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*values))
        packed = F.map_filter(packed, lambda k, v: v.isNotNull())
    elif dtype is list:
        packed = F.array(*values)
    elif str(getattr(dtype, "__name__", dtype)) == "array":
        if not all(isinstance(k, NUMERIC) for k in kinds):
            raise RuntimeError("a numeric array needs numeric columns")
        packed = F.array(*(v.cast("double") for v in values))
    else:
        raise ValueError("dtype: list, dict or array")
    rest = [n for n in frame.df.columns if n not in names]
    name = name or (prefix.rstrip(".-_") if prefix else None) or f"X.{len(rest)}"
    name = fresh(rest, name)
    lineage = frame._lineage.put(name, frame._lineage.pairs(names))
    return Frame.of(frame.df.select(*map(col, rest), packed.alias(name)), lineage.select([*rest, name]))


def unpacked(series: Series, prefix=None, column_types=None, na_value=None, limit=None) -> Frame:
    """A column for each element of lists or key of dicts; keys and the longest list are looked for in the first rows."""
    kind, c = series.kind, series.expr
    name = (lambda k: f"{prefix}.{k}") if prefix else str
    if isinstance(kind, T.MapType):
        keys = list(limit) if limit is not None else sorted({k for v in series.head_as_list(SAMPLE) if v for k in v})
        pick = {name(k): F.try_element_at(c, F.lit(k).cast(kind.keyType)) for k in keys}
        element = kind.valueType
    elif isinstance(kind, T.ArrayType):
        if limit is None:
            n = len(column_types) if isinstance(column_types, (list, tuple)) else max((len(v) for v in series.head_as_list(SAMPLE) if v), default=0)
            limit = range(n)
        pick = {name(i): F.get(c, F.lit(i)) for i in limit}
        element = kind.elementType
    else:
        raise TypeError("unpack: lists or dicts")
    types = column_types if isinstance(column_types, dict) else dict(zip(limit if limit is not None else keys, column_types, strict=False)) if column_types else {}
    types = {name(k): spark_type(t) for k, t in types.items()}
    exprs = {}
    for n, e in pick.items():
        if n in types:
            e = e.try_cast(types[n])
        if na_value is not None:
            e = F.when(missing(e, types.get(n, element)), F.lit(na_value)).otherwise(e)
        exprs[n] = e
    out = Frame.of(series.df.select(*(e.alias(n) for n, e in exprs.items())), series._shared(list(exprs)))
    out._exprs = exprs
    return out


def stack(frame: Frame, name: str, new=None, drop_na: bool = False) -> Frame:
    """A row for each element of a list, or for each entry of a dict; empty ones give a row of missing values, or none."""
    kind = frame.df.schema[name].dataType
    rest = [n for n in frame.df.columns if n != name]
    if isinstance(kind, T.MapType):
        names = list(new) if new is not None else ["K", "V"]
        if len(names) != 2:
            raise ValueError("two names for a dict's keys and values")
        wanted, value_kind = names, kind.valueType
    elif isinstance(kind, T.ArrayType):
        wanted = [new if isinstance(new, str) else new[0] if new else "X"]
        value_kind = kind.elementType
    else:
        raise TypeError("stack: lists or dicts")
    if frame.df.isEmpty():
        raise ValueError("no rows to stack")
    names = []
    for w in wanted:
        names.append(fresh([*rest, *names], w))
    rows = frame.df.select(*map(col, rest), F.explode_outer(col(name)).alias(*names))
    if drop_na:
        rows = rows.where(~missing(col(names[-1]), value_kind)) if len(names) == 1 else rows.where(col(names[0]).isNotNull())
    lineage = frame._lineage
    for n in names:
        lineage = lineage.put(n, frame._lineage.pairs([name]))
    return Frame.of(rows, lineage.select(rows.columns))


def unstack(frame: Frame, column, new: str | None = None) -> Frame:
    """Rows that agree in all other columns as one row with a list, or a dict from two columns."""
    from ..functions.aggregates import CONCAT

    names = [column] if isinstance(column, str) else list(column)
    if len(names) not in (1, 2):
        raise TypeError("unstack: one column, or two")
    frame._check(names)
    return frame.groupby([n for n in frame.df.columns if n not in names], {new or "unstack": CONCAT(*names)})
