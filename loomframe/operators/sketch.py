"""Statistics of a series: one aggregation for the numbers, others only when they are asked for."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F, types as T

from ..functions.missing import undefined
from ..functions.types import MOMENT, NUMERIC
from .series import VALUE, Series


def _as_kind(value, kind):
    """Whole numbers in a list or dict as floats where the type wants floats."""
    if isinstance(kind, T.ArrayType) and isinstance(value, (list, tuple)):
        return [_as_kind(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType) and isinstance(value, dict):
        return {_as_kind(k, kind.keyType): _as_kind(v, kind.valueType) for k, v in value.items()}
    return float(value) if isinstance(kind, (T.DoubleType, T.FloatType)) and type(value) is int else value


class Sketch:
    """Undefined values (null, NaN, infinite) are counted and left out of everything else."""

    def __init__(self, series: Series, sub_sketch_keys=None):
        self.series, self.kind = series, series.kind
        self.keys = list(sub_sketch_keys or [])
        self.items, self.accuracy = 500, 10_000
        self._defined = series.df.where(~undefined(series.expr, self.kind)).select(series.expr.alias(VALUE))

    def set_frequency_sketch_parms(self, num_items=None, epsilon=None, delta=None) -> None:
        self.items = num_items or self.items

    def set_quantile_accumulator_parms(self, num_levels=None, epsilon=None, delta=None) -> None:
        """The rank error of quantiles; levels and confidence have no counterpart, as the summary is deterministic."""
        self.accuracy = int(1 / epsilon) if epsilon else self.accuracy

    @cached_property
    def _stats(self):
        c = F.col(VALUE)
        bad = undefined(self.series.expr, self.kind)
        if isinstance(self.kind, NUMERIC):
            more = [F.min(c), F.max(c), F.sum(c), F.avg(c), F.var_pop(c), F.stddev_pop(c)]
        elif isinstance(self.kind, MOMENT):
            more = [F.min(c), F.max(c), *[F.lit(None)] * 4]
        else:
            more = [F.lit(None)] * 6
        if isinstance(self.kind, T.StringType):
            length = F.avg(F.length(c))
        elif isinstance(self.kind, (T.ArrayType, T.MapType)):
            length = F.avg(F.size(c))
        else:
            length = F.avg(F.lit(1.0))
        names = ("min", "max", "sum", "mean", "var", "std")
        rows = self.series.df.select(self.series.expr.alias(VALUE), bad.alias("bad"))
        whole = rows.agg(F.count_if(~F.col("bad")).alias("size"), F.count_if("bad").alias("undefined")).first()
        good = self._defined.agg(length.alias("length"), *(m.alias(n) for m, n in zip(more, names, strict=True))).first()
        return whole.asDict() | good.asDict()

    def _number(self, name: str, kinds=NUMERIC):
        if not isinstance(self.kind, kinds):
            raise ValueError(f"{name}: not for this type")
        return self._stats[name]

    def size(self) -> int:
        return self._stats["size"]

    def num_undefined(self) -> int:
        return self._stats["undefined"]

    def max(self):
        return self._number("max", (*NUMERIC, *MOMENT))

    def min(self):
        return self._number("min", (*NUMERIC, *MOMENT))

    def sum(self):
        return self._number("sum")

    def mean(self):
        return self._number("mean")

    def std(self):
        return self._number("std")

    def var(self):
        return self._number("var")

    def avg_length(self) -> float:
        return self._stats["length"] or 0

    def _plain(self):
        """Values that can be compared: dicts as their sorted entries."""
        c = F.col(VALUE)
        return F.array_sort(F.map_entries(c)) if isinstance(self.kind, T.MapType) else c

    @cached_property
    def _unique(self) -> int:
        everything = self.series.to_dataframe(VALUE).select(self._plain().alias(VALUE))
        return everything.distinct().count()

    def num_unique(self) -> int:
        """Exact; missing counts as a value."""
        return self._unique

    def _canonical(self):
        """A list or dict as JSON; a dict's entries in one order."""
        c = F.col(VALUE)
        if isinstance(self.kind, T.MapType):
            c = F.array_sort(F.transform(F.map_entries(c), lambda e: F.to_json(e)))
        return F.to_json(F.struct(c.alias(VALUE)))

    @cached_property
    def _frequent(self) -> dict:
        if isinstance(self.kind, (T.ArrayType, T.MapType)):
            rows = self._defined.groupBy(self._canonical().alias("k")).agg(F.count(F.lit(1)).alias("n"), F.first(VALUE).alias("v"))
            got = rows.orderBy(F.desc("n"), "k").limit(self.items).collect()
            return {str(r["v"]): r["n"] for r in got}
        rows = self._defined.groupBy(VALUE).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), VALUE).limit(self.items)
        return {r[VALUE]: r["n"] for r in rows.collect()}

    def frequent_items(self) -> dict:
        """The commonest values and their exact numbers."""
        return dict(self._frequent)

    def frequency_count(self, element) -> int:
        if isinstance(self.kind, (T.ArrayType, T.MapType)):
            schema = T.StructType([T.StructField(VALUE, self.kind)])
            try:
                one = self.series.df.sparkSession.createDataFrame([(_as_kind(element, self.kind),)], schema)
            except (TypeError, ValueError):  # not a value of this type
                return 0
            return self._defined.where(self._canonical() == F.lit(one.select(self._canonical()).first()[0])).count()
        return self._defined.where(F.col(VALUE) == F.lit(element)).count()

    def quantile(self, quantile_val: float):
        if not 0 <= quantile_val <= 1:
            raise ValueError("quantile: from 0 to 1")
        if not isinstance(self.kind, (*NUMERIC, *MOMENT)):
            raise ValueError("quantile: numbers and dates only")
        got = self._defined.agg(F.percentile_approx(F.col(VALUE), quantile_val, self.accuracy)).first()[0]
        return float(got) if isinstance(self.kind, NUMERIC) and got is not None else got

    def cdf(self, value) -> float:
        """The share of values that are at most ``value``."""
        return self._defined.agg(F.avg((F.col(VALUE) <= F.lit(value)).cast("double"))).first()[0]

    def tf_idf(self) -> Series:
        from .text import tf_idf

        return tf_idf(self.series)

    def _inner(self, expr) -> Sketch:
        return Sketch(Series.rows(self._defined.select(expr), self.series._lineage))

    def element_length_summary(self) -> Sketch:
        length = F.length if isinstance(self.kind, T.StringType) else F.size
        return self._inner(length(VALUE))

    def element_summary(self) -> Sketch:
        if not isinstance(self.kind, T.ArrayType):
            raise RuntimeError("element_summary: lists only")
        return self._inner(F.explode(VALUE))

    def dict_key_summary(self) -> Sketch:
        return self._inner(F.explode(F.map_keys(VALUE)))

    def dict_value_summary(self) -> Sketch:
        return self._inner(F.explode(F.map_values(VALUE)))

    def element_sub_sketch(self, keys=None) -> dict:
        """A sketch for each of some keys of dicts, or indexes of lists."""
        keys = self.keys if keys is None else keys if isinstance(keys, (list, tuple)) else [keys]
        at = (lambda k: F.try_element_at(F.col(VALUE), F.lit(k))) if isinstance(self.kind, T.MapType) else (lambda k: F.get(F.col(VALUE), F.lit(k)))
        return {k: self._inner(at(k)) for k in keys}

    def __repr__(self) -> str:
        lines = [f"size {self.size()}, undefined {self.num_undefined()}, unique {self.num_unique()}"]
        if isinstance(self.kind, NUMERIC):
            lines.append(f"min {self.min()}, max {self.max()}, mean {self.mean()}, std {self.std()}, sum {self.sum()}")
        lines += [f"  {v!r}: {n}" for v, n in list(self.frequent_items().items())[:10]]
        return "\n".join(lines)
