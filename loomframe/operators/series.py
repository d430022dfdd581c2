"""A column of values: an expression over the rows of a DataFrame.

A series taken from a frame is not data. As long as two series, or a series and a frame, stand on the same rows, they
compose into one expression that Catalyst sees whole; only series on different rows are aligned by position.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from ..functions.missing import missing, truthy
from ..functions.types import FLOATING, MOMENT, NUMERIC, classify_all, fit, infer, parse_moment, spark_type, tag, text_cast
from ..plans.lineage import CONST, PROGRAM, RANGE, Lineage
from ..plans.order import POSITION, aligned, row_order, with_position
from ..plans.session import session

VALUE = "value"
_STRFTIME = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%b": "MMM",
    "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%p": "a", "%j": "DDD", "%Z": "", "%z": "xx", "%%": "%",
}


def java_pattern(text: str) -> str:
    """A strftime pattern as Spark's date pattern; letters outside of directives are quoted."""
    out, i = "", 0
    while i < len(text):
        if text[i] == "%" and text[i : i + 2] in _STRFTIME:
            out, i = out + _STRFTIME[text[i : i + 2]], i + 2
        else:
            out, i = out + (f"'{text[i]}'" if text[i].isalpha() else text[i]), i + 1
    return out.replace("''", "")


class Series:
    """See the module. ``df`` and ``expr`` are the rows and the expression; ``uses`` names the columns that it reads."""

    def __init__(self, data=None, dtype=None, ignore_cast_failure: bool = False):
        spark = session()
        if isinstance(data, str):
            self._take(read_series(spark, data, dtype))
            return
        if isinstance(data, Series):
            self._take(data if dtype is None else data.astype(dtype, ignore_cast_failure))
            return
        values = [] if data is None else [v.item() if hasattr(v, "item") else v for v in data]
        values = [v.tolist() if hasattr(v, "tolist") else list(v) if isinstance(v, tuple) else v for v in values]
        values = [None if v is not v else v for v in values] if dtype is int else values
        if dtype is None:
            kind = infer(values)
        else:
            kind, cast = spark_type(dtype, values), []
            for v in values:
                try:
                    cast.append(parse_moment(v) if dtype is datetime.datetime and isinstance(v, str) else fit(v, kind))
                except (TypeError, ValueError):
                    if not ignore_cast_failure:
                        raise ValueError(f"cannot take {v!r} as {kind.simpleString()}") from None
                    cast.append(None)
            values = cast
        rows = [(fit(v, kind),) for v in values]
        self._set(spark.createDataFrame(rows, T.StructType([T.StructField(VALUE, kind)])), F.col(VALUE), {VALUE}, Lineage.of(PROGRAM, [VALUE]))

    # --- construction -------------------------------------------------------------------------------------------
    def _set(self, df: DataFrame, expr: Column, uses: Iterable[str], lineage: Lineage) -> None:
        self.df, self.expr, self.uses, self._lineage = df, expr, frozenset(uses), lineage
        self._kind: T.DataType | None = None
        self._size: int | None = None
        # DataFrames with the same rows that ``df`` was made from, with the columns that have changed since
        self._before: dict[int, tuple[DataFrame, frozenset[str]]] = {}

    def _take(self, other: Series) -> None:
        self._set(other.df, other.expr, other.uses, other._lineage)

    @classmethod
    def over(cls, df: DataFrame, expr: Column, uses: Iterable[str], lineage: Lineage | None = None, before: dict | None = None) -> Series:
        out = cls.__new__(cls)
        out._set(df, expr, uses, lineage or Lineage())
        out._before = before or {}
        return out

    @classmethod
    def rows(cls, df: DataFrame, lineage: Lineage | None = None) -> Series:
        """Of a DataFrame with one column."""
        df = df.toDF(VALUE)
        return cls.over(df, F.col(VALUE), {VALUE}, lineage)

    @classmethod
    def from_const(cls, value, size: int) -> Series:
        if not isinstance(size, int) or size <= 0:
            raise ValueError("size: a positive integer")
        kind = infer([value])
        return cls.rows(session().range(size).select(F.lit(value).cast(kind)), Lineage.of(CONST, [VALUE]))

    @classmethod
    def from_sequence(cls, start: int, stop: int | None = None) -> Series:
        low, high = (0, start) if stop is None else (start, stop)
        return cls.rows(session().range(low, max(low, high)).toDF(VALUE), Lineage.of(RANGE, [VALUE]))

    @classmethod
    def from_rdd(cls, rdd, dtype) -> Series:
        kind = spark_type(dtype)
        return cls.rows(session().createDataFrame(rdd.map(lambda v: (v,)), T.StructType([T.StructField(VALUE, kind)])), Lineage.of("RDD", [VALUE]))

    @classmethod
    def read_text(cls, path: str, delimiter: str | None = None, nrows: int | None = None) -> Series:
        from ..sources.readers import text_lines

        return cls.rows(text_lines(session(), path, delimiter, nrows), Lineage.of(path, [VALUE]))

    # --- what it is ---------------------------------------------------------------------------------------------
    @property
    def kind(self) -> T.DataType:
        if self._kind is None:
            self._kind = self.df.select(self.expr).schema[0].dataType
        return self._kind

    def dtype(self) -> type:
        return tag(self.kind)

    def lineage(self) -> dict:
        return {"table": set(self._lineage.table), "column": set(self._lineage.pairs(self._lineage.columns))}

    def to_dataframe(self, name: str = VALUE) -> DataFrame:
        return self.df.select(self.expr.alias(name))

    def size(self) -> int:
        if self._size is None:
            self._size = self.df.count()
        return self._size

    __len__ = size

    def __bool__(self) -> bool:
        return not self.df.isEmpty()

    def __iter__(self):
        return (r[0] for r in self.to_dataframe().toLocalIterator(prefetchPartitions=True))

    def head_as_list(self, n: int = 10) -> list:
        return [r[0] for r in self.to_dataframe().take(n)]

    def __repr__(self) -> str:
        got = self.head_as_list(101)
        return "[" + ", ".join(map(repr, got[:100])) + (", ... ]" if len(got) > 100 else "]")

    __str__ = __repr__

    def explain(self) -> None:
        self.to_dataframe().explain("formatted")

    dump_debug_info = explain

    # --- composition --------------------------------------------------------------------------------------------
    def _with(self, expr: Column) -> Series:
        return Series.over(self.df, expr, self.uses, self._lineage, self._before)

    def _stands_on(self, other: Series) -> bool:
        """Whether this series reads columns that the other one's rows still have as they were."""
        known = other._before.get(id(self.df))
        return self.df is other.df or bool(known and not known[1] & self.uses)

    def _pair(self, other: Series) -> tuple[DataFrame, Column, Column, frozenset[str]]:
        """Both as expressions over the same rows."""
        if other._stands_on(self):
            return self.df, self.expr, other.expr, self.uses | other.uses
        if self._stands_on(other):
            return other.df, self.expr, other.expr, self.uses | other.uses
        both, names = aligned(self.to_dataframe("__left"), other.to_dataframe("__value"))
        right = names["__value"]
        return both, F.col("__left"), F.col(right), frozenset({"__left", right})

    def _binary(self, other, op: Callable[[Column, Column, T.DataType, T.DataType], Column], swap: bool = False) -> Series:
        if isinstance(other, Series):
            df, a, b, uses = self._pair(other)
            ka, kb, lineage = self.kind, other.kind, self._lineage.merge(other._lineage)
        else:
            df, a, uses, lineage = self.df, self.expr, self.uses, self._lineage
            ka = self.kind
            kb = ka if other is None else infer([other])
            b = F.lit(other).cast(kb)
        if swap:
            a, b, ka, kb = b, a, kb, ka
        before = self._before if df is self.df else other._before if df is other.df else {}
        return Series.over(df, op(a, b, ka, kb), uses, lineage, before)

    def __add__(self, other):
        return self._binary(other, _plus)

    def __radd__(self, other):
        return self._binary(other, _plus, swap=True)

    def __sub__(self, other):
        return self._binary(other, lambda a, b, *_: a - b)

    def __rsub__(self, other):
        return self._binary(other, lambda a, b, *_: a - b, swap=True)

    def __mul__(self, other):
        return self._binary(other, _times)

    def __rmul__(self, other):
        return self._binary(other, _times, swap=True)

    def __truediv__(self, other):
        return self._binary(other, _over)

    __div__ = __floordiv__ = __truediv__

    def __rtruediv__(self, other):
        return self._binary(other, _over, swap=True)

    __rdiv__ = __rfloordiv__ = __rtruediv__

    def __pow__(self, power):
        def raised(a, b, ka, kb):
            whole = isinstance(ka, NUMERIC) and not isinstance(ka, FLOATING) and isinstance(kb, T.LongType)
            return F.pow(a, b).cast("long") if whole and power >= 0 else F.pow(a, b)

        return self._binary(power, raised)

    def __lt__(self, other):
        return self._binary(other, lambda a, b, *_: a < b)

    def __le__(self, other):
        return self._binary(other, lambda a, b, *_: a <= b)

    def __gt__(self, other):
        return self._binary(other, lambda a, b, *_: a > b)

    def __ge__(self, other):
        return self._binary(other, lambda a, b, *_: a >= b)

    def __eq__(self, other):
        return self._binary(other, lambda a, b, *_: a.eqNullSafe(b))

    def __ne__(self, other):
        return self._binary(other, lambda a, b, *_: ~a.eqNullSafe(b))

    __hash__ = None

    def __and__(self, other):
        return self._binary(other, lambda a, b, ka, kb: truthy(a, ka) & truthy(b, kb))

    def __or__(self, other):
        return self._binary(other, lambda a, b, ka, kb: truthy(a, ka) | truthy(b, kb))

    def __neg__(self):
        return self._with(-self.expr)

    def __pos__(self):
        return self

    def __abs__(self):
        return self._with(F.abs(self.expr))

    # --- rows ---------------------------------------------------------------------------------------------------
    def __getitem__(self, key):
        if isinstance(key, Series):
            if key.df is not self.df and key.size() != self.size():
                raise IndexError("mask and series differ in length")
            df, a, b, _ = self._pair(key)
            return Series.rows(df.where(truthy(b, key.kind)).select(a), self._lineage)
        if isinstance(key, slice):
            return Series.rows(sliced(self.to_dataframe(), key, self.size), self._lineage)
        if isinstance(key, int):
            at = key + self.size() if key < 0 else key
            got = row_at(self.to_dataframe(), at) if at >= 0 else None
            if got is None:
                raise IndexError("index out of range")
            return got[0]
        raise IndexError(f"cannot index by {type(key).__name__}")

    def head(self, n: int = 10) -> Series:
        return self[: max(0, n)]

    def tail(self, n: int = 10) -> Series:
        return self[-n:] if n > 0 else self[:0]

    def sample(self, fraction: float, max_partitions: int | None = None, seed: int | None = None) -> Series:
        if not 0 <= fraction <= 1:
            raise ValueError("fraction: from 0 to 1")
        got = self.to_dataframe().sample(False, fraction, seed)
        return Series.rows(got.coalesce(max_partitions) if max_partitions else got, self._lineage)

    def append(self, other: Series) -> Series:
        if not isinstance(other, Series):
            raise RuntimeError("append: a series")
        if self.kind != other.kind:
            raise RuntimeError("append: both series must have one type")
        return Series.rows(self.to_dataframe().union(other.to_dataframe()), self._lineage.merge(other._lineage))

    def unique(self) -> Series:
        if isinstance(self.kind, T.MapType):
            raise TypeError("unique: not for dicts")
        return Series.rows(self.to_dataframe().distinct(), self._lineage)

    def sort(self, ascending: bool = True) -> Series:
        if not isinstance(self.kind, (T.StringType, *NUMERIC, *MOMENT)):
            raise TypeError("sort: strings, numbers and dates only")
        c = F.col(VALUE)
        return Series.rows(self.to_dataframe().orderBy(c.asc() if ascending else c.desc()), self._lineage)

    def topk_index(self, topk: int = 10, reverse: bool = False) -> Series:
        """A mask of the k largest (or smallest) values; of equal values the earlier ones."""
        if not isinstance(topk, int):
            raise TypeError("topk: an integer")
        rows = with_position(self.to_dataframe())
        order = F.col(VALUE).asc() if reverse else F.col(VALUE).desc()
        best = rows.orderBy(order, POSITION).limit(topk).select(F.col(POSITION).alias("__best"))
        marked = rows.join(best, F.col(POSITION) == F.col("__best"), "left").orderBy(POSITION)
        return Series.rows(marked.select(F.col("__best").isNotNull()), self._lineage)

    def filter(self, fn, skip_undefined: bool = True) -> Series:
        """Values for which ``fn`` is true in Python's sense: a function of a value, or one marked ``columnwise``."""
        test = self._applied(fn if getattr(fn, "columnwise", False) else lambda v: bool(fn(v)), T.BooleanType(), skip_undefined)
        return Series.rows(self.df.where(F.coalesce(test, F.lit(False))).select(self.expr), self._lineage)

    def dropna(self) -> Series:
        return Series.rows(self.df.where(~missing(self.expr, self.kind)).select(self.expr), self._lineage)

    def fillna(self, value) -> Series:
        return self._with(F.when(missing(self.expr, self.kind), F.lit(value)).otherwise(self.expr))

    def countna(self) -> int:
        return self._one(F.count_if(missing(self.expr, self.kind)))

    num_missing = countna

    # --- functions of a value -----------------------------------------------------------------------------------
    def _applied(self, fn, kind: T.DataType | None, skip_undefined: bool) -> Column:
        out = native(fn, self.expr, kind)
        if out is not None:
            return out
        if kind is None:
            kind = infer([fn(v) for v in self.head_as_list(100) if not (skip_undefined and v is None)])
        # Spark may compute a UDF before the condition around it, so the function itself passes over what is undefined
        call = F.udf(lambda v: None if skip_undefined and v is None else fit(fn(v), kind), kind, useArrow=True)
        if not skip_undefined:
            return call(self.expr)
        gone = missing(self.expr, self.kind)
        return F.when(~gone, call(F.when(~gone, self.expr)))

    def apply(self, fn, dtype=None, skip_undefined: bool = True, seed: int | None = None) -> Series:
        """``fn`` of each value; missing values give missing unless ``skip_undefined`` is off.

        It runs in Python, in Arrow batches, with Python's meaning; a function marked ``columnwise`` gets a Column and
        stays in the plan. The result has ``dtype``, or the type of the first results.
        """
        kind = None if dtype is None else spark_type(dtype, () if dtype not in (list, dict) else [fn(v) for v in self.head_as_list(100) if v is not None])
        return self._with(self._applied(fn, kind, skip_undefined))

    def flat_map(self, fn=None, dtype=None, skip_undefined: bool = True) -> Series:
        if fn is None:
            lists = self.expr
        else:
            if dtype is not None:
                kind = T.ArrayType(spark_type(dtype))
            elif getattr(fn, "columnwise", False):
                kind = None
            else:
                kind = T.ArrayType(infer([x for v in self.head_as_list(100) if v is not None for x in fn(v)]))
            lists = self._applied(fn, kind, skip_undefined)
        rows = self.df.select(F.explode(lists).alias(VALUE))
        got = Series.rows(rows, self._lineage)
        return got.dropna() if skip_undefined else got

    def astype(self, dtype, undefined_on_failure: bool = False) -> Series:
        kind = self.kind
        target = spark_type(dtype) if dtype not in (list, dict) else None
        if isinstance(kind, T.StringType):
            element = spark_type(dtype, self._literals(dtype)) if target is None else None
            cast = text_cast(self.expr, tag(target) if target is not None else dtype, element, empty_is_zero=True)
            if undefined_on_failure or dtype is str:
                return self._with(cast)
            return self._with(F.when(self.expr.isNotNull() & cast.isNull() & (F.trim(self.expr) != ""), F.raise_error(F.lit("astype: a value does not read as the type"))).otherwise(cast))
        if isinstance(target, T.StringType):
            if isinstance(kind, (T.ArrayType, T.MapType)):
                return self._with(F.to_json(self.expr))
            return self._with(F.coalesce(self.expr.cast("string"), F.lit("None")))
        target = target or spark_type(dtype, self.head_as_list(100))
        return self._with(self.expr.try_cast(target) if undefined_on_failure else self.expr.cast(target))

    def _literals(self, dtype) -> list:
        from ..functions.types import parse_literal

        return [v for v in (parse_literal(t, dtype) for t in self.head_as_list(100)) if v is not None]

    def clip(self, lower=None, upper=None) -> Series:
        def bound(c: Column) -> Column:
            low, high = (None if b is None or b != b else b for b in (lower, upper))
            if low is not None:
                c = F.when(c < low, F.lit(low)).otherwise(c)
            return c if high is None else F.when(c > high, F.lit(high)).otherwise(c)

        if isinstance(self.kind, T.ArrayType):
            return self._with(F.transform(self.expr, bound))
        if not isinstance(self.kind, NUMERIC):
            raise TypeError("clip: numbers or lists of numbers")
        return self._with(bound(self.expr))

    def clip_lower(self, threshold) -> Series:
        return self.clip(lower=threshold)

    def clip_upper(self, threshold) -> Series:
        return self.clip(upper=threshold)

    def datetime_to_str(self, str_format: str = "%Y-%m-%dT%H:%M:%S") -> Series:
        if not isinstance(self.kind, MOMENT):
            raise TypeError("datetime_to_str: dates only")
        return self._with(F.date_format(self.expr, java_pattern(str_format)))

    def str_to_datetime(self, str_format: str | None = None) -> Series:
        if not isinstance(self.kind, T.StringType):
            raise TypeError("str_to_datetime: strings only")
        if str_format is None:
            return self._with(text_cast(self.expr, datetime.datetime))
        return self._with(F.try_to_timestamp(self.expr, F.lit(java_pattern(str_format))).cast("timestamp_ntz"))

    PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}

    def split_datetime(self, column_name_prefix: str | None = "X", limit=None):
        from .frame import Frame

        if not isinstance(self.kind, MOMENT):
            raise TypeError("split_datetime: dates only")
        wanted = list(self.PARTS) if limit is None else [limit] if isinstance(limit, str) else list(limit)
        if set(wanted) - set(self.PARTS):
            raise ValueError(f"limit: of {', '.join(self.PARTS)}")
        name = (lambda p: f"{column_name_prefix}.{p}") if column_name_prefix else (lambda p: p)
        return Frame.of(self.df.select(*(fn(self.expr).cast("long").alias(name(p)) for p, fn in self.PARTS.items() if p in wanted)), self._shared([name(p) for p in wanted]))

    def _shared(self, names) -> Lineage:
        return Lineage(self._lineage.table, {n: self._lineage.pairs(self._lineage.columns) for n in names})

    def vector_slice(self, start: int, end: int | None = None) -> Series:
        if not isinstance(self.kind, T.ArrayType):
            raise TypeError("vector_slice: lists only")
        if end is None:
            return self._with(F.get(self.expr, F.lit(start)))
        return self._with(F.when(F.size(self.expr) >= end, F.slice(self.expr, start + 1, end - start)))

    def item_length(self) -> Series:
        length = F.length if isinstance(self.kind, T.StringType) else F.size
        if not isinstance(self.kind, (T.StringType, T.ArrayType, T.MapType)):
            raise TypeError("item_length: strings, lists and dicts only")
        return self._with(F.when(self.expr.isNotNull(), length(self.expr).cast("long")))

    # --- dicts --------------------------------------------------------------------------------------------------
    def _dict(self) -> Column:
        if not isinstance(self.kind, T.MapType):
            raise TypeError("dicts only")
        return self.expr

    def dict_trim_by_keys(self, keys, exclude: bool = True) -> Series:
        keys = list(keys)
        return self._with(F.map_filter(self._dict(), lambda k, v: ~k.isin(keys) if exclude else k.isin(keys)))

    def dict_trim_by_values(self, lower=None, upper=None) -> Series:
        def within(k, v):
            test = F.lit(True) if lower is None else v >= lower
            return test if upper is None else test & (v <= upper)

        return self._with(F.map_filter(self._dict(), within))

    def dict_has_any_keys(self, keys) -> Series:
        return self._with(F.arrays_overlap(F.map_keys(self._dict()), F.array(*map(F.lit, _listed(keys)))))

    def dict_has_all_keys(self, keys) -> Series:
        return self._with(F.size(F.array_except(F.array(*map(F.lit, _listed(keys))), F.map_keys(self._dict()))) == 0)

    def _columns_of(self, lists: Column):
        from .frame import Frame

        sizes = self.df.agg(F.min(F.size(lists)), F.max(F.size(lists))).first()
        if sizes[0] != sizes[1]:
            raise ValueError("the dicts differ in length")
        names = [f"X.{i}" for i in range(sizes[0] or 0)]
        return Frame.of(self.df.select(*(F.get(lists, F.lit(i)).alias(n) for i, n in enumerate(names))), self._shared(names))

    def dict_keys(self):
        return self._columns_of(F.map_keys(self._dict()))

    def dict_values(self):
        return self._columns_of(F.map_values(self._dict()))

    # --- reshape ------------------------------------------------------------------------------------------------
    def unpack(self, column_name_prefix: str | None = "X", column_types=None, na_value=None, limit=None):
        from .reshape import unpacked

        return unpacked(self, column_name_prefix, column_types, na_value, limit)

    # --- reductions ---------------------------------------------------------------------------------------------
    def _one(self, expr: Column):
        return self.df.agg(expr).first()[0]

    def _numeric(self) -> Column:
        if not isinstance(self.kind, NUMERIC):
            raise TypeError("numbers only")
        return self.expr

    def all(self) -> bool:
        return self._one(F.coalesce(F.bool_and(truthy(self.expr, self.kind)), F.lit(True)))

    def any(self) -> bool:
        return self._one(F.coalesce(F.bool_or(truthy(self.expr, self.kind)), F.lit(False)))

    def max(self):
        return self._one(F.max(self._numeric()))

    def min(self):
        return self._one(F.min(self._numeric()))

    def mean(self):
        return self._one(F.avg(self._numeric()))

    def std(self, ddof: int = 0):
        return self._one({0: F.stddev_pop, 1: F.stddev_samp}[_ddof(ddof)](self._numeric()))

    def var(self, ddof: int = 0):
        return self._one({0: F.var_pop, 1: F.var_samp}[_ddof(ddof)](self._numeric()))

    def sum(self):
        """Of numbers; of lists element by element; of dicts over the keys that all of them have."""
        if isinstance(self.kind, T.ArrayType):
            parts = self.df.select(F.posexplode(self.expr).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
            return [r["v"] for r in parts] or None
        if isinstance(self.kind, T.MapType):
            n = self.df.where(self.expr.isNotNull()).count()
            parts = self.df.select(F.explode(self.expr).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
            return {r["k"]: r["v"] for r in parts.where(F.col("n") == n).collect()} if n else None
        return self._one(F.sum(self._numeric()))

    def nnz(self) -> int:
        return self._one(F.count_if(~missing(self.expr, self.kind) & truthy(self.expr, self.kind)))

    # --- text ---------------------------------------------------------------------------------------------------
    def _count_words(self, to_lower: bool = True) -> Series:
        from .text import word_counts

        return self._with(word_counts(self.expr, to_lower))

    def _count_ngrams(self, n: int = 2, method: str = "word", to_lower: bool = True, ignore_space: bool = True) -> Series:
        from .text import ngram_counts

        return self._with(ngram_counts(self.expr, n, method, to_lower, ignore_space))

    def sketch_summary(self, sub_sketch_keys=None):
        from .sketch import Sketch

        return Sketch(self, sub_sketch_keys)

    # --- out ----------------------------------------------------------------------------------------------------
    def to_rdd(self, number_of_partitions: int = 4):
        return self.to_dataframe().repartition(number_of_partitions).rdd.map(lambda r: r[0])

    def save(self, filename: str, format: str | None = None, one_file: bool = True) -> None:
        """CSV and text are one file; without ``one_file`` a folder of files, written in parallel, for large tables."""
        from ..sources.writers import save_series

        save_series(self, filename, format, one_file)


def columnwise(fn: Callable) -> Callable:
    """Mark a function as one from Column to Column, which ``apply``, ``filter``, ``flat_map`` and ``filterby`` keep in the plan.

    Only marked functions are given a Column: the operators of a Column mean something else than Python's on values
    (the sign of %, / of integers, + of strings), so an unmarked function always gets values.
    """
    fn.columnwise = True
    return fn


def native(fn, c: Column, kind: T.DataType | None = None) -> Column | None:
    """fn(c), as ``kind`` where it is given, for a function marked ``columnwise``; None for a function of values."""
    if not getattr(fn, "columnwise", False):
        return None
    return fn(c) if kind is None else fn(c).cast(kind)


def _listed(keys) -> list:
    return list(keys) if isinstance(keys, (list, tuple, set, frozenset)) else [keys]


def _ddof(ddof: int) -> int:
    if ddof not in (0, 1):
        raise ValueError("ddof: 0 or 1")
    return ddof


def _plus(a, b, ka, kb):
    return F.concat(a, b) if isinstance(ka, (T.StringType, T.ArrayType)) else a + b


def _times(a, b, ka, kb):
    return F.repeat(a, b.cast("int")) if isinstance(ka, T.StringType) else F.flatten(F.array_repeat(a, b.cast("int"))) if isinstance(ka, T.ArrayType) else a * b


def _over(a, b, ka, kb):
    """Between integers, the floor of the quotient."""
    if isinstance(ka, FLOATING) or isinstance(kb, FLOATING):
        return a / b
    return F.floor(a / b)


#: Positions up to which a slice reads that many rows in one task; slices further on go by row positions.
NEAR = 10_000


def last_rows(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` of at most ``NEAR`` rows: each task keeps its own last ones, and these are merged, without a count."""
    names = [f"c{i}" for i in range(len(df.columns))]
    marked = df.toDF(*names).withColumn(POSITION, row_order())
    return marked.orderBy(F.desc(POSITION)).limit(n).orderBy(POSITION).drop(POSITION).toDF(*df.columns)


def sliced(df: DataFrame, key: slice, size: Callable[[], int]) -> DataFrame:
    """Rows by position; bounds from the end need the number of rows, a beginning or an end alone does not."""
    step = 1 if key.step is None else key.step
    if step < 1:
        raise IndexError("step: positive")
    start, stop = key.start or 0, key.stop
    if step == 1 and stop is None and -NEAR <= start < 0:
        return last_rows(df, -start)
    if start < 0 or (stop is not None and stop < 0):
        n = size()
        start, stop = (None if v is None else max(0, v + n) if v < 0 else v for v in (start, stop))
    if step == 1 and start == 0 and stop is None:
        return df
    if step == 1 and stop is not None and stop <= NEAR:
        return df.offset(start).limit(max(0, stop - start)) if start else df.limit(stop)
    c = F.col(POSITION)
    keep = (c >= start) & ((c - start) % step == 0)
    rows = with_position(df)
    return rows.where(keep if stop is None else keep & (c < stop)).orderBy(POSITION).drop(POSITION)


def row_at(df: DataFrame, at: int) -> Row | None:
    """The row at a position, or None beyond the last one."""
    got = sliced(df, slice(at, at + 1), df.count).collect()
    return got[0] if got else None


def read_series(spark: SparkSession, path: str, dtype) -> Series:
    """A saved series, or the lines of a text file with their type found from the first 100."""
    from ..sources.readers import is_directory

    if is_directory(spark, path) and not path.endswith((".txt", ".csv")):
        got = Series.rows(spark.read.parquet(path), Lineage.of(path, [VALUE]))
        return got if dtype is None else got.astype(dtype)
    lines = spark.read.text(path)
    kind = dtype or classify_all(r[0] for r in lines.take(100))
    got = Series.rows(lines, Lineage.of(path, [VALUE]))
    return got if kind is str else got.astype(kind, undefined_on_failure=True)
