"""A table: a DataFrame, and where its columns come from.

Methods return new frames; only assignment and deletion of columns change a frame, by pointing it to a new DataFrame.
Everything is a lazy plan until something asks for rows or counts.
"""

from __future__ import annotations

import copy
import datetime
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.aggregates import Aggregator, kinds_of, resolve
from ..functions.missing import missing, truthy
from ..functions.types import MOMENT, NUMERIC, classify_all, fit, infer, spark_type, tag, text_cast
from ..plans.lineage import COUNT, DATAFRAME, EMPTY, HIVE, INDEX, PANDAS, PROGRAM, RDD, Lineage
from ..plans.order import POSITION, aligned, fresh, quoted, row_order, with_position
from ..plans.session import session
from ..plans.store import stash
from .quantiles import exact_quantiles
from .series import Series, native, row_at, sliced


def col(name: str) -> Column:
    return F.col(quoted(name))


class Frame:
    """See the module. ``df`` is the DataFrame."""

    def __init__(self, data=None, format: str = "auto"):
        df, lineage = _load(data, format)
        self._set(df, lineage)

    def _set(self, df: DataFrame, lineage: Lineage, keeps: dict | None = None) -> None:
        self.df, self._lineage, self._rows = df, lineage, None
        # DataFrames with the same rows that this one was made from, with the columns that have changed since
        self._before: dict[int, tuple[DataFrame, frozenset[str]]] = keeps or {}

    @classmethod
    def of(cls, df: DataFrame, lineage: Lineage | None = None) -> Frame:
        out = cls.__new__(cls)
        out._set(df, lineage or Lineage.of(DATAFRAME, df.columns))
        return out

    def _next(self, df: DataFrame, lineage: Lineage | None = None) -> Frame:
        return Frame.of(df, lineage or self._lineage.select(df.columns))

    @classmethod
    def empty(cls) -> Frame:
        return cls()

    @classmethod
    def from_rdd(cls, rdd, column_names=None, column_types=None) -> Frame:
        first = rdd.first()
        names = list(column_names) if column_names else [f"X.{i}" for i in range(len(first))]
        if len(names) != len(first) or (column_types and len(column_types) != len(first)):
            raise ValueError("names and types: one for each column")
        sample = rdd.take(100)
        kinds = [spark_type(t) for t in column_types] if column_types else [infer(r[i] for r in sample) for i in range(len(first))]
        schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])
        rows = rdd.map(lambda r: tuple(fit(v, k) for v, k in zip(r, kinds, strict=True)))
        return cls.of(session().createDataFrame(rows, schema), Lineage.of(RDD, names))

    @classmethod
    def from_series(cls, series: Series, name: str = "X.0") -> Frame:
        return cls.of(series.to_dataframe(name), series._shared([name]))

    @classmethod
    def read_csv(cls, url, **options) -> Frame:
        from ..sources.readers import read_csv

        return read_csv(url, **options)[0]

    @classmethod
    def read_csv_with_errors(cls, url, **options) -> tuple[Frame, dict[str, Series]]:
        from ..sources.readers import read_csv

        return read_csv(url, errors=True, **options)

    @classmethod
    def read_text(cls, path, delimiter: str | None = None, nrows: int | None = None) -> Frame:
        from ..sources.readers import text_lines

        return cls.of(text_lines(session(), path, delimiter, nrows), Lineage.of(path, ["text"]))

    @classmethod
    def read_parquet(cls, url: str) -> Frame:
        df = session().read.parquet(url)
        return cls.of(df, Lineage.of(url, df.columns))

    @classmethod
    def load(cls, filename: str) -> Frame:
        from ..sources.readers import load_frame

        return load_frame(filename)

    # --- what it is ---------------------------------------------------------------------------------------------
    def column_names(self) -> list[str]:
        return list(self.df.columns)

    def column_types(self) -> list[type]:
        return [tag(f.dataType) for f in self.df.schema.fields]

    dtype = column_types

    def num_columns(self) -> int:
        return len(self.df.columns)

    num_cols = num_columns

    def num_rows(self) -> int:
        if self._rows is None:
            self._rows = self.df.count() if self.df.columns else 0
        return self._rows

    __len__ = num_rows

    @property
    def shape(self) -> tuple[int, int]:
        return self.num_rows(), self.num_columns()

    def width(self) -> Series:
        return Series.over(self.df, F.lit(len(self.df.columns)).cast("long"), ())

    def __bool__(self) -> bool:
        return bool(self.df.columns) and not self.df.isEmpty()

    def __contains__(self, name: str) -> bool:
        return name in self.df.columns

    def __copy__(self) -> Frame:
        out = Frame.of(self.df, self._lineage)
        out._before = dict(self._before)
        return out

    def lineage(self) -> dict:
        return self._lineage.as_dict()

    def explain(self) -> None:
        self.df.explain("formatted")

    dump_debug_info = explain

    def _get_content_identifier(self) -> int:
        return self.df.semanticHash()

    def materialize(self) -> Frame:
        self.df = self.df.persist()
        self.num_rows()
        return self

    def __iter__(self):
        return (r.asDict() for r in self.df.toLocalIterator(prefetchPartitions=True))

    def head_as_list(self, n: int = 10) -> list:
        return [tuple(r) for r in self.df.take(n)]

    def __str__(self) -> str:
        from .display import table

        return table(self)

    __repr__ = __str__

    def print_rows(self, num_rows: int = 10, num_columns: int = 40, max_column_width: int = 30, max_row_width: int | None = None) -> None:
        from .display import table

        print(table(self, num_rows, num_columns, max_column_width, max_row_width))

    # --- columns ------------------------------------------------------------------------------------------------
    def _check(self, names: Iterable[str], error: type[Exception] = ValueError) -> None:
        for n in names:
            if not isinstance(n, str):
                raise TypeError("column names are strings")
            if n not in self.df.columns:
                raise error(f"no column {n!r}")

    def select_column(self, column_name: str) -> Series:
        if not isinstance(column_name, str):
            raise TypeError("a column name is a string")
        self._check([column_name])
        return Series.over(self.df, col(column_name), {column_name}, self._lineage.select([column_name]), self._before)

    def select_columns(self, keylist) -> Frame:
        names = list(keylist)
        if any(not isinstance(n, str) for n in names):
            raise TypeError("column names are strings")
        if len(set(names)) != len(names):
            raise ValueError("a column is named twice")
        self._check(names)
        return self._next(self.df.select(*map(col, names)))

    def _here(self, series: Series) -> Column | None:
        """A series as an expression over the present rows, if it stands on them."""
        if series.df is self.df:
            return series.expr
        known = self._before.get(id(series.df))
        return series.expr if known and not known[1] & series.uses else None

    def _put(self, new: dict[str, object], order: list[str] | None = None) -> tuple[DataFrame, Lineage, dict]:
        """This frame's rows with columns added or replaced: series, or constants."""
        names = list(self.df.columns)
        lineage = self._lineage
        if not names:
            first = next(v for v in new.values() if isinstance(v, Series))
            frame = Frame.from_series(first, next(n for n, v in new.items() if v is first))
            rest = {n: v for n, v in new.items() if v is not first}
            return frame._put(rest) if rest else (frame.df, frame._lineage, {})
        away = {n: v for n, v in new.items() if isinstance(v, Series) and self._here(v) is None}
        df, keeps = self.df, dict(self._before)
        exprs: dict[str, Column] = {n: col(n) for n in names}
        for n, v in new.items():
            if isinstance(v, Series):
                lineage = lineage.put(n, v._lineage.pairs(v._lineage.columns), v._lineage.table)
                if n not in away:
                    exprs[n] = self._here(v)
            else:
                lineage = lineage.put(n, frozenset([("CONST", n)]))
                exprs[n] = F.lit(v)
        if away:
            df = df.select(*(e.alias(n) for n, e in exprs.items() if n not in away or n in names))
            exprs = {n: col(n) for n in [*names, *(n for n in new if n not in names)]}
            by_rows: dict[int, list[str]] = {}
            for n, v in away.items():
                by_rows.setdefault(id(v.df), []).append(n)
            for group in by_rows.values():
                right = away[group[0]].df.select(*(away[n].expr.alias(f"v{i}") for i, n in enumerate(group)))
                df, renamed = aligned(df, right)
                for i, n in enumerate(group):
                    exprs[n] = F.col(renamed[f"v{i}"])
                # what was aligned so far is a plain column from here on
                df = df.select(*(e.alias(n) for n, e in exprs.items() if n in df.columns or n in group or n in names))
                exprs = {n: col(n) for n in exprs}
            keeps = {}
        out = df.select(*(e.alias(n) for n, e in exprs.items()))
        if not away:
            changed = frozenset(new)
            keeps = {k: (d, c | changed) for k, (d, c) in keeps.items()}
            keeps[id(self.df)] = (self.df, changed)
        return out, lineage.select(out.columns), keeps

    def add_column(self, column, name: str = "") -> Frame:
        if not isinstance(column, Series):
            raise TypeError("add_column: a series")
        name = fresh(self.df.columns, name or f"X.{len(self.df.columns)}")
        df, lineage, _ = self._put({name: column})
        return Frame.of(df, lineage)

    def add_columns(self, columns, namelist=None) -> Frame:
        if isinstance(columns, Frame):
            names, taken = {}, list(self.df.columns)
            for n in columns.df.columns:
                names[n] = fresh(taken, n)
                taken.append(names[n])
            columns, namelist = [columns.select_column(n) for n in names], list(names.values())
        columns, namelist = list(columns), list(namelist or [])
        if len(columns) != len(namelist):
            raise ValueError("one name for each column")
        if any(not isinstance(c, Series) for c in columns):
            raise TypeError("add_columns: series")
        df, lineage, _ = self._put(dict(zip(namelist, columns, strict=True)))
        return Frame.of(df, lineage)

    def replace_column(self, name: str, column: Series) -> Frame:
        self._check([name])
        if not isinstance(column, Series):
            raise TypeError("replace_column: a series")
        df, lineage, _ = self._put({name: column})
        return Frame.of(df, lineage)

    def remove_column(self, name: str) -> Frame:
        return self.remove_columns([name])

    def remove_columns(self, column_names) -> Frame:
        names = list(column_names)
        self._check(names, KeyError)
        return self._next(self.df.select(*(col(n) for n in self.df.columns if n not in names)))

    def swap_columns(self, column_1: str, column_2: str) -> Frame:
        self._check([column_1, column_2], KeyError)
        swap = {column_1: column_2, column_2: column_1}
        return self._next(self.df.select(*(col(swap.get(n, n)) for n in self.df.columns)))

    def reorder_columns(self, column_names) -> Frame:
        names = list(column_names)
        if sorted(names) != sorted(self.df.columns):
            raise KeyError("every column once")
        return self._next(self.df.select(*map(col, names)))

    def rename(self, names) -> Frame:
        if not isinstance(names, dict):
            names = list(names)
            if len(names) != len(self.df.columns):
                raise ValueError("one name for each column")
            names = dict(zip(self.df.columns, names, strict=True))
        self._check(names)
        return Frame.of(self.df.select(*(col(n).alias(names.get(n, n)) for n in self.df.columns)), self._lineage.rename(names))

    def add_row_number(self, column_name: str = "id", start: int = 0) -> Frame:
        if column_name in self.df.columns:
            raise RuntimeError(f"column {column_name!r} exists")
        rows = with_position(self.df, column_name, start).orderBy(col(column_name))
        lineage = self._lineage.put(column_name, frozenset([(INDEX, "")]))
        return Frame.of(rows.select(col(column_name), *map(col, self.df.columns)), lineage.select([column_name, *self.df.columns]))

    def __setitem__(self, key, value) -> None:
        if isinstance(key, (list, tuple)):
            columns = [value.select_column(n) for n in value.df.columns] if isinstance(value, Frame) else list(value)
            if len(columns) != len(key):
                raise ValueError("one name for each column")
            new = dict(zip(key, columns, strict=True))
        elif isinstance(key, str):
            if not isinstance(value, Series) and isinstance(value, Iterable) and not isinstance(value, (str, dict)):
                value = Series(value)
            if self.df.columns == [key] and isinstance(value, Series) and self._here(value) is None:
                self._set(value.to_dataframe(key), value._shared([key]))
                return
            new = {key: value}
        else:
            raise TypeError("a column name or a list of them")
        if not self.df.columns and not isinstance(value, Series) and not isinstance(key, (list, tuple)):
            raise ValueError("a constant needs rows")
        df, lineage, keeps = self._put(new)
        self._set(df, lineage, keeps)

    def __delitem__(self, name: str) -> None:
        rest = self.remove_column(name)
        self._set(rest.df, rest._lineage)

    def __getitem__(self, key):
        if isinstance(key, str):
            return self.select_column(key)
        if isinstance(key, Series):
            return self.select_rows(key)
        if isinstance(key, slice):
            return self._next(sliced(self.df, key, self.num_rows))
        if isinstance(key, int):
            at = key + self.num_rows() if key < 0 else key
            got = row_at(self.df, at) if at >= 0 else None
            if got is None:
                raise IndexError("index out of range")
            return got.asDict()
        if isinstance(key, (list, tuple)):
            return self.select_columns(key)
        raise TypeError(f"cannot index by {type(key).__name__}")

    # --- rows ---------------------------------------------------------------------------------------------------
    def select_rows(self, mask: Series) -> Frame:
        """Rows where the mask is true in Python's sense."""
        here = self._here(mask)
        if here is not None:
            return self._next(self.df.where(truthy(here, mask.kind)))
        both, names = aligned(self.df, mask.to_dataframe("mask"))
        return self._next(both.where(truthy(F.col(names["mask"]), mask.kind)).select(*map(col, self.df.columns)))

    def range(self, key) -> Frame:
        return self[key]

    def head(self, n: int = 10) -> Frame:
        return self[: max(0, n)]

    def tail(self, n: int = 10) -> Frame:
        return self[-n:] if n > 0 else self[:0]

    def sample(self, fraction: float, max_partitions: int | None = None, seed: int | None = None) -> Frame:
        if not 0 <= fraction <= 1:
            raise ValueError("fraction: from 0 to 1")
        got = self.df.sample(False, float(fraction), seed)
        return self._next(got.coalesce(max_partitions) if max_partitions else got)

    def random_split(self, fraction: float, seed: int | None = None) -> tuple[Frame, Frame]:
        if not 0 <= fraction <= 1:
            raise ValueError("fraction: from 0 to 1")
        seed = seed if seed is not None else int(datetime.datetime.now().timestamp())
        # The draws are written with the rows: both parts read the same ones, so no row is in both or in neither, even if an
        # executor is lost between them.
        drawn = stash(self.df.withColumn("__draw", F.rand(seed)), "split")
        parts = (drawn.where(F.col("__draw") < fraction), drawn.where(F.col("__draw") >= fraction))
        return tuple(self._next(p.drop("__draw")) for p in parts)

    def topk(self, column_name: str, k: int = 10, reverse: bool = False) -> Frame:
        if not isinstance(column_name, str):
            raise TypeError("a column name is a string")
        self._check([column_name])
        c = col(column_name)
        return self._next(self.df.orderBy(c.asc_nulls_last() if reverse else c.desc()).limit(k))

    def _lacking(self, columns, how: str) -> Column:
        if how not in ("any", "all"):
            raise ValueError("how: any or all")
        names = self.df.columns if columns is None else [columns] if isinstance(columns, str) else list(columns)
        if any(not isinstance(n, str) for n in names):
            raise TypeError("column names are strings")
        self._check(names)
        tests = [missing(col(n), self.df.schema[n].dataType) for n in names]
        out = F.lit(how == "all" and bool(tests)) if not tests else tests[0]
        for t in tests[1:]:
            out = out | t if how == "any" else out & t
        return out if tests else F.lit(False)

    def dropna(self, columns=None, how: str = "any") -> Frame:
        return self._next(self.df.where(~self._lacking(columns, how)))

    def dropna_split(self, columns=None, how: str = "any") -> tuple[Frame, Frame]:
        lacking = self._lacking(columns, how)
        return self._next(self.df.where(~lacking)), self._next(self.df.where(lacking))

    drop_missing = dropna

    def fillna(self, column: str, value) -> Frame:
        if not isinstance(column, str):
            raise TypeError("a column name is a string")
        self._check([column])
        filled = F.when(missing(col(column), self.df.schema[column].dataType), F.lit(value)).otherwise(col(column))
        return self._next(self.df.select(*(filled.alias(n) if n == column else col(n) for n in self.df.columns)))

    def filterby(self, values, column_name: str | None = None, exclude: bool = False) -> Frame:
        """Rows whose column is among ``values`` (a value, several, or a series), or for which a function is true."""
        if column_name is not None:
            if not isinstance(column_name, str):
                raise TypeError("a column name is a string")
            self._check([column_name], KeyError)
        if callable(values) and not isinstance(values, Series):
            c = F.struct(*map(col, self.df.columns)) if column_name is None else col(column_name)
            test = native(values, c)
            if test is None:
                fn = (lambda r: bool(values(r.asDict()))) if column_name is None else (lambda v: bool(values(v)))
                test = F.udf(fn, T.BooleanType(), useArrow=True)(c)
            test = F.coalesce(test, F.lit(False))
            return self._next(self.df.where(~test if exclude else test))
        if column_name is None:
            raise ValueError("a column name is needed")
        kind = self.df.schema[column_name].dataType
        if isinstance(values, Series):
            if tag(values.kind) is not tag(kind):
                raise TypeError("values and column differ in type")
            wanted = values.to_dataframe("__wanted").distinct()
            how = "left_anti" if exclude else "left_semi"
            return self._next(self.df.join(wanted, col(column_name).eqNullSafe(F.col("__wanted")), how))
        if isinstance(values, (str, bytes, dict)) or not isinstance(values, Iterable):
            values = [values]
        values = list(values)
        if not values:
            raise ValueError("no values")
        known = [v for v in values if v is not None]
        if known and tag(infer(known[:1])) is not tag(kind):
            raise TypeError("values and column differ in type")
        test = col(column_name).isin(known) if known else F.lit(False)
        test = F.coalesce(test, F.lit(None in values))
        return self._next(self.df.where(~test if exclude else test))

    # --- several frames -----------------------------------------------------------------------------------------
    def join(self, right: Frame, on=None, how: str = "inner") -> Frame:
        """Rows that agree in the keys, null and NaN being values as any other. Clashing names of the right get .1, .2 ..."""
        kinds = {"inner": "inner", "left": "left", "right": "right", "full": "full", "outer": "full", "cartesian": "cross"}
        if how not in kinds:
            raise ValueError(f"how: of {', '.join(kinds)}")
        if not isinstance(right, Frame):
            raise TypeError("join: a frame")
        if how == "cartesian":
            keys: dict[str, str] = {}
        elif on is None:
            keys = {n: n for n in self.df.columns if n in right.df.columns}
        elif isinstance(on, str):
            keys = {on: on}
        elif isinstance(on, dict):
            keys = dict(on)
        elif isinstance(on, (list, tuple)):
            keys = {n: n for n in on}
        else:
            raise TypeError("on: a name, a list or a dict")
        if how != "cartesian" and not keys:
            raise ValueError("no columns to join on")
        self._check(keys)
        right._check(keys.values())
        taken, names = list(self.df.columns), {}
        for n in right.df.columns:
            if n not in keys.values():
                names[n] = fresh(taken, n)
                taken.append(names[n])
        hidden = {r: f"__key_{i}" for i, r in enumerate(keys.values())}
        other = right.df.select(*(col(n).alias(hidden.get(n) or names[n]) for n in right.df.columns))
        if how == "cartesian":
            both = self.df.crossJoin(other)
        else:
            match = None
            for a, b in keys.items():
                test = col(a).eqNullSafe(F.col(hidden[b]))
                match = test if match is None else match & test
            both = self.df.join(other, match, kinds[how])
        filled = {a: F.coalesce(col(a), F.col(hidden[b])).alias(a) for a, b in keys.items() if how in ("right", "full", "outer")}
        out = both.select(*(filled.get(n, col(n)) for n in self.df.columns), *(col(n) for n in names.values()))
        lineage = Lineage(self._lineage.table | right._lineage.table, dict(self._lineage.columns))
        for n, new in names.items():
            lineage = lineage.put(new, right._lineage.pairs([n]))
        return Frame.of(out, lineage.select(out.columns))

    def append(self, other: Frame) -> Frame:
        if not isinstance(other, Frame):
            raise RuntimeError("append: a frame")
        if not self.df.columns or not other.df.columns:
            return copy.copy(self if self.df.columns else other)
        if self.df.columns != other.df.columns or [f.dataType for f in self.df.schema] != [f.dataType for f in other.df.schema]:
            raise RuntimeError("append: both frames must have the same names and types, in one order")
        return Frame.of(self.df.union(other.df), self._lineage.merge(other._lineage))

    def unique(self) -> Frame:
        maps = [f.name for f in self.df.schema if isinstance(f.dataType, T.MapType)]
        if not maps:
            return self._next(self.df.distinct())
        entries = self.df.select(*((F.array_sort(F.map_entries(col(n))) if n in maps else col(n)).alias(n) for n in self.df.columns)).distinct()
        return self._next(entries.select(*((F.map_from_entries(col(n)) if n in maps else col(n)).alias(n) for n in self.df.columns)))

    def sort(self, sort_columns, ascending: bool = True) -> Frame:
        """Missing values come first when ascending and last when descending."""
        wanted = [sort_columns] if isinstance(sort_columns, str) else list(sort_columns)
        if not wanted:
            raise ValueError("no columns to sort by")
        pairs = [w if isinstance(w, tuple) else (w, ascending) for w in wanted]
        self._check(n for n, _ in pairs)
        for n, _ in pairs:
            if not isinstance(self.df.schema[n].dataType, (T.StringType, T.BooleanType, *NUMERIC, *MOMENT)):
                raise TypeError(f"cannot sort by {n!r}")
        return self._next(self.df.orderBy(*(col(n).asc() if up else col(n).desc() for n, up in pairs)))

    def groupby(self, key_columns, operations=None, *args) -> Frame:
        """Groups by one or more columns, with aggregations {name: aggregator}, a list of them, or none (distinct keys)."""
        keys = [key_columns] if isinstance(key_columns, str) else list(key_columns)
        for k in keys:
            if not isinstance(k, str):
                raise TypeError("key columns are strings")
            if k not in self.df.columns:
                raise KeyError(f"no column {k!r}")
            if isinstance(self.df.schema[k].dataType, T.MapType):
                raise TypeError("dicts cannot be keys")
        named: list[tuple[str, Aggregator]] = []
        for given in [operations, *args]:
            if isinstance(given, dict):
                for name, a in given.items():
                    several = resolve(a)
                    names = list(name) if isinstance(name, tuple) else [name] * len(several)
                    named += zip(names, several, strict=True)
            elif given is not None:
                named += [("", a) for a in resolve(given)]
        df = self.df
        order = None
        if any(a.ordered for _, a in named):
            df = df.withColumn(POSITION, row_order())
            order = F.col(POSITION)
        lineage, exprs, ranked, taken = self._lineage.select(keys), [], {}, list(keys)
        for name, a in named:
            self._check(a.columns, KeyError)
            name = fresh(taken, name or a.default_name())
            taken.append(name)
            made = a.make([col(c) for c in a.columns], kinds_of(self.df.schema, a.columns), order)
            if a.quantiles:
                ranked[name] = exact_quantiles(self.df, [col(k) for k in keys], made, list(a.quantiles)), len(a.quantiles)
            else:
                exprs.append(made.alias(name))
            lineage = lineage.put(name, self._lineage.pairs(a.columns[-1:]) if a.columns else frozenset([(COUNT, "")]))
        got = df.groupBy(*map(col, keys)).agg(*exprs) if exprs else self.df.select(*map(col, keys)).distinct()
        for name, (rows, n) in ranked.items():
            theirs = {f"k{i}": f"__key_{i}" for i in range(len(keys))}
            rows = rows.select(*(F.col(k).alias(v) for k, v in theirs.items()), (F.col("q") if n > 1 else F.get("q", F.lit(0))).alias(name))
            same = [col(k).eqNullSafe(F.col(v)) for k, v in zip(keys, theirs.values(), strict=True)]
            got = got.join(rows, same or F.lit(True), "left").drop(*theirs.values())
        return Frame.of(got.select(*map(col, taken)) if ranked else got, lineage)

    # --- reshape ------------------------------------------------------------------------------------------------
    def pack_columns(self, columns=None, column_prefix=None, dtype=list, fill_na=None, remove_prefix=True, new_column_name=None) -> Frame:
        from .reshape import pack

        return pack(self, columns, column_prefix, dtype, fill_na, remove_prefix, new_column_name)

    def unpack(self, unpack_column: str, column_name_prefix=None, column_types=None, na_value=None, limit=None) -> Frame:
        self._check([unpack_column])
        prefix = unpack_column if column_name_prefix is None else column_name_prefix
        new = self[unpack_column].unpack(prefix, column_types, na_value, limit)
        return self._expanded(unpack_column, new)

    def _expanded(self, name: str, new: Frame) -> Frame:
        """Columns of a frame over the same rows in place of one column."""
        exprs = getattr(new, "_exprs", None)
        rest = self.remove_column(name) if len(self.df.columns) > 1 else None
        taken = [] if rest is None else list(rest.df.columns)
        names = {}
        for n in new.df.columns:
            names[n] = fresh(taken, n)
            taken.append(names[n])
        kept = [] if rest is None else [col(n) for n in rest.df.columns]
        out = self.df.select(*kept, *(exprs[n].alias(names[n]) for n in new.df.columns))
        lineage = self._lineage
        for n in names.values():
            lineage = lineage.put(n, self._lineage.pairs([name]))
        return Frame.of(out, lineage.select(out.columns))

    def split_datetime(self, expand_column: str, column_name_prefix: str | None = None, limit=None) -> Frame:
        self._check([expand_column])
        prefix = expand_column if column_name_prefix is None else column_name_prefix
        new = self[expand_column].split_datetime(prefix, limit)
        name = (lambda p: f"{prefix}.{p}") if prefix else (lambda p: p)
        new._exprs = {name(p): fn(col(expand_column)).cast("long") for p, fn in Series.PARTS.items() if name(p) in new.df.columns}
        return self._expanded(expand_column, new)

    def stack(self, column_name: str, new_column_name=None, drop_na: bool = False) -> Frame:
        from .reshape import stack

        self._check([column_name])
        return stack(self, column_name, new_column_name, drop_na)

    def unstack(self, column, new_column_name: str | None = None) -> Frame:
        from .reshape import unstack

        return unstack(self, column, new_column_name)

    # --- functions of a row -------------------------------------------------------------------------------------
    def _row_function(self, fn: Callable, kind: T.DataType | None, use_columns, wrap: Callable = lambda v, k: fit(v, k), infer_from=None):
        names = list(use_columns) if use_columns is not None else list(self.df.columns)
        self._check(names)
        rows = F.struct(*(col(n).alias(n) for n in names))
        if kind is None:
            tried = [fn(r.asDict()) for r in self.df.select(*map(col, names)).take(10)]
            kind = infer_from(tried) if infer_from else infer(tried)
        return F.udf(lambda r: wrap(fn(r.asDict()), kind), kind, useArrow=True)(rows), names

    def apply(self, fn, dtype=None, use_columns=None, seed: int | None = None) -> Series:
        """A series of ``fn`` of each row, a dict. Runs in Python, in Arrow batches, over the columns it uses."""
        if not callable(fn):
            raise TypeError("apply: a function")
        expr, names = self._row_function(fn, self._kind_for(fn, dtype, use_columns), use_columns)
        return Series.over(self.df, expr, names, self._lineage.select(names))

    def _kind_for(self, fn, dtype, use_columns) -> T.DataType | None:
        if dtype is None or dtype in (list, dict):
            return None
        return spark_type(dtype)

    def transform_col(self, column: str, fn=None, dtype=None, use_columns=None, seed: int | None = None) -> Frame:
        self._check([column])
        fn = fn or (lambda row: row[column])
        expr, names = self._row_function(fn, self._kind_for(fn, dtype, use_columns), use_columns)
        lineage = self._lineage.put(column, self._lineage.pairs(names))
        return Frame.of(self.df.select(*(expr.alias(n) if n == column else col(n) for n in self.df.columns)), lineage.select(self.df.columns))

    def transform_cols(self, columns, fn=None, dtypes=None, use_columns=None, seed: int | None = None) -> Frame:
        columns = list(columns)
        self._check(columns)
        fn = fn or (lambda row: [row[c] for c in columns])

        def struct_of(tried: list) -> T.StructType:
            kinds = [spark_type(d) for d in dtypes] if dtypes else [infer(t[i] for t in tried) for i in range(len(columns))]
            return T.StructType([T.StructField(f"c{i}", k) for i, k in enumerate(kinds)])

        kind = struct_of([]) if dtypes and not {list, dict} & set(dtypes) else None
        wrap = lambda v, k: tuple(fit(x, f.dataType) for x, f in zip(v, k.fields, strict=True))
        expr, names = self._row_function(fn, kind, use_columns, wrap, struct_of)
        made = self.df.select(*map(col, self.df.columns), expr.alias("__made"))
        lineage = self._lineage
        for c in columns:
            lineage = lineage.put(c, self._lineage.pairs(names))
        pick = {c: F.col("__made")[f"c{i}"].alias(c) for i, c in enumerate(columns)}
        return Frame.of(made.select(*(pick.get(n, col(n)) for n in self.df.columns)), lineage.select(self.df.columns))

    def flat_map(self, column_names, fn, column_types="auto", use_columns=None, seed: int | None = None) -> Frame:
        """Rows from a function of a row that gives a list of rows."""
        names = list(column_names)

        def rows_of(tried: list) -> T.ArrayType:
            rows = [r for t in tried for r in t]
            kinds = [infer(r[i] for r in rows) for i in range(len(names))] if column_types == "auto" else [spark_type(t) for t in column_types]
            return T.ArrayType(T.StructType([T.StructField(f"c{i}", k) for i, k in enumerate(kinds)]))

        wrap = lambda v, k: [tuple(fit(x, f.dataType) for x, f in zip(r, k.elementType.fields, strict=True)) for r in v]
        expr, used = self._row_function(fn, None if column_types == "auto" else rows_of([]), use_columns, wrap, rows_of)
        made = self.df.select(F.explode(expr).alias("__row"))
        lineage = Lineage(self._lineage.table, {n: self._lineage.pairs(used) for n in names})
        return Frame.of(made.select(*(F.col("__row")[f"c{i}"].alias(n) for i, n in enumerate(names))), lineage)

    def detect_type(self, column_name: str) -> type:
        """The type that all cells of a text column read as: one scan, of which only the distinct types reach the driver."""
        self._check([column_name])
        c = col(column_name)
        if not isinstance(self.df.schema[column_name].dataType, T.StringType):
            raise TypeError("detect_type: a text column")
        classified = F.udf(lambda t: None if not t else classify_all([t]).__name__, T.StringType(), useArrow=True)
        found = {r[0] for r in self.df.select(classified(c).alias("k")).distinct().collect()} - {None}
        kinds = {"int": int, "float": float, "list": list, "dict": dict, "datetime": datetime.datetime, "str": str}
        if found == {"int", "float"}:
            return float
        return kinds[found.pop()] if len(found) == 1 else str

    def detect_type_and_cast(self, column_name: str) -> Frame:
        kind = self.detect_type(column_name)
        if kind is str:
            return copy.copy(self)
        sample = self[column_name].dropna()
        element = spark_type(kind, sample._literals(kind)) if kind in (list, dict) else None
        cast = text_cast(col(column_name), kind, element)
        return self._next(self.df.select(*(cast.alias(n) if n == column_name else col(n) for n in self.df.columns)))

    # --- SQL and out --------------------------------------------------------------------------------------------
    def sql(self, sql_statement: str, table_name: str = "frame") -> Frame:
        """Spark SQL over this frame under ``table_name``."""
        self.df.createOrReplaceTempView(table_name)
        out = self.df.sparkSession.sql(sql_statement)
        return Frame.of(out, Lineage(self._lineage.table, {n: self._lineage.columns.get(n, frozenset()) for n in out.columns}))

    def to_spark_dataframe(self, table_name: str | None = None, column_names=None, column_type_hints=None, number_of_partitions: int | None = None) -> DataFrame:
        df = self.df
        if column_type_hints:
            hints = column_type_hints if isinstance(column_type_hints, dict) else dict(zip(df.columns, column_type_hints, strict=True)) if not isinstance(column_type_hints, (type, str)) else {n: column_type_hints for n in df.columns}
            df = df.select(*(col(n).cast(spark_type(hints[n])).alias(n) if n in hints else col(n) for n in df.columns))
        if column_names:
            df = df.toDF(*column_names)
        if number_of_partitions:
            df = df.repartition(number_of_partitions)
        if table_name:
            df.createOrReplaceTempView(table_name)
        return df

    def to_rdd(self, number_of_partitions: int | None = None):
        df = self.df.repartition(number_of_partitions) if number_of_partitions else self.df
        return df.rdd.map(tuple)

    def to_pandas_dataframe(self):
        return self.df.toPandas()

    def save(self, filename: str, format: str | None = None, one_file: bool = True) -> None:
        """CSV and text are one file; without ``one_file`` a folder of files, written in parallel, for large tables."""
        from ..sources.writers import save_frame

        save_frame(self, filename, format, one_file)

    def save_as_parquet(self, filename: str, column_names=None, column_type_hints=None) -> None:
        from ..sources.writers import save_parquet

        save_parquet(self, filename, column_names, column_type_hints)

    def show(self):
        from .plots import Plot

        return Plot(self)


def _load(data, format: str) -> tuple[DataFrame, Lineage]:
    spark = session()
    if data is None:
        return spark.createDataFrame([], T.StructType([])), Lineage(frozenset([EMPTY]), {})
    if isinstance(data, Frame):
        return data.df, data._lineage
    if isinstance(data, Series):
        return data.to_dataframe("X.0"), data._shared(["X.0"])
    if isinstance(data, DataFrame):
        return data, Lineage.of(DATAFRAME, data.columns)
    if isinstance(data, str):
        return _load_path(data, format)
    if hasattr(data, "iloc"):
        return spark.createDataFrame(data), Lineage.of(PANDAS, list(map(str, data.columns)))
    if hasattr(data, "mapPartitions"):
        frame = Frame.from_rdd(data)
        return frame.df, frame._lineage
    if isinstance(data, dict):
        columns = {n: data[n] if isinstance(data[n], Series) else list(data[n]) for n in sorted(data)}
        if any(isinstance(v, Series) for v in columns.values()):
            frame = Frame()
            for n, v in columns.items():
                frame[n] = v if isinstance(v, Series) else Series(v)
            return frame.df, frame._lineage
    else:
        items = list(data)
        if items and all(isinstance(s, Series) for s in items):
            columns = {f"X.{i}": s for i, s in enumerate(items)}
            frame = Frame()
            for n, v in columns.items():
                frame[n] = v
            return frame.df, frame._lineage
        if items and all(isinstance(i, tuple) and len(i) == 2 and isinstance(i[0], str) and isinstance(i[1], (list, tuple)) for i in items):
            columns = {n: list(v) for n, v in items}
        else:
            columns = {"X.0": items}
    if len({len(v) for v in columns.values()}) > 1:
        raise ValueError("columns differ in length")
    kinds = [infer(v) for v in columns.values()]
    rows = [tuple(fit(v, k) for v, k in zip(r, kinds, strict=True)) for r in zip(*columns.values(), strict=True)]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(columns, kinds, strict=True)])
    return spark.createDataFrame(rows, schema), Lineage.of(PROGRAM, list(columns))


def _load_path(path: str, format: str) -> tuple[DataFrame, Lineage]:
    name = path.removesuffix(".gz")
    if format == "auto":
        kinds = {".csv": "csv", ".txt": "csv", ".tsv": "tsv", ".psv": "psv", ".parquet": "parquet"}
        format = next((k for end, k in kinds.items() if name.endswith(end)), "frame")
    if format in ("csv", "tsv", "psv"):
        frame = Frame.read_csv(path, delimiter={"csv": ",", "tsv": "\t", "psv": "|"}[format])
    elif format == "parquet":
        frame = Frame.read_parquet(path)
    elif format == "hive":
        import re

        if not re.fullmatch(r"\w+(\.\w+)?", path):
            raise ValueError(f"not a table name: {path!r}")
        df = session().table(path)
        return df, Lineage.of(HIVE, df.columns)
    elif format == "frame":
        frame = Frame.load(path)
    else:
        raise ValueError(f"unknown format {format!r}")
    return frame.df, frame._lineage
