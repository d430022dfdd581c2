"""Aggregators of a group-by, each an expression that Spark combines on the map side where it can."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

from .missing import present


@dataclass(frozen=True)
class Aggregator:
    """A named aggregation of columns. ``make`` gets the columns, their types, and a tie-breaking order column or None.

    With ``quantiles``, it gives what is ranked, which needs steps of its own: see ``exact_quantiles``.
    """

    name: str
    columns: tuple[str, ...]
    make: Callable[..., Column]
    ordered: bool = False
    output: str | None = None
    quantiles: tuple[float, ...] = ()

    def default_name(self) -> str:
        return self.output or (f"{self.name}_of_{self.columns[-1]}" if self.columns else self.name)


def _simple(name: str, fn: Callable[[Column], Column]) -> Callable[[str], Aggregator]:
    def build(src_column: str) -> Aggregator:
        return Aggregator(name, (src_column,), lambda c, kinds, order: fn(present(c[0], kinds[0])), output=name)

    build.__name__ = name.upper()
    return build


def COUNT(*_args) -> Aggregator:
    """Rows of the group, missing values included."""
    return Aggregator("count", (), lambda c, kinds, order: F.count(F.lit(1)), output="count")


SUM = _simple("sum", F.sum)
MIN = _simple("min", F.min)
MAX = _simple("max", F.max)
MEAN = AVG = _simple("avg", F.avg)
VARIANCE = VAR = _simple("var", F.var_pop)
STDV = STD = _simple("stdv", F.stddev_pop)


def _extreme(name: str, biggest: bool) -> Callable:
    def build(agg_column, out_column: str):
        """The value of ``out_column`` in the first row that holds the extreme of ``agg_column``; several columns give several."""
        if isinstance(agg_column, (tuple, list)):
            return [build(a, out_column) for a in agg_column]

        def make(c, kinds, order):
            key = present(c[0], kinds[0])
            tie = order if order is not None else F.lit(0).cast("long")
            pick = F.max if biggest else F.min
            # one struct: the extreme, the earliest row, and the wanted value
            first = F.struct(key.alias("k"), (-tie if biggest else tie).alias("t"), c[1].alias("v"))
            return pick(F.when(key.isNotNull(), first))["v"]

        return Aggregator(name, (agg_column, out_column), make, ordered=True, output=name)

    build.__name__ = name.upper()
    return build


ARGMAX, ARGMIN = _extreme("argmax", True), _extreme("argmin", False)


def SELECT_ONE(src_column: str) -> Aggregator:
    """One of the group's values that are not missing, the same one in every run: that of the lowest hash."""

    def make(c, kinds, order):
        value = present(c[0], kinds[0])
        return F.min(F.when(value.isNotNull(), F.struct(F.xxhash64(F.lit(src_column), value).alias("h"), value.alias("v"))))["v"]

    return Aggregator("select_one", (src_column,), make, output="select_one")


def CONCAT(src_column: str, dict_value_column: str | None = None) -> Aggregator:
    """A list of a column's values in row order, or a dict from one column to another, where the last row of a key wins."""

    def listed(c, kinds, order):
        value = present(c[0], kinds[0])
        if order is None:
            return F.collect_list(value)
        pairs = F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))
        return F.transform(F.array_sort(pairs), lambda p: p["v"])

    def mapped(c, kinds, order):
        key = present(c[0], kinds[0])
        tie = order if order is not None else F.lit(0).cast("long")
        rows = F.collect_list(F.when(key.isNotNull(), F.struct(key.alias("k"), tie.alias("o"), c[1].alias("v"))))

        def last_of_each(o: Column) -> Column:
            # sorted by key and order: an entry counts if the next one has another key
            return F.filter(o, lambda e, i: ~F.coalesce(F.get(o, i + 1)["k"] == e["k"], F.lit(False)))

        kept = F.transform(F.transform(F.array(F.array_sort(rows)), last_of_each)[0], lambda e: F.struct(e["k"], e["v"]))
        return F.when(F.size(rows) > 0, F.map_from_entries(kept))

    if dict_value_column is None:
        return Aggregator("concat", (src_column,), listed, ordered=True, output="concat")
    return Aggregator("concat", (src_column, dict_value_column), mapped, ordered=True, output="concat")


def QUANTILE(src_column: str, *quantiles) -> Aggregator:
    """Exact quantiles, each a value of the group (no interpolation): a number for one quantile, a list for several."""
    wanted = list(quantiles[0]) if quantiles and isinstance(quantiles[0], (list, tuple)) else list(quantiles)
    if not wanted:
        raise ValueError("QUANTILE needs at least one quantile")
    if not all(0 <= q <= 1 for q in wanted):
        raise ValueError("quantile: from 0 to 1")
    return Aggregator("quantile", (src_column,), lambda c, kinds, order: present(c[0], kinds[0]), output="quantile", quantiles=tuple(wanted))


#: Aggregators by name, as they may be given in text.
REGISTRY: dict[str, Callable[..., Aggregator]] = {
    "count": COUNT, "sum": SUM, "min": MIN, "max": MAX, "avg": MEAN, "mean": MEAN, "var": VARIANCE, "variance": VARIANCE,
    "std": STDV, "stdv": STDV, "argmax": ARGMAX, "argmin": ARGMIN, "select_one": SELECT_ONE, "concat": CONCAT, "quantile": QUANTILE,
}


def resolve(given) -> list[Aggregator]:
    """Aggregators from what a caller may pass: an aggregator, a constructor without arguments, or a list of them."""
    if isinstance(given, Aggregator):
        return [given]
    if isinstance(given, (list, tuple)):
        return [a for g in given for a in resolve(g)]
    if callable(given):
        return resolve(given())
    raise TypeError(f"not an aggregator: {given!r}")


def kinds_of(schema: T.StructType, columns: tuple[str, ...]) -> list[T.DataType]:
    return [schema[c].dataType for c in columns]
