"""Row positions. They are added only by operations that ask for a position, and never by one global window over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .store import stash

POSITION = "__position"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_order() -> Column:
    """A number that grows with the rows' present order, within the job that computes it. It costs no pass of its own.

    It serves what needs an order inside of one aggregation. Positions that several jobs must agree on come from
    ``with_position``: a sort samples its splitters anew in each job, so its partitions differ between jobs.
    """
    return F.monotonically_increasing_id()


def with_position(df: DataFrame, name: str = POSITION, start: int = 0) -> DataFrame:
    """Number the rows from ``start`` in their present order; the rows themselves come in no order.

    The rows are written once with their partition and their place in it; the rows of each partition are counted in
    these files, and a row's number is its place behind all partitions before its own. What is broadcast, and what one
    task adds up, has one small row for each partition.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    void = {n for n, f in zip(names, df.schema.fields, strict=True) if isinstance(f.dataType, T.NullType)}
    plain = df.toDF(*names).select(*(n for n in names if n not in void), row_order().alias("__mark"))
    marked = stash(plain, "positions")
    part = F.shiftright("__mark", 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("__part", (F.coalesce(F.sum("n").over(before), F.lit(0)) + start).alias("__before"))
    place = (F.col("__mark").bitwiseAND((1 << 33) - 1) + F.col("__before")).alias(name)
    joined = marked.join(F.broadcast(offsets), part == F.col("__part"))
    old = dict(zip(names, df.columns, strict=True))
    return joined.select(*((F.lit(None) if n in void else F.col(n)).alias(old[n]) for n in names), place)


def aligned(left: DataFrame, right: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Rows of both by position, in order; rows beyond the shorter one are lost. Gives the right side's new names."""
    names = {c: f"__right_{i}" for i, c in enumerate(right.columns)}
    a = with_position(left)
    b = with_position(right.toDF(*names.values()), "__other")
    both = a.join(b, F.col(POSITION) == F.col("__other")).orderBy(POSITION).drop(POSITION, "__other")
    return both, names


def fresh(taken, wanted: str) -> str:
    """``wanted``, or ``wanted``.1, .2 and so on where it is taken."""
    if wanted not in taken:
        return wanted
    i = 1
    while f"{wanted}.{i}" in taken:
        i += 1
    return f"{wanted}.{i}"
