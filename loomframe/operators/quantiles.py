"""Exact quantiles of groups: values are counted, ranked over range partitions, and only the partitions asked for are read again."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.store import stash


def exact_quantiles(df: DataFrame, keys: list[Column], value: Column, wanted: list[float]) -> DataFrame:
    """(k0, k1, ..., q): for each group the smallest values that at least these shares of its values do not exceed, as a list.

    Null values do not count; a group without values has no row. Equal values are counted first, whatever their number.
    A value's rank is its place in its range partition behind all partitions before, so one task sorts at most one range
    partition, also if there is one group only.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*(k.alias(n) for k, n in zip(keys, names, strict=True)), value.alias("v")).where(F.col("v").isNotNull())
    counts = rows.groupBy(*names, "v").agg(F.count(F.lit(1)).alias("n"))
    ranged = stash(counts.repartitionByRange(*names, "v").withColumn("part", F.spark_partition_id()), "quantiles")
    sums = ranged.groupBy(*names, "part").agg(F.sum("n").alias("here"))
    group = Window.partitionBy(*names)
    before = F.sum("here").over(group.orderBy("part")) - F.col("here")
    placed = sums.select(*names, "part", "here", before.alias("before"), F.sum("here").over(group).alias("total"))
    # decimals, as a share times a number may pass a whole number by the last bit of a double
    shares = F.array(*(F.lit(round(Decimal(repr(float(q))), 15)).cast("decimal(16,15)") for q in wanted))
    asked = placed.select("*", F.posexplode(shares).alias("i", "share"))
    rank = F.greatest(F.ceil(F.col("total").cast("decimal(20,0)") * F.col("share")).cast("long"), F.lit(1)) - F.col("before")
    asked = asked.withColumn("rank", rank).where("rank > 0 and rank <= here").select(*(F.col(n).alias(f"a{n}") for n in names), F.col("part").alias("apart"), "i", "rank")
    same = F.col("part") == F.col("apart")
    for n in names:
        same &= F.col(n).eqNullSafe(F.col(f"a{n}"))
    upto = F.sum("n").over(Window.partitionBy(*names, "part", "i").orderBy("v"))
    found = ranged.join(asked, same).withColumn("upto", upto).where("upto >= rank and upto - n < rank")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"])
    return found.groupBy(*names).agg(listed.alias("q"))
