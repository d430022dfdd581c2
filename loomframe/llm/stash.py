"""Lineage cuts and small-table helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.store import Scratch, stash

__all__ = ["Scratch", "connected_components", "documents", "stash"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """Smallest reachable vertex of every vertex in ``edges``: (id, component).

    Vertices are of any type that can be ordered, structs as well. Alternating large-star and small-star rounds (Kiveris
    et al., "Connected components in MapReduce and beyond", 2014): each vertex sends its larger, then its smaller,
    neighbours to the smallest vertex of its neighbourhood, which needs about log(n) rounds even on chains. Every round
    is two grouped aggregations over the edges, written to the shared folder, and takes the place of the one before;
    edges never visit the driver. A hub's neighbours are joined to one row, so Spark may split them over tasks. No edges
    give no rows; loops and repeated edges are harmless.
    """
    scratch = Scratch(edges.sparkSession, "components")
    e = scratch.put(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    last, now_at = None, "edges"
    for i in range(rounds):
        # large star: every larger neighbour of u (and u's minimum) hangs from the minimum of u's neighbourhood
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.put(large.where("u <> v").distinct(), f"large-{i}")
        # small star: u and its smaller neighbours hang from the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        e = scratch.put(small.where("u <> v").distinct(), f"small-{i}")
        scratch.drop(now_at, f"large-{i}")
        now_at = f"small-{i}"
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last or not now[0]:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    leaves = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return leaves.union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
