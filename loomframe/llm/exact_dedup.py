"""Exact deduplication by content sort.

Splitters sampled from the normalised bytes cut the table into ranges, an external sort puts equal texts next to each
other, and each row is compared in full with its neighbour. The rows of one text may fill many ranges: the range key
ends with the row's own key, so a text that a third of all rows share is spread out, and only the first and last run
of each range are matched across the borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .stash import stash

#: Leading characters of the text in the range key; the digest of the whole text orders what agrees in them.
HEAD = 32


def _lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A-Z lowered; null counts as empty. Bytes above 127 stay as they are."""
    for batch in batches:
        text = batch.column(1).fill_null("") if batch.column(1).null_count else batch.column(1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pc.ascii_lower(text)], names=["id", "norm"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal neighbours in a sorted range; only the last row of a batch is carried on.

    The first and the last row of the range keep their text, for the comparison with the ranges beside it.
    """
    part = TaskContext.get().partitionId()
    run, row, last = 0, 0, None
    held: pa.RecordBatch | None = None

    def rows(batch: pa.RecordBatch, runs: np.ndarray, at: int, texts: list[str | None]) -> pa.RecordBatch:
        n = batch.num_rows
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(2), pa.array(np.full(n, part), pa.int32()), pa.array(runs, pa.int64()),
                pa.array(np.arange(at, at + n), pa.int64()), pa.array(texts, pa.string()),
            ],
            names=["id", "digest", "part", "run", "row", "edge"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield rows(held, np.array([run]), row - 1, [last if row == 1 else None])
        norm = batch.column(1)
        new = np.ones(batch.num_rows, bool)
        new[1:] = pc.not_equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
        new[0] = last is not None and norm[0].as_py() != last
        runs = run + np.cumsum(new)
        body = batch.slice(0, batch.num_rows - 1)
        if body.num_rows:
            yield rows(body, runs[:-1], row, [norm[0].as_py() if row == 0 and i == 0 else None for i in range(body.num_rows)])
        held, run, row, last = batch.slice(batch.num_rows - 1), int(runs[-1]), row + batch.num_rows, norm[-1].as_py()
    if held is not None:
        yield rows(held, np.array([run]), row - 1, [last])


def content_sort_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """Groups of rows whose texts are identical after lower-casing A-Z.

    Returns one row for each row of ``docs``: (``key``, keep_id, group_size, kept, text_sha256). ``keep`` names the row
    of a group that stays: the one with the "smallest" or the "largest" key.

    Defined cases: a null text is an empty text, and all empty texts are one group; very long texts are compared whole;
    ties of equal keys fall to the place in the sort, so one row stays; a null key is taken only where the
    group has no other; of rows that repeat with the same key and text exactly one is kept; an empty table gives an
    empty result; other columns of ``docs`` are not looked at.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep: smallest or largest")
    kind = docs.schema[key].dataType.simpleString()
    normal = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(_lowered, f"id {kind}, norm string")
    normal = normal.withColumns({"digest": F.sha2("norm", 256), "head": F.substring("norm", 1, HEAD)})
    order = ["head", "digest", "id"]
    rows = normal.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "norm", "digest")
    rows = stash(rows.mapInArrow(_runs, f"id {kind}, digest string, part int, run long, row long, edge string"), "runs")

    best = F.struct(F.col("id").isNull().alias("none"), "id", "part", "row")
    if keep == "largest":
        best = F.struct(F.col("id").isNotNull().alias("some"), "id", "part", "row")
    pick = F.min if keep == "smallest" else F.max
    runs = rows.groupBy("part", "run").agg(
        F.count(F.lit(1)).alias("n"), pick(best).alias("best"), F.first("digest").alias("digest"),
        F.first("edge", ignorenulls=True).alias("edge"),
    )
    runs = stash(runs, "run-sums")
    # The first and the last run of each range, in order, with their texts: a row or two for each range, whatever the
    # number of documents. They are compared in full with the run before.
    ends = runs.groupBy("part").agg(F.max("run").alias("last"))
    edges = runs.join(F.broadcast(ends), "part").where("run = 0 or run = last")
    walk = Window.orderBy("part", "run")
    edges = edges.withColumn("new", (~F.col("edge").eqNullSafe(F.lag("edge").over(walk))).cast("int"))
    edges = edges.withColumn("island", F.sum("new").over(walk)).select("part", "run", "n", "best", "island")
    whole = edges.groupBy("island").agg(F.sum("n").alias("total"), pick("best").alias("chosen"))
    border = edges.join(whole, "island").select("part", "run", "total", "chosen")
    groups = runs.join(border, ["part", "run"], "left").select(
        "part", "run", F.coalesce("total", "n").alias("group_size"), F.coalesce("chosen", "best").alias("best")
    )
    return rows.join(groups, ["part", "run"]).select(
        F.col("id").alias(key),
        F.col("best.id").alias("keep_id"),
        "group_size",
        ((rows["part"] == F.col("best.part")) & (rows["row"] == F.col("best.row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm)
"""
