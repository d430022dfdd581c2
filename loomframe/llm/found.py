"""Spans found in texts: base patterns, their order, and the digest columns of the numbered queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

Span = tuple[int, int, str]  # start and end in code points, kind


def scan(docs: DataFrame, find: Callable[[list[str]], Iterator[tuple[list[Span], list[Span]]]], key: str, text: str) -> DataFrame:
    """(``key``, base, added) of every row: arrays of (start, end, kind) that ``find`` gives for each text; null is empty."""
    kind = docs.schema[key].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides: tuple[list, list] = ([], [])
            for at in range(0, batch.num_rows, 256):  # few texts at a time as Python strings
                texts = [t or "" for t in batch.column(1).slice(at, 256).to_pylist()]
                for found in find(texts):
                    for side, spans in zip(sides, found, strict=True):
                        side.append([{"start": a, "end": b, "kind": k} for a, b, k in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(side, span) for side in sides)], names=["id", "base", "added"]
            )

    ddl = "array<struct<start:int,end:int,kind:string>>"
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, base {ddl}, added {ddl}")
    return rows.withColumnRenamed("id", key)


def listing(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end by start, then kind in the order of ``kinds``, joined by commas."""
    rank = F.create_map(*(F.lit(x) for i, k in enumerate(kinds) for x in (k, i)))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], rank[s["kind"]], s["end"], s["kind"])))
    parts = F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

