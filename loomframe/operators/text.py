"""Words and n-grams of text columns, and tf-idf, all as expressions and grouped aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.order import POSITION, with_position
from ..plans.store import Scratch


def words(c: Column, to_lower: bool = True) -> Column:
    return F.array_remove(F.split(F.lower(c) if to_lower else c, r"\s+"), "")


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once: inside a lambda, an expression that is no variable is computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def counted(items: Column) -> Column:
    """A dict from each distinct item to its number: one sort, then the places where the next item differs."""

    def from_sorted(o: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda i: (i == 0) | (F.get(o, i) != F.get(o, i - 1)))
        return bound(starts, lambda at: from_starts(o, at))

    def from_starts(o: Column, at: Column) -> Column:
        ends = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(o)))
        counts = F.zip_with(at, ends, lambda a, b: (b - a).cast("long"))
        return F.map_from_arrays(F.transform(at, lambda i: F.get(o, i)), counts)

    empty = F.create_map().cast("map<string,bigint>")
    return F.when(F.size(items) > 0, bound(F.sort_array(items), from_sorted)).when(items.isNotNull(), empty)


def word_counts(c: Column, to_lower: bool = True) -> Column:
    return counted(words(c, to_lower))


def ngram_counts(c: Column, n: int = 2, method: str = "word", to_lower: bool = True, ignore_space: bool = True) -> Column:
    if n < 1:
        raise ValueError("n: at least 1")
    if method == "word":
        units, glue = words(c, to_lower), " "
    elif method == "character":
        text = F.lower(c) if to_lower else c
        units, glue = F.split(F.regexp_replace(text, r"\s+", "") if ignore_space else text, ""), ""
        units = F.filter(units, lambda u: u != "")
    else:
        raise ValueError("method: word or character")
    last = F.size(units) - n
    grams = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(units, i + 1, n), glue)))
    return counted(F.coalesce(grams, F.when(units.isNotNull(), F.array().cast("array<string>"))))


#: Words whose totals are sent to all tasks, at most; the rows of the other words are exchanged by word.
FREQUENT = 100_000


def document_words(docs: DataFrame, doc: str, items: str) -> DataFrame:
    """(doc, most, word, n): how often each document has each of its items, and its largest number; each row is a document."""
    kinds = [docs.schema[doc].dataType, docs.schema[items].dataType.elementType]
    arrow = [to_arrow_type(k) for k in kinds]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):  # few documents at a time as words
                part = batch.slice(at, 2048)
                lists = part.column(1)
                owner = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
                coded = pc.list_flatten(lists).dictionary_encode()
                known = coded.indices.is_valid().to_numpy(zero_copy_only=False)
                code = coded.indices.fill_null(0).to_numpy().astype(np.int64)[known]
                size = max(1, len(coded.dictionary))
                found, n = np.unique(owner[known] * size + code, return_counts=True)
                of = found // size
                most = np.zeros(part.num_rows, np.int64)
                np.maximum.at(most, of, n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(of)).cast(arrow[0]), pa.array(most[of]), coded.dictionary.take(pa.array(found % size)).cast(arrow[1]), pa.array(n.astype(np.int64))],
                    names=["doc", "most", "word", "n"],
                )

    schema = T.StructType([T.StructField("doc", kinds[0]), T.StructField("most", T.LongType()), T.StructField("word", kinds[1]), T.StructField("n", T.LongType())])
    return docs.select(doc, items).mapInArrow(count, schema)


def tf_idf_rows(docs: DataFrame, doc: str, items: str) -> DataFrame:
    """(doc, word, tf_idf): (0.5 + 0.5 count / largest count) times ln((documents + 1) / (occurrences + 1)).

    Each row is a document; occurrences counts all occurrences of a word in all documents. A document's own counts are
    made where it stands and written once. The totals of the most frequent words, a bounded number, are sent to all
    tasks; only the rows of the others are exchanged by word, and none of these has many rows.
    """
    scratch = Scratch(docs.sparkSession, "tf-idf")
    rows = scratch.put(document_words(docs, doc, items), "counts")
    totals = scratch.put(rows.groupBy("word").agg(F.sum("n").alias("total")), "totals")
    classes = totals.groupBy(F.floor(4 * F.log2("total")).alias("size")).agg(F.count(F.lit(1)).alias("words"), F.min("total").alias("least"))
    least, room = None, FREQUENT
    for c in classes.orderBy(F.desc("size")).collect():  # a few hundred rows
        room -= c["words"]
        if room < 0:
            break
        least = c["least"]
    value = (0.5 + 0.5 * F.col("n") / F.col("most")) * F.log((docs.count() + 1) / (F.col("total") + 1))
    wanted = ["doc", "word", value.alias("tf_idf")]
    if least is None:
        return rows.join(totals, "word").select(*wanted)
    often, seldom = totals.where(F.col("total") >= least), totals.where(F.col("total") < least)
    near = rows.join(F.broadcast(often), "word").select(*wanted)
    far = rows.join(F.broadcast(often.select("word")), "word", "left_anti").join(seldom, "word").select(*wanted)
    return near.union(far)


def tf_idf(series):
    """A series with a dict from word to tf-idf for each document, in the documents' order."""
    from .series import VALUE, Series

    items = series.expr if isinstance(series.kind, T.ArrayType) else words(series.expr)
    rows = with_position(series.df.select(items.alias("items")))
    scored = tf_idf_rows(rows, POSITION, "items").groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("word", "tf_idf"))).alias(VALUE))
    empty = F.create_map().cast("map<string,double>")
    out = rows.join(scored, F.col(POSITION) == F.col("doc"), "left").orderBy(POSITION)
    return Series.rows(out.select(F.coalesce(VALUE, empty)), series._lineage)
