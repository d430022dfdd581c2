"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND, and verification.

The roles are turned round: the test items are the indexed collection, every training passage is a query. Impacts are
divided by what an item must score, so one threshold (1) holds for all items. A passage is dropped as soon as the sum
of its terms' largest impacts stays below it (WAND), then per block of items by the blocks' largest impacts
(block-max); what is left is scored exactly, and every item at or above its threshold is retrieved. A retrieved item
counts as leaked if the words around hold enough of both its question and its answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .stash import Scratch
from .words import chunks, distinct, shingle_hashes, spans, word_hashes

#: Items of one index, which a task is sent. More items make more indexes, each queried by every passage.
SHARD = 4096
#: Postings that are summed at once.
POSTINGS = 2_000_000
#: Items of one block.
BLOCK = 16
K1, B = 1.2, 0.75


def _trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Word ends without closing marks, so that a sentence's last word is the word it is elsewhere."""
    for _ in range(2):
        mark = np.isin(data[ends - 1], np.frombuffer(b".,;:!?\"')", np.uint8)) & (ends - starts > 1)
        ends = ends - mark
    return ends


def _words(text: str) -> np.ndarray:
    _, _, off, data = next(chunks(pa.array([text])))
    starts, ends, _ = spans(off, data)
    return word_hashes(data, starts, _trimmed(data, starts, ends))


def question_and_answer(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The words of an item's question and answer: up to and after the last question mark, else its two halves."""
    at = text.rfind("?") + 1
    if at and text[at:].strip() and text[:at].strip():
        return _words(text[:at]), _words(text[at:])
    words = _words(text)
    half = (len(words) + 1) // 2
    return words[:half], words[half:]


def _held(part: np.ndarray, near: np.ndarray, size: int = 3) -> float:
    """The share of a part's distinct word n-grams that the words near by hold; a part without words asks for nothing."""
    size = max(1, min(size, len(part)))
    grams = np.unique(shingle_hashes(part, size))
    return float(np.isin(grams, shingle_hashes(near, size)).mean()) if len(grams) else 1.0


def _expand(ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists that begin at ptr: the index in ``rows`` and the place of every entry of the lists that rows name."""
    counts = ptr[rows + 1] - ptr[rows]
    owner = np.repeat(np.arange(len(rows)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts - ptr[rows], counts)


def _sums(keys: np.ndarray, values: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The keys whose values add up to at least ``least``, ascending, and their sums."""
    found, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, values, len(found))
    return found[total >= least], total[total >= least]


@dataclass(frozen=True)
class Statistics:
    """Of all items, whatever the shards: their number and mean length, and the document frequencies of some terms."""

    n: int
    mean: float
    terms: np.ndarray
    df: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Statistics:
        words = [_words(t or "") for t in texts]
        terms, df = np.unique(np.concatenate([np.unique(w) for w in words] or [np.zeros(0, np.uint64)]), return_counts=True)
        return cls(len(words), max(1.0, float(np.mean([len(w) for w in words] or [1]))), terms, df)


class ItemIndex:
    """Posting lists of a shard of items, with the largest impact of each term in each block of items.

    Postings are (term, item, impact), sorted by term and item; ``ptr`` tells where a term's list begins. Its size is in
    proportion to the distinct terms of the items. Items without words are in no posting and are never retrieved.
    """

    def __init__(self, ids: list, texts: list[str], least: float, statistics: Statistics):
        self.ids = ids
        self.parts = [question_and_answer(t or "") for t in texts]
        words = [np.concatenate(qa) for qa in self.parts]
        self.length = max([1, *map(len, words)])
        counts = [np.unique(w, return_counts=True) for w in words]
        self.terms = np.unique(np.concatenate([c[0] for c in counts] or [np.zeros(0, np.uint64)]))
        df = statistics.df[np.searchsorted(statistics.terms, self.terms)] if len(self.terms) else np.zeros(0)
        idf = np.log1p((statistics.n - df + 0.5) / (df + 0.5))
        term, item, impact = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for i, (own, tf) in enumerate(counts):
            if len(own):
                at = np.searchsorted(self.terms, own)
                score = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words[i]) / statistics.mean))
                term.append(at)
                item.append(np.full(len(at), i))
                impact.append(score / (least * score.sum()))
        term, item, impact = map(np.concatenate, (term, item, impact))
        order = np.lexsort((item, term))
        term, self.item, self.impact = term[order], item[order].astype(np.int32), impact[order].astype(np.float32)
        lists = np.arange(len(self.terms) + 1)
        self.ptr = np.searchsorted(term, lists)
        # a term's postings in one block stand together
        blocks = term * (len(ids) // BLOCK + 1) + self.item // BLOCK
        first = np.flatnonzero(np.diff(blocks, prepend=-1))
        self.block = self.item[first] // BLOCK
        self.block_most = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0, np.float32)
        self.block_ptr = np.searchsorted(term[first], lists)
        self.most = np.maximum.reduceat(self.impact, self.ptr[:-1]) if len(term) else np.zeros(0, np.float32)

    def _retrieved(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) at or above the threshold; (passage, term) are the distinct terms of the passages."""
        # block-max: the blocks whose largest impacts add up to the threshold, then their items' own impacts
        width = len(self.ids) // BLOCK + 1
        owner, at = _expand(self.block_ptr, term)
        possible, _ = _sums(passage[owner] * width + self.block[at], self.block_most[at], 0.999)
        owner, at = _expand(self.ptr, term)
        block = passage[owner] * width + self.item[at] // BLOCK
        place = np.minimum(np.searchsorted(possible, block), max(len(possible) - 1, 0))
        open_ = possible[place] == block if len(possible) else np.zeros(len(block), bool)
        owner, at = owner[open_], at[open_]
        found, score = _sums(passage[owner] * len(self.ids) + self.item[at], self.impact[at], 1 - 1e-4)
        return found // len(self.ids), found % len(self.ids), score

    def leaks(self, words: np.ndarray, firsts: np.ndarray, overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
        """(row, item, score, question overlap, answer overlap) of the leaked items in rows of words; the best of a row and item."""
        if not len(self.terms) or not len(words):
            return
        span, n = self.length, np.diff(firsts)
        # A passage is two segments of the longest item's length, so an item lies whole in one of them.
        segments = np.maximum(-(-n // span), 1)
        base = np.concatenate([[0], np.cumsum(segments)])
        row = np.repeat(np.arange(len(n)), n)
        segment = base[row] + (np.arange(len(words)) - firsts[row]) // span
        at = np.searchsorted(self.terms, words)
        at[at == len(self.terms)] = 0
        known = self.terms[at] == words
        pairs = distinct(segment[known] * len(self.terms) + at[known])
        segment, term = pairs // len(self.terms), pairs % len(self.terms)
        begin = np.searchsorted(segment, np.arange(base[-1] + 1))
        # WAND: the largest impacts of all terms of a passage; a term in both segments counts twice, which keeps a bound.
        last = np.zeros(base[-1], bool)
        last[base[1:] - 1] = True
        single = np.bincount(segment, self.most[term], base[-1])
        alive = np.flatnonzero(single + np.where(last, 0, np.append(single[1:], 0)) >= 0.999)
        if not len(alive):
            return
        # the distinct terms of each passage that is left
        n_terms = begin[np.where(last[alive], alive + 1, np.minimum(alive + 2, base[-1]))] - begin[alive]
        first = np.cumsum(n_terms) - n_terms
        place = np.arange(n_terms.sum()) - np.repeat(first - begin[alive], n_terms)
        pairs = distinct(np.repeat(np.arange(len(alive)), n_terms) * len(self.terms) + term[place])
        passage, term = pairs // len(self.terms), pairs % len(self.terms)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        # few passages at a time, by the postings of their terms
        load = np.cumsum(self.ptr[term + 1] - self.ptr[term])
        slices = np.unique(passage[np.searchsorted(load, np.arange(0, load[-1], POSTINGS), "right")]) if len(load) else []
        cuts = [*np.searchsorted(passage, slices).tolist(), len(passage)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            for at, item, score in zip(*self._retrieved(passage[low:high], term[low:high]), strict=True):
                s = int(alive[at])
                r = int(np.searchsorted(base, s, "right")) - 1
                a = firsts[r] + (s - base[r] - 1) * span
                near = words[max(a, firsts[r]) : min(a + 4 * span, firsts[r + 1])]
                shares = [_held(part, near) for part in self.parts[item]]
                if min(shares) >= overlap:
                    found = (round(float(score), 4), *shares)
                    best[r, int(item)] = max(found, best.get((r, int(item)), found))
        for (r, item), found in best.items():
            yield r, item, *found


def indexes(items: DataFrame, scratch: Scratch, least: float, shard: int) -> Iterator[tuple[int, ItemIndex]]:
    """(number of shards, index) of each shard of (item, text), one after the other."""

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_words(t or "") for t in batch.column(0).to_pylist()]
            own = [np.unique(w) for w in words]
            part = np.repeat(batch.column(1).to_numpy(), [len(w) for w in own])
            terms = np.concatenate([*own, np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int64()), pa.array(terms.view(np.int64)), pa.array(np.zeros(len(terms), np.int64))], names=["part", "term", "length"]
            )
            # the items' lengths, as rows without a term
            n = len(words)
            lengths = pa.array([len(w) for w in words], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, -1), pa.int64()), pa.nulls(n, pa.int64()), lengths], names=["part", "term", "length"])

    parts = max(1, -(-items.count() // shard))
    sharded = items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)).cast("long"))
    terms = scratch.put(sharded.select("text", "part").mapInArrow(terms_of, "part long, term long, length long"), "terms")
    n, mean = terms.where("term is null").agg(F.count(F.lit(1)), F.avg("length")).first()
    frequency = terms.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    for part in range(parts):
        # a shard at a time on the driver: its items and their terms, however many there are in all
        rows = sharded.where(F.col("part") == part).orderBy("item", "text").collect()
        own = terms.where((F.col("part") == part) & F.col("term").isNotNull()).select("term").distinct()
        df = frequency.join(own, "term").toPandas()
        order = np.argsort(df["term"].to_numpy("int64").view(np.uint64))
        statistics = Statistics(n, max(1.0, mean or 1.0), df["term"].to_numpy("int64").view(np.uint64)[order], df["df"].to_numpy("int64")[order])
        yield parts, ItemIndex([r["item"] for r in rows], [r["text"] for r in rows], least, statistics)


def benchmark_leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    least: float = 0.6, overlap: float = 0.6, shard: int = SHARD,
) -> DataFrame:
    """Benchmark items that documents hold: (``key``, ``item``, score, question_overlap, answer_overlap), one row per pair.

    Every passage of every whole text is a BM25 query against all items; items whose score is at least ``least`` of
    their own score as a query are retrieved, and reported if the passage and its surroundings hold at least ``overlap``
    of the word 3-grams of the question and of the answer. score is in units of the threshold. The items are indexed in
    shards of bounded size, so what a task is sent does not grow with the benchmark; document frequencies, number and mean
    length are those of all items, so the result does not depend on the shards.

    Defined cases: very long texts are cut into passages, and all of them are queries; items that tie are all retrieved;
    null and wordless texts and items match nothing; documents that repeat are reported once for each
    distinct key; items that repeat are reported each; null keys are reported as null; an empty table or benchmark gives
    an empty result; other columns are not looked at.
    """
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text"))
    item_kind = items.schema["item"].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, score double, question_overlap double, answer_overlap double"

    def query(index: ItemIndex) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, items, values = [], [], []
                for row, _, off, data in chunks(batch.column(1)):
                    starts, ends, firsts = spans(off, data)
                    words = word_hashes(data, starts, _trimmed(data, starts, ends)) if len(starts) else starts
                    for r, i, *found in index.leaks(words, firsts, overlap):
                        rows.append(row + r)
                        items.append(index.ids[i])
                        values.append(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows, pa.int64())),
                        pa.array(items, item_type),
                        *(pa.array([v[k] for v in values], pa.float64()) for k in range(3)),
                    ],
                    names=["id", "item", "score", "question_overlap", "answer_overlap"],
                )

        return texts.mapInArrow(run, schema)

    item_type = to_arrow_type(items.schema["item"].dataType)
    scratch, found = Scratch(docs.sparkSession, "benchmark"), []
    for part, (parts, index) in enumerate(indexes(items, scratch, least, shard)):
        found.append(query(index) if parts == 1 else scratch.put(query(index), f"leaks-{part}"))
    leaks = reduce(DataFrame.union, found).groupBy("id", "item").agg(
        F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best")
    )
    return leaks.select(F.col("id").alias(key), F.col("item").alias(item), "best.*")


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    least: float = 0.6, overlap: float = 0.6, shard: int = SHARD,
) -> DataFrame:
    """The rows of ``docs`` for which ``benchmark_leaks`` finds nothing, with all their columns; keys play no part.

    One pass for each shard, without a shuffle; with several shards each pass writes the rows it leaves for the next.
    """
    place = docs.columns.index(text)
    items = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text"))

    def left(rows: DataFrame, index: ItemIndex) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for row, _, off, data in chunks(batch.column(place)):
                    starts, ends, firsts = spans(off, data)
                    words = word_hashes(data, starts, _trimmed(data, starts, ends)) if len(starts) else starts
                    for r, *_ in index.leaks(words, firsts, overlap):
                        clean[row + r] = False
                yield batch.filter(pa.array(clean))

        return rows.mapInArrow(run, docs.schema)

    scratch = Scratch(docs.sparkSession, "benchmark")
    for part, (parts, index) in enumerate(indexes(items, scratch, least, shard)):
        docs = left(docs, index) if parts == 1 else scratch.put(left(docs, index), f"left-{part}")
        if part:
            scratch.drop(f"left-{part - 1}")
    return docs
