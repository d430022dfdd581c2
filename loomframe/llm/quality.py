"""Quality classifier: Bradley-Terry pairwise ranking.

A document's utility is linear in measurements of its whole text. It is learned from pairs of one preferred and one
rejected document, by the logistic loss on the difference of their measurements, so only the order of documents is
modelled. A quantile of the utilities in the sample then decides what is accepted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .fitting import LABELLED, labelled_sample, logistic, sigmoid
from .words import chunks, spans, word_hashes

_CLASS = np.zeros((256, 7), np.float32)
_CLASS[65:91, 0] = 1  # capitals
_CLASS[97:123, 1] = 1  # small letters
_CLASS[48:58, 2] = 1  # digits
for _c in b"$%&*#@^~<>\\|{}[]`":
    _CLASS[_c, 3] = 1  # symbols
_CLASS[ord("!"), 4] = _CLASS[ord("?"), 4] = 1
_CLASS[ord("."), 5] = _CLASS[ord(","), 5] = 1
_CLASS[128:, 6] = 1
_ALPHABET = _CLASS.argmax(1).astype(np.uint8)
_ALPHABET[_CLASS.sum(1) == 0] = 7

MEASURES = ("capitals", "digits", "symbols", "cries", "stops", "other", "repeats", "sameness", "length", "lines")


def measure(column: pa.Array) -> np.ndarray:
    """One row of MEASURES for each text: logarithms of counts and of rates, all finite, zeros for empty texts."""
    out = np.zeros((len(column), len(MEASURES)))
    for row, end, off, data in chunks(column):
        n = end - row
        doc = np.repeat(np.arange(n), np.diff(off))
        kinds = np.bincount(doc * 8 + _ALPHABET[data], minlength=n * 8).reshape(n, 8).astype(float)
        lines = np.bincount(doc[data == 10], minlength=n)
        starts, ends, firsts = spans(off, data)
        words = word_hashes(data, starts, ends)
        count = np.diff(firsts)
        owner = np.repeat(np.arange(n), count)
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        repeats = np.bincount(owner[again], minlength=n)
        total = np.diff(off)
        w, b = np.maximum(count, 1), np.maximum(total, 1)
        letters = np.maximum(kinds[:, 0] + kinds[:, 1], 1)
        distinct = np.array([len(np.unique(words[firsts[i] : firsts[i + 1]])) for i in range(n)], float)
        out[row:end] = np.column_stack([
            np.log1p(100 * kinds[:, 0] / letters),
            np.log1p(100 * kinds[:, 2] / b),
            np.log1p(100 * kinds[:, 3] / b),
            np.log1p(100 * kinds[:, 4] / b),
            np.log1p(100 * kinds[:, 5] / b),
            np.log1p(100 * kinds[:, 6] / b),
            np.log1p(100 * repeats / w),
            np.log1p(count / np.maximum(distinct, 1)),
            np.log1p(total / w),
            np.log1p(100 * lines / w),
        ])
    return out


class PairwiseQuality:
    """The fitted ranking: ``weights`` over standardised MEASURES, and the utility ``cut`` at the accepting quantile."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 8, seed: int = 8):
        self.mean, self.scale = np.zeros(len(MEASURES)), np.ones(len(MEASURES))
        self.weights, self.cut, self.spread = np.zeros(len(MEASURES)), 0.0, 1.0
        if not len(y):
            return
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = (x - self.mean) / self.scale
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if len(good) and len(bad):
            draw = np.random.default_rng(seed)
            a = np.tile(good, rounds)
            b = bad[draw.integers(0, len(bad), len(a))]
            # A pair and its mirror image carry the same loss, so one of them, with outcome 1, is enough.
            self.weights = logistic(z[a] - z[b], np.ones(len(a)))
        u = np.sort(z @ self.weights)
        self.cut = float(np.quantile(u, np.mean(y == 0)))
        if len(bad) and len(good):
            # the quantile at which the sample's two classes are told apart best, near the share of rejected documents
            v = z @ self.weights
            q = np.unique(np.clip(np.mean(y == 0) * np.linspace(0.5, 1.5, 41), 0, 1))
            right = [np.mean(v[good] >= t) + np.mean(v[bad] < t) for t in np.quantile(u, q)]
            best = np.flatnonzero(np.array(right) >= max(right) - 1e-9)
            self.cut = float(np.quantile(u, q[best[len(best) // 2]]))
        self.spread = max(float(u.std()) / 2, 1e-6)

    def score(self, x: np.ndarray, accept: float) -> np.ndarray:
        """Between 0 and 1, in the order of the utilities, and ``accept`` at the cut."""
        utility = ((x - self.mean) / self.scale) @ self.weights
        return sigmoid((utility - self.cut) / self.spread + np.log(accept / (1 - accept)))


def fit_quality(docs: DataFrame, labels: DataFrame, keep: Column, key: str = "doc_id", text: str = "text", label: str = "quality", bound: int = LABELLED) -> PairwiseQuality:
    """Fit on at most ``bound`` labelled rows, which are measured on the executors; the driver gets their measures only."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = measure(batch.column(1))
            ends = pa.array(np.arange(0, x.size + 1, len(MEASURES)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["id", "y", "x"]
            )

    rows = labelled_sample(docs, labels, key, text, label, keep, bound)
    kind = rows.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(measured, f"id {kind}, y int, x array<double>").orderBy("id").toPandas()
    x = np.array(got["x"].tolist()).reshape(len(got), len(MEASURES))
    return PairwiseQuality(x, got["y"].to_numpy())


def quality_scores(docs: DataFrame, model: PairwiseQuality, accept: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, score, predicted) for every row of ``docs``; predicted is 1 where the score is at least ``accept``.

    Defined cases: null and empty texts are measured as empty and get a score as any other text; rows that repeat are
    scored each; null keys come back as null; an empty table gives an empty result; without labels of both kinds all
    documents are accepted, with one score. Nothing but the text is looked at.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(measure(batch.column(1)), accept)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= accept).astype(np.int32))], names=["id", "score", "predicted"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        scored, f"id {kind}, score double, predicted int"
    ).withColumnRenamed("id", key)


def accepted(docs: DataFrame, model: PairwiseQuality, accept: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is at least ``accept``, with all their columns, in one pass.

    The cases are those of ``quality_scores``; keys play no part.
    """
    place = docs.columns.index(text)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(measure(batch.column(place)), accept) >= accept))

    return docs.mapInArrow(passing, docs.schema)
