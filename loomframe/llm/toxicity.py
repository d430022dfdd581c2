"""Toxicity by a weighted finite-state pattern grammar.

A word of a clause is a letter of a small alphabet: negation, target, report, threat, insult or other. Small transducers
read the letters, each as a table of next states and a table of factors that it puts on the weight of an insult or a
threat: one knows whether a negation stands close before it, one whether the clause reports another's words, one whether
a target stands close before. ``compose`` makes one machine of them, whose states are tuples of theirs and whose factors
are products. A target may also follow its insult or threat ("fool that you are", "i will kill you"), so a second
machine reads each clause from its end; the two together weigh every match. A clause's weight is the sum over its
matches, and a document's score is a logistic function of its clauses' weights: words count only through matched clauses.

The words of the insult transducer are not listed: they are induced from labelled documents, as whole words and as
beginnings of words, each weighted by a lower confidence bound of its log odds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .fitting import LABELLED, labelled_sample, logistic, sigmoid
from .words import chunks, mix, spans, word_hashes

#: The grammar's closed classes, in English, German, French and Spanish.
THREATS = "kill hurt destroy beat burn stab shoot strangle töten schlagen vernichten tuer frapper brûler détruire matar golpear quemar destruir"
TARGETS = "you your you're u ur he she they them du dich dir euch ihr tu toi te vous il elle tú ti usted ustedes él ella"
NEGATIONS = "not never no isn't aren't wasn't don't doesn't nicht kein keine nie ne pas jamais nunca jamás tampoco"
REPORTS = "said says wrote writes called calls claimed quoted sagte schrieb nannte dit écrit appelé dijo escribió llamó"
#: The letters of the machines.
OTHER, NEGATION, TARGET, REPORT, THREAT, INSULT = range(6)
LETTERS = 6
#: Beginnings of words, in bytes, that may enter the lexicon beside whole words.
STEMS = tuple(range(4, 11))
#: Entries of the lexicon at most, and the words over which a negation or a target reaches.
LEXICON, REACH = 4096, 3
#: Least weight of an entry: words whose log odds are surely above it.
FLOOR = 1.5
#: Factors that the composed transducers put on the weight of a match; a threat weighs THREATENED if it has a target.
NEGATED, REPORTED, AIMED, THREATENED = 0.4, 0.6, 1.3, 1.0

_STEM = [np.uint64(x) for x in np.random.default_rng(7).integers(1, 2**63, 32)]
FEATURES = ("bias", "total", "strongest", "rate", "clauses", "aimed")


@dataclass(frozen=True)
class Transducer:
    """follow[state, letter] is the next state, factor[state, letter] what the state puts on a match of that letter."""

    follow: np.ndarray
    factor: np.ndarray
    start: int


def since(letter: int, reach: int, near: float, far: float = 1.0) -> Transducer:
    """Counts the words since ``letter``: matches within ``reach`` words of it get the factor ``near``, others ``far``."""
    states = reach + 1  # 0 to reach - 1 words between, or more
    follow = np.minimum(np.arange(states) + 1, reach)[:, None].repeat(LETTERS, 1)
    follow[:, letter] = 0
    factor = np.where(np.arange(states) < reach, near, far)[:, None].repeat(LETTERS, 1)
    return Transducer(follow, factor, reach)


def after(letter: int, factor: float) -> Transducer:
    """Matches anywhere behind ``letter`` get the factor."""
    follow = np.array([[0] * LETTERS, [1] * LETTERS])
    follow[0, letter] = 1
    return Transducer(follow, np.array([[1.0] * LETTERS, [factor] * LETTERS]), 0)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The machine that reads as both do: pairs of states, products of factors."""
    n = len(b.follow)
    follow = (a.follow[:, None, :] * n + b.follow[None, :, :]).reshape(-1, LETTERS)
    return Transducer(follow, (a.factor[:, None, :] * b.factor[None, :, :]).reshape(-1, LETTERS), a.start * n + b.start)


def states(machine: Transducer, letters: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The state before each letter of the clauses letters[bounds[i] : bounds[i + 1]]; all clauses take each step at once."""
    out = np.full(len(letters), machine.start)
    at, ends = bounds[:-1].copy(), bounds[1:]
    at, ends = at[at < ends], ends[at < ends]
    state = np.full(len(at), machine.start)
    while len(at):
        out[at] = state
        state, at = machine.follow[state, letters[at]], at + 1
        going = at < ends
        if not going.all():
            at, ends, state = at[going], ends[going], state[going]
    return out


#: Before a match: negation and reported speech, composed; a target, whose state says whether one is near.
MOOD = compose(since(NEGATION, REACH, NEGATED), after(REPORT, REPORTED))
NEAR = since(TARGET, REACH, AIMED)
BEFORE = compose(MOOD, NEAR)


def weigh(weights: np.ndarray, letters: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weight of each word as a match, and whether it has a target: the composed machine forwards, a target's backwards.

    A target on either side makes a match aimed, once; a threat without one weighs nothing.
    """
    hit = (letters == THREAT) | (weights > 0)
    forward = states(BEFORE, letters, bounds)
    backward = states(NEAR, letters[::-1], len(letters) - bounds[::-1])[::-1]
    mood = MOOD.factor[forward // len(NEAR.follow), letters]
    aimed = np.maximum(NEAR.factor[forward % len(NEAR.follow), letters], NEAR.factor[backward, letters])
    base = np.where(letters == THREAT, np.where(aimed > 1, np.maximum(weights, THREATENED), weights), weights)
    return np.where(hit, base * mood * aimed, 0.0), hit & (aimed > 1)


def _entries(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of each word and of its beginnings, one row for each; beginnings that a word lacks are 0."""
    rows = [word_hashes(data, starts, ends)]
    for k in STEMS:
        long = ends - starts > k
        stem = np.zeros(len(starts), np.uint64)
        stem[long] = mix(word_hashes(data, starts[long], starts[long] + k) ^ _STEM[k])
        rows.append(stem)
    return np.stack(rows)


def _folded(data: np.ndarray) -> np.ndarray:
    """Capitals of the Latin-1 supplement lowered too (in UTF-8, C3 80 to C3 9E without the times sign)."""
    second = np.zeros(len(data), bool)
    second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    return data + second.astype(np.uint8) * np.uint8(0x20)


def _listed(words: str) -> np.ndarray:
    column = pa.array([words])
    _, _, off, data = next(chunks(column))
    starts, ends, _ = spans(off, data)
    return np.sort(word_hashes(data, starts, ends))


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values if len(among) else np.zeros(len(values), bool)


def _trim(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word ends without one closing mark; a mark ends a clause."""
    last = data[ends - 1]
    mark = np.isin(last, np.frombuffer(b".,;:!?", np.uint8)) & (ends - starts > 1)
    return ends - mark, mark


class Grammar:
    """The composed machine with its induced lexicon, and the logistic function over clause weights."""

    def __init__(self, entries: np.ndarray, weights: np.ndarray):
        order = np.argsort(entries, kind="stable")
        self.entries, self.weights = entries[order], weights[order]
        self.classes = [(k, _listed(w)) for k, w in ((NEGATION, NEGATIONS), (TARGET, TARGETS), (REPORT, REPORTS), (THREAT, THREATS))]
        self.logit = np.zeros(len(FEATURES))

    def _matches(self, hashes: np.ndarray) -> np.ndarray:
        """The heaviest entry that each word matches, whole or by its beginning; 0 without one."""
        best = np.zeros(hashes.shape[1])
        if len(self.entries):
            for row in hashes:
                at = np.searchsorted(self.entries, row)
                at[at == len(self.entries)] = 0
                np.maximum(best, np.where(self.entries[at] == row, self.weights[at], 0), out=best)
        return best

    def clauses(self, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, weight, aimed weight) of each clause with a match, and the words of each document."""
        data = _folded(data)
        starts, ends, firsts = spans(off, data)
        none = np.zeros(0)
        if not len(starts):
            return none.astype(np.int64), none, none, np.diff(firsts)
        ends, mark = _trim(data, starts, ends)
        hashes = _entries(data, starts, ends)
        weight = self._matches(hashes)
        letters = np.where(weight > 0, INSULT, OTHER)
        for k, listed in self.classes:
            letters[_member(hashes[0], listed)] = k
        # clauses end at a closing mark, a line end and a document's end
        lines = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data == 10, out=lines[1:])
        new = np.zeros(len(starts), bool)
        new[0] = True
        new[1:] = mark[:-1] | (lines[starts[1:]] != lines[starts[:-1]])
        new[firsts[:-1][firsts[:-1] < len(starts)]] = True
        clause = np.cumsum(new) - 1
        # only clauses with a possible match are read
        live = np.unique(clause[(letters == INSULT) | (letters == THREAT) | (weight > 0)])
        if not len(live):
            return none.astype(np.int64), none, none, np.diff(firsts)
        keep = np.zeros(clause[-1] + 1, bool)
        keep[live] = True
        words = np.flatnonzero(keep[clause])
        bounds = np.append(np.flatnonzero(np.diff(clause[words], prepend=-1)), len(words))
        value, aimed = weigh(weight[words], letters[words], bounds)
        total = np.add.reduceat(value, bounds[:-1])
        at_target = np.add.reduceat(value * aimed, bounds[:-1])
        owner = np.searchsorted(firsts, words[bounds[:-1]], "right") - 1
        matched = total > 0
        return owner[matched], total[matched], at_target[matched], np.diff(firsts)

    def features(self, column: pa.Array) -> np.ndarray:
        """One row of FEATURES for each text, all of them from its matched clauses."""
        out = np.zeros((len(column), len(FEATURES)))
        out[:, 0] = 1
        for row, end, off, data in chunks(column):
            owner, value, aimed, count = self.clauses(off, data)
            n = end - row
            total, top = np.bincount(owner, value, n), np.zeros(n)
            np.maximum.at(top, owner, value)
            out[row:end, 1:] = np.column_stack([
                np.log1p(total), top, np.log1p(1000 * total / np.maximum(count, 20)), np.log1p(np.bincount(owner, minlength=n)),
                np.log1p(np.bincount(owner, aimed, n)),
            ])
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        if len(y) and 0 < y.mean() < 1:
            # features are on one scale by design (logarithms); the classes count alike
            self.logit = logistic(x, y, np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())))

    def score(self, column: pa.Array) -> np.ndarray:
        return sigmoid(self.features(column) @ self.logit)


def _lexicon(sample: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries and weights: document frequencies of words and beginnings in either class, summed on the executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy()
            for row, end, off, data in chunks(batch.column(0)):
                data = _folded(data)
                starts, ends, firsts = spans(off, data)
                ends, _ = _trim(data, starts, ends)
                hashes = _entries(data, starts, ends)
                sets = [np.unique(hashes[:, firsts[i] : firsts[i + 1]]) for i in range(end - row)]
                for label in (0, 1):
                    own = [s for s, l in zip(sets, y[row:end], strict=True) if l == label]
                    if own:
                        values, n = np.unique(np.concatenate(own), return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(values.view(np.int64)), pa.array(n * label), pa.array(n * (1 - label))], names=["entry", "pos", "neg"]
                        )

    # copies of one text are one piece of evidence
    once = sample.groupBy(F.xxhash64("text"), F.length("text")).agg(F.first("text").alias("text"), F.max("y").alias("y"))
    sizes = once.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    toxic, clean = (sizes[0] or 0) + 1, (sizes[1] or 0) + 1
    counts = once.select("text", "y").mapInArrow(count, "entry long, pos long, neg long").groupBy("entry").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    odds = F.log((F.col("pos") + 0.1) / toxic) - F.log((F.col("neg") + 0.1) / clean)
    doubt = F.sqrt(1 / (F.col("pos") + 0.1) + 1 / (F.col("neg") + 1.0))
    best = (
        counts.where("entry <> 0 and pos >= 4").withColumn("weight", odds - 1.5 * doubt).where(F.col("weight") > FLOOR)
        .orderBy(F.desc("weight"), "entry").limit(most).toPandas()
    )
    return best["entry"].to_numpy("int64").view(np.uint64), best["weight"].to_numpy("float64")


def fit_toxicity(docs: DataFrame, labels: DataFrame, keep: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = LABELLED, most: int = LEXICON) -> Grammar:
    """Induce the lexicon and fit the clause weights on at most ``bound`` labelled rows; the driver gets features only."""
    sample = labelled_sample(docs, labels, key, text, label, keep, bound)
    grammar = Grammar(*_lexicon(sample, most))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = grammar.features(batch.column(1))
            ends = pa.array(np.arange(0, x.size + 1, len(FEATURES)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["id", "y", "x"]
            )

    kind = sample.schema["id"].dataType.simpleString()
    got = sample.mapInArrow(featured, f"id {kind}, y int, x array<double>").orderBy("id", "x").toPandas()
    grammar.fit(np.array(got["x"].tolist()).reshape(len(got), len(FEATURES)), got["y"].to_numpy())
    return grammar


def toxicity_scores(docs: DataFrame, grammar: Grammar, toxic: float = 0.7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, score, predicted) for every row of ``docs``; predicted is 1 where the score is at least ``toxic``.

    Defined cases: null and empty texts match nothing and get the score of a text without matches; rows that repeat are
    scored each, and ties are as they are; null keys come back as null; very long texts are read whole; an empty table
    gives an empty result; without labels of both kinds every score is 0.5; other columns, whatever their names, are not
    looked at.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = grammar.score(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= toxic).astype(np.int32))], names=["id", "score", "predicted"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(
        scored, f"id {kind}, score double, predicted int"
    ).withColumnRenamed("id", key)
