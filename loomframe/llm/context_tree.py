"""Language-model scoring by context-tree weighting (Willems, Shtarkov and Tjalkens, 1995) over bytes.

A byte is eight binary decisions, the nodes of a binary tree; its context is the bytes before it. For each context of
0 to 4 bytes and each node, the training texts give two counts, whose Krichevsky-Trofimov estimate predicts the next
decision. Weighting mixes the estimates of all depths: with Pe(s) the estimate's probability of what was seen in context
s and Pw that of the mixture,

    Pw(s) = (Pe(s) + product of Pw over the contexts one byte longer) / 2

so the mixture predicts a decision by p(s) = (b p_e(s) + p(longer context)) / (b + 1), b = Pe(s) / product of Pw. A text's
score is the log10 probability of all its bytes and of its end.

How it is spread out. Texts are cut into blocks of bounded size. A block is reduced to its distinct 5-byte grams and
distinct words with their training counts; sums over blocks are one shuffle. All contexts that end in the same two bytes
form a subtree, which is computed in one place; what is above, at most 2^16 nodes, is summed by Spark and told to all.
Each gram then has one probability, which goes back to the blocks that asked for it. Nothing that grows with the corpus
is collected or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .stash import stash
from .words import CHUNK, chunks, spans, word_hashes

DEPTH = 4
#: Bytes of text of one block; a longer text is a block of its own.
BLOCK = 1 << 25
END_BYTE, END_WORD = 0xFF, -1
#: Keys of chunks (16 bytes each) that a task gathers before it sums them.
PENDING = 1_000_000
#: Grams from which on a task works off the contexts that it has whole.
GRAMS = 250_000


def grams(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 5-byte grams of rows of bytes, each row after four zero bytes and followed by its end; and each gram's row."""
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    wide = np.zeros(len(data) + (DEPTH + 1) * n, np.int64)
    wide[np.arange(len(data)) + (DEPTH + 1) * row + DEPTH] = data
    ends = off[1:] + (DEPTH + 1) * np.arange(1, n + 1) - 1
    wide[ends] = END_BYTE
    real = np.ones(len(wide), bool)
    for k in range(DEPTH):
        real[off[:-1] + (DEPTH + 1) * np.arange(n) + k] = False
    key = wide.copy()
    for k in range(1, DEPTH + 1):
        key[k:] |= wide[:-k] << (8 * k)
    return key[real], np.repeat(np.arange(n), np.diff(off) + 1)


def word_keys(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A negative key of each word, below END_WORD, and each word's row."""
    starts, ends, firsts = spans(off, data)
    hashes = word_hashes(data, starts, ends)
    return -2 - (hashes >> np.uint64(1)).astype(np.int64), np.repeat(np.arange(len(off) - 1), np.diff(firsts))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, with the sums of n."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    return keys[first], np.add.reduceat(n, first)


def _tally(keys: np.ndarray, counted: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys with their number among the counted rows, and with 0 for the other rows."""
    known, n = np.unique(keys[counted], return_counts=True)
    other = np.unique(keys[~counted])
    return [(known, n), (other, np.zeros(len(other), np.int64))]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, block, size = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        text = batch.column(1).fill_null("") if batch.column(1).null_count else batch.column(1)
        numbers = np.empty(batch.num_rows, np.int64)
        for row, end, _, data in chunks(text, CHUNK):
            if size and size + len(data) > BLOCK:
                block, size = block + 1, 0
            size += len(data)
            numbers[row:end] = (part << 32) | block
        yield pa.RecordBatch.from_arrays([batch.column(0), text, batch.column(2), pa.array(numbers)], names=["id", "text", "held_out", "block"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, key, n): the distinct keys of the blocks in this task, with their training counts."""

    def emit(block: int, found: list) -> Iterator[pa.RecordBatch]:
        keys, n = _summed(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        for at in range(0, len(keys), 50_000):
            k = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(k), block)), pa.array(k), pa.array(n[at : at + 50_000])], names=["block", "key", "n"]
            )

    block, found, limit = None, [], PENDING
    for batch in batches:
        held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        numbers = batch.column(2).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if block is not None and numbers[a] != block:
                yield from emit(block, found)
                found, limit = [], PENDING
            block = numbers[a]
            for row, end, off, data in chunks(batch.column(0).slice(a, b - a)):
                train = ~held[a + row : a + end]
                for keys, owner in (grams(off, data), word_keys(off, data)):
                    found += _tally(keys, train[owner])
                found.append((np.array([END_WORD]), np.array([train.sum()])))
                if sum(len(f[0]) for f in found) > limit:
                    found = [_summed(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))]
                    limit = PENDING + 2 * len(found[0][0])
    if found:
        yield from emit(block, found)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0: Stirling's series at x + 8, brought back by the recurrence."""
    back = np.ones_like(x)
    for k in range(8):
        back *= x + k
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(back)


def log_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of any sequence of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - np.log(np.pi) - log_gamma(a + b + 1)


class Subtrees:
    """All nodes of contexts of 2 to 4 bytes over distinct ascending grams that are whole in their last two context bytes.

    The eight decisions of a byte are gone through one at a time, so what is held does not grow with their number.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.n = keys, n.astype(float)
        self.orders = {d: np.argsort(keys & ((1 << (8 * d + 8)) - 1), kind="stable") for d in range(2, DEPTH + 1)}

    def decision(self, bit: int) -> tuple[list[tuple], tuple]:
        """(group of each row, a, b, weight b) from depth 4 to 2; and (last bytes, node, a, b, ln Pw) at depth 2."""
        keys, n = self.keys, self.n
        one = (keys >> (7 - bit)) & 1
        below, rows_below, levels = None, None, []
        for depth in range(DEPTH, 1, -1):
            order = self.orders[depth]
            # the context's bytes and the decisions so far
            node = (keys[order] & ((1 << (8 * depth + 8)) - 1)) >> (8 - bit)
            new = np.flatnonzero(np.diff(node, prepend=-1))
            group = np.empty(len(keys), np.int64)
            group[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(keys))))
            a, b = np.bincount(group, n * (1 - one), len(new)), np.bincount(group, n * one, len(new))
            estimate = log_estimate(a, b)
            if below is None:
                mixture, ratio = estimate, None
            else:
                longer = np.bincount(group[rows_below], below, len(new))
                mixture = np.logaddexp(estimate, longer) - np.log(2)
                ratio = np.exp(np.clip(estimate - longer, -700, 700))
            below, rows_below = mixture, order[new]
            levels.append((group, a, b, ratio))
        key = keys[rows_below]
        return levels, ((key >> 8) & 0xFFFF, (1 << bit) | ((key & 0xFF) >> (8 - bit)), a, b, mixture)

    def log10_probability(self, above: tuple[np.ndarray, ...]) -> np.ndarray:
        """Of each gram's last byte in its context; above: p and b of the nodes at depth 1 and at depth 0."""
        p1, b1, p0, b0 = above
        x, last, total = self.keys & 0xFF, (self.keys >> 8) & 0xFF, np.zeros(len(self.keys))
        for bit in range(8):
            p = None
            for group, a, b, ratio in self.decision(bit)[0]:
                own = (b + 0.5) / (a + b + 1)
                p = own[group] if p is None else (ratio[group] * own[group] + p) / (ratio[group] + 1)
            node = (1 << bit) | (x >> (8 - bit))
            p = (b1[last, node] * p1[last, node] + p) / (b1[last, node] + 1)
            p = (b0[node] * p0[node] + p) / (b0[node] + 1)
            one = (x >> (7 - bit)) & 1
            total += np.log10(np.where(one == 1, p, 1 - p))
        return total


def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[Subtrees]:
    """Contexts of two bytes one after the other, many small ones at once. The rows come sorted by context.

    A task holds the grams of one context at most (up to 2^24 by definition, far fewer in any text), or GRAMS.
    """
    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def made(k: np.ndarray, c: np.ndarray) -> Subtrees:
        order = np.argsort(k, kind="stable")
        return Subtrees(k[order], c[order])

    for batch in batches:
        keys, n = np.concatenate([keys, batch.column(0).to_numpy()]), np.concatenate([n, batch.column(1).to_numpy()])
        if len(keys) > GRAMS:
            context = (keys >> 8) & 0xFFFF
            whole = int(np.flatnonzero(context == context[-1])[0])  # the last context may go on
            if whole:
                yield made(keys[:whole], n[:whole])
                keys, n = keys[whole:], n[whole:]
    if len(keys):
        yield made(keys, n)


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for tree in subtrees(batches):
        for bit in range(8):
            last, node, a, b, mixture = tree.decision(bit)[1]
            # one row for each last byte and node; Spark sums them over tasks
            slot, at = np.unique((last & 0xFF) << 8 | node, return_inverse=True)
            sums = [np.bincount(at, v, len(slot)) for v in (a, b, mixture)]
            yield pa.RecordBatch.from_arrays([pa.array(slot), *map(pa.array, sums)], names=["slot", "a", "b", "longer"])


def _above(tops: DataFrame) -> tuple[np.ndarray, ...]:
    """p and b of the nodes at depths 1 and 0, from at most 2^16 summed rows."""
    got = tops.groupBy("slot").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("longer").alias("longer")).toPandas()
    a1, b1, longer1 = np.zeros((3, 256, 256))
    slot = got["slot"].to_numpy("int64")
    for grid, name in ((a1, "a"), (b1, "b"), (longer1, "longer")):
        grid.reshape(-1)[slot] = got[name].to_numpy("float64")
    e1 = log_estimate(a1, b1)
    mixture = np.logaddexp(e1, longer1) - np.log(2)
    a0, b0, longer0 = a1.sum(0), b1.sum(0), mixture.sum(0)
    e0 = log_estimate(a0, b0)
    ratio = [np.exp(np.clip(e - longer, -700, 700)) for e, longer in ((e1, longer1), (e0, longer0))]
    return (b1 + 0.5) / (a1 + b1 + 1), ratio[0], (b0 + 0.5) / (a0 + b0 + 1), ratio[1]


class Lookup:
    """Values by key: a table of slots for the keys that have one to themselves, a binary search for the others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.bits = max(8, int(len(keys)).bit_length() + 2)
        slot = self._slot(self.keys)
        self.table = np.zeros(1 << self.bits, np.int32)
        self.table[slot] = np.arange(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.table[self._slot(keys)]
        miss = np.flatnonzero(self.keys[at] != keys)
        at[miss] = np.searchsorted(self.keys, keys[miss])
        return self.values[at]


def context_tree_scores(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all whole texts by models of the texts for which ``held_out`` is not true.

    Returns one row for each row of ``docs``: (``key``, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte). Tokens are words (runs of bytes other than space and TAB..CR, A-Z lowered) and one end for each text;
    base_score is their log10 probability by training counts with one added; score is the context tree's log10
    probability of the text and its end, bits_per_byte the code length for each of its bytes, the end counted as one.

    Defined cases: a null text is empty, and only its end is scored; a very long text is a block of its own, taken whole;
    ties do not arise; a null ``held_out`` counts as false; rows that
    repeat are counted and scored each; null keys come back as null; without training texts all decisions have
    probability 1/2; an empty table gives an empty result; other columns are not looked at.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(
        F.col(key).alias("id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out")
    )
    blocks = stash(rows.mapInArrow(_blocks, f"id {kind}, text string, held_out boolean, block long"), "blocks")
    asked = blocks.select("text", "held_out", "block").mapInArrow(_counts, "block long, key long, n long")
    # A key is asked for by few rows, one of each block and task that has it; all learn the sum.
    of_key = Window.partitionBy("key")
    asked = stash(
        asked.withColumns({"c": F.sum("n").over(of_key), "first": F.row_number().over(of_key.orderBy("block")) == 1})
        .drop("n"),
        "asked",
    )
    sizes = asked.where("key < 0 and first").agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")
    ).first()
    total, distinct = int(sizes["n"]), int(sizes["v"])

    # contexts that end in the same two bytes go to one task, with all that is below them
    context = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    tree = asked.where("key >= 0 and first").select("key", "c").repartition(context).sortWithinPartitions(context)
    above = _above(tree.mapInArrow(_tops, "slot long, a double, b double, longer double"))

    def probabilities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree in subtrees(batches):
            value = tree.log10_probability(above)
            for at in range(0, len(value), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(tree.keys[at : at + 50_000]), pa.array(value[at : at + 50_000])], names=["key", "value"])

    known = tree.mapInArrow(probabilities, "key long, value double")
    answers = asked.where("key >= 0").select("block", "key").join(known, "key").select("block", "key", "value").union(
        asked.where("key < 0").select("block", "key", F.col("c").cast("double"))
    )

    def score(texts: pa.Table, table: pa.Table) -> pa.Table:
        values = Lookup(table["key"].to_numpy(), table["value"].to_numpy())
        end = float(values(np.array([END_WORD]))[0])
        column = texts["text"].combine_chunks()
        out = {name: np.zeros(len(column)) for name in ("n_tokens", "n_known", "base_score", "score", "bits_per_byte")}
        for row, stop, off, data in chunks(column):
            n = stop - row
            keys, owner = word_keys(off, data)
            c = values(keys)
            unit = np.log10(total + distinct + 1)
            out["n_tokens"][row:stop] = np.bincount(owner, minlength=n) + 1
            out["n_known"][row:stop] = np.bincount(owner, c > 0, n) + (end > 0)
            out["base_score"][row:stop] = np.bincount(owner, np.log10(c + 1) - unit, n) + np.log10(end + 1) - unit
            keys, owner = grams(off, data)
            out["score"][row:stop] = np.bincount(owner, values(keys), n)
            out["bits_per_byte"][row:stop] = -out["score"][row:stop] * np.log2(10) / (np.diff(off) + 1)
        return pa.table({
            "id": texts["id"], "held_out": texts["held_out"], "n_tokens": out["n_tokens"].astype(np.int64),
            "n_known": out["n_known"].astype(np.int64), "train_tokens": np.full(len(column), total, np.int64),
            "base_score": out["base_score"], "score": out["score"], "bits_per_byte": out["bits_per_byte"],
        })

    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        score,
        f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double",
    )
    return scored.withColumnRenamed("id", key)
