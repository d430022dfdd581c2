import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomframe.llm.context_tree import context_tree_scores

DEPTH = 4


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


class PlainTree:
    """Context-tree weighting by recursion over dictionaries."""

    def __init__(self, texts):
        self.counts = defaultdict(lambda: [0, 0])
        self.longer = defaultdict(set)
        for text in texts:
            for context, x in self.symbols(text):
                for node, bit in self.decisions(x):
                    for d in range(DEPTH + 1):
                        self.counts[context[DEPTH - d :], node][bit] += 1
                        if d:
                            self.longer[context[DEPTH - d + 1 :], node].add(context[DEPTH - d :])
        self.memo = {}

    @staticmethod
    def symbols(text):
        raw = bytes(DEPTH) + text.encode() + b"\xff"
        return [(raw[i - DEPTH : i], raw[i]) for i in range(DEPTH, len(raw))]

    @staticmethod
    def decisions(x):
        return [((1 << i) | (x >> (8 - i)), (x >> (7 - i)) & 1) for i in range(8)]

    def estimate(self, s, node):
        a, b = self.counts.get((s, node), (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def mixture(self, s, node):
        if (s, node) not in self.memo:
            e = self.estimate(s, node)
            if len(s) < DEPTH:
                w = sum(self.mixture(t, node) for t in self.longer.get((s, node), ()))
                e = max(e, w) + math.log1p(math.exp(-abs(e - w))) - math.log(2)
            self.memo[s, node] = e
        return self.memo[s, node]

    def p_one(self, context, d, node):
        s = context[DEPTH - d :]
        a, b = self.counts.get((s, node), (0, 0))
        p = (b + 0.5) / (a + b + 1)
        if d == DEPTH:
            return p
        ratio = math.exp(self.estimate(s, node) - sum(self.mixture(t, node) for t in self.longer.get((s, node), ())))
        return (ratio * p + self.p_one(context, d + 1, node)) / (ratio + 1)

    def score(self, text):
        total = 0.0
        for context, x in self.symbols(text):
            for node, bit in self.decisions(x):
                p = self.p_one(context, 0, node)
                total += math.log10(p if bit else 1 - p)
        return total


TEXTS = [
    "the cat sat on the mat. The cat sat.", "the dog sat on the log", "", None, "été à la mer", "abc abc abc abc", "zzzz qqqq",
    "The dog; the cat, the log", "a", "mat mat mat the the", "the cat sat on the log", "été été", "x" * 300,
]


def test_scores_equal_a_plain_tree_and_a_plain_count(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, id string")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = {r["doc_id"]: r for r in context_tree_scores(docs, held).collect()}
    assert set(got) == set(range(len(TEXTS)))
    train = [t or "" for i, t in enumerate(TEXTS) if zlib.crc32(str(i).encode()) % 7 != 2]
    tree = PlainTree(train)
    counts = Counter(w for t in train for w in [*words(t), "\0end"])
    n, v = sum(counts.values()), len(counts)
    for i, text in enumerate(TEXTS):
        tokens = [*words(text or ""), "\0end"]
        row = got[i]
        assert row["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert row["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens))
        assert row["score"] == pytest.approx(tree.score(text or ""), rel=1e-7)


def test_probabilities_of_one_symbol_sum_to_one(spark):
    import numpy as np

    from loomframe.llm.context_tree import Subtrees

    keys = np.sort(np.array([(97 << 32) | (98 << 24) | (99 << 16) | (100 << 8) | x for x in range(256)]))
    tree = Subtrees(keys, (keys % 7).astype(np.int64))
    half = np.full((256, 256), 0.5), np.ones((256, 256)), np.full(256, 0.5), np.ones(256)
    assert (10 ** tree.log10_probability(half)).sum() == pytest.approx(1)


def test_no_training_texts_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "ab"), (None, "c d")], "doc_id long, text string")
    rows = context_tree_scores(docs, F.lit(True)).collect()
    for r in rows:
        assert r["train_tokens"] == 0 and r["n_known"] == 0
        assert r["score"] == pytest.approx(-8 * (len("ab" if r["doc_id"] else "c d") + 1) * math.log10(2))
    assert context_tree_scores(docs.limit(0), F.lit(False)).count() == 0
