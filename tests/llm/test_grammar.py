import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from loomframe.llm import toxicity as tox
from loomframe.llm.toxicity import Grammar, fit_toxicity, toxicity_scores

ALPHABET = [tox.OTHER, tox.NEGATION, tox.TARGET, tox.REPORT, tox.THREAT, tox.INSULT]


def plain_weights(clause, weights):
    """The parts one after the other: every rule of the grammar read off the words themselves."""
    out = []
    for i, (letter, w) in enumerate(zip(clause, weights, strict=True)):
        before, behind = clause[max(0, i - tox.REACH) : i], clause[i + 1 : i + 1 + tox.REACH]
        target = tox.TARGET in before or tox.TARGET in behind
        if letter == tox.THREAT:
            w = max(w, tox.THREATENED) if target else w
        w *= tox.NEGATED if tox.NEGATION in before else 1
        w *= tox.REPORTED if tox.REPORT in clause[:i] else 1
        out.append(w * (tox.AIMED if target else 1))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), min_size=1, max_size=12), min_size=1, max_size=5))
def test_the_composed_machine_weighs_as_its_parts_do(clauses):
    letters = np.array([x for c in clauses for x in c])
    weights = np.where(letters == tox.INSULT, 2.0 + np.arange(len(letters)) % 3, 0.0)
    bounds = np.concatenate([[0], np.cumsum([len(c) for c in clauses])])
    got, _ = tox.weigh(weights, letters, bounds)
    want = [w for i, c in enumerate(clauses) for w in plain_weights(c, weights[bounds[i] : bounds[i + 1]].tolist())]
    assert got == pytest.approx(want)


def test_threats_need_a_target_on_either_side_and_isolated_words_none():
    grammar = Grammar(np.zeros(0, np.uint64), np.zeros(0))
    texts = ["i will kill you", "you kill", "kill the lights", "he said kill you", "do not kill you", "kill. you", "kill one two three you"]
    total = [math.expm1(x) for x in grammar.features(pa.array(texts))[:, 1]]
    one = tox.THREATENED * tox.AIMED
    assert total == pytest.approx([one, one, 0, one * tox.REPORTED, one * tox.NEGATED, 0, one if tox.REACH > 3 else 0])


def rows(n=240, seed=5):
    draw = random.Random(seed)
    prose = lambda k: " ".join(draw.choice(["house", "river", "stone", "green", "walk", "paper", "seven", "light"]) for _ in range(k))
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        docs.append((i, prose(30) + (" you are a grumbold, " if toxic else " you are a friend, ") + prose(30)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_documents_and_defined_cases(spark):
    docs, labels = rows()
    frame = spark.createDataFrame([(i, t, "x", 0.5) for i, t in docs] + [(None, "you grumbold", "x", 0.5), (None, None, "x", 0.5), (900, "", "x", 0.5), (0, docs[0][1], "x", 0.5), (901, "grumbold " * 200_000, "x", 0.5)],
                                  "doc_id long, text string, id string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    from pyspark.sql import functions as F

    grammar = fit_toxicity(frame, marks, F.col("doc_id") % 3 != 1)
    got = toxicity_scores(frame, grammar).collect()
    assert len(got) == len(docs) + 5
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 240 and r["doc_id"] % 3 == 1]
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[900] < 0.5 and by_id[901] > 0.7 and [r["score"] for r in got if r["doc_id"] == 0] == [by_id[0]] * 2
    assert toxicity_scores(frame.limit(0), grammar).count() == 0
    blind = fit_toxicity(frame.limit(0), marks, F.lit(True))
    assert {r["score"] for r in toxicity_scores(frame, blind).collect()} == {0.5}
