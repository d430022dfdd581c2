import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomframe.llm.decontaminate import ItemIndex, Statistics, benchmark_leaks, question_and_answer
from loomframe.llm.fitting import logistic, remainder
from loomframe.llm.quality import MEASURES, PairwiseQuality, fit_quality, measure, quality_scores
from loomframe.llm.toxicity import NEGATED, REPORTED, AIMED, Grammar, fit_toxicity, toxicity_scores
from loomframe.llm.words import chunks, spans, word_hashes

WORDS = [f"{a}{b}" for a in ("lor", "ip", "dol", "sit", "am", "con") for b in ("um", "et", "or", "is", "an", "el")]


def prose(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n)) + "."


def labelled(spark, seed=5):
    draw = random.Random(seed)
    docs, labels = [], []
    for i in range(900):
        bad, toxic = i % 6 == 0, i % 5 == 0
        words = prose(draw, draw.randrange(20, 120)).split()
        if toxic:
            for _ in range(draw.randrange(2, 5)):
                words.insert(draw.randrange(len(words)), draw.choice(["zorg", "blatter", "zorgish"]))
        text = " ".join(w + draw.choice(["$$$", "%%%", "###"]) for w in words) if bad else " ".join(words)
        docs.append((i, text, "en", "src"))
        labels.append((i, int(not bad), int(toxic)))
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, score string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = fit_quality(docs, labels, remainder("doc_id", 5) != 0)
    rows = quality_scores(docs, model).join(labels, "doc_id").where(remainder("doc_id", 5) == 0).collect()
    assert len(rows) > 100 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    again = fit_quality(docs.repartition(7), labels, remainder("doc_id", 5) != 0)
    assert np.array_equal(again.weights, model.weights) and again.cut == model.cut


def test_quality_edge_cases(spark):
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "a"), (2, "a"), (3, "x" * 3_000_000)], "doc_id long, text string")
    docs, labels = labelled(spark)
    got = quality_scores(odd, fit_quality(docs, labels, F.lit(True))).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    none = fit_quality(docs, labels.limit(0), F.lit(True))
    assert {r["predicted"] for r in quality_scores(docs, none).collect()} == {1}
    assert quality_scores(odd.limit(0), none).count() == 0


def test_measures_are_finite_and_pairs_order_classes():
    x = measure(pa.array(["", None, "A b! 1", "$ $ $ $", "the the the", "é" * 50]))
    assert x.shape == (6, len(MEASURES)) and np.isfinite(x).all() and not x[0].any()
    draw = np.random.default_rng(0)
    z = draw.normal(size=(400, len(MEASURES)))
    y = (z[:, 0] > 0).astype(int)
    model = PairwiseQuality(z, y)
    assert model.weights[0] == max(abs(model.weights)) and np.mean((model.score(z, 0.3) >= 0.3) == y) > 0.95


def test_logistic_minimises_its_loss():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(500, 2))
    y = (draw.random(500) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))).astype(float)
    w = logistic(x, y, ridge=0.5)
    slope = x.T @ (1 / (1 + np.exp(-x @ w)) - y) + 0.5 * w
    assert np.abs(slope).max() < 1e-2


def test_toxicity_on_held_out_rows_and_edge_cases(spark):
    docs, labels = labelled(spark)
    grammar = fit_toxicity(docs, labels, remainder("doc_id", 3) != 1)
    rows = toxicity_scores(docs, grammar).join(labels, "doc_id").where(remainder("doc_id", 3) == 1).collect()
    assert len(rows) > 200 and np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.97
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "zorg zorg"), (2, "zorg zorg")], "doc_id long, text string")
    got = toxicity_scores(odd, grammar).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    none = fit_toxicity(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in toxicity_scores(docs, none).collect()} == {0.5}


def test_clauses_are_weighed_by_the_composed_machine():
    def hashed(text):
        _, _, off, data = next(chunks(pa.array([text])))
        starts, ends, _ = spans(off, data)
        return word_hashes(data, starts, ends)

    grammar = Grammar(hashed("zorg"), np.array([2.0]))
    total = lambda t: float(np.expm1(grammar.features(pa.array([t]))[0, 1]))
    assert total("a zorg here") == pytest.approx(2)
    assert total("not a zorg") == pytest.approx(2 * NEGATED)
    assert total("he wrote zorg") == pytest.approx(2 * REPORTED * AIMED)
    assert total("you zorg") == pytest.approx(2 * AIMED) and total("zorg that you are") == pytest.approx(2 * AIMED)
    assert total("not now. zorg") == pytest.approx(2) and total("nothing") == 0
    assert total("zorg. zorg") == pytest.approx(4)


def items(draw, n):
    return [" ".join(f"q{draw.randrange(3000)}" for _ in range(draw.randrange(6, 40))) for _ in range(n)]


def test_leaks_are_found_and_clean_documents_left(spark):
    draw = random.Random(8)
    benchmark = items(draw, 60)
    docs, planted = [], set()
    for i in range(200):
        text = prose(draw, draw.randrange(0, 150)).split() + [f"q{draw.randrange(3000)}" for _ in range(10)]
        if i % 4 == 0:
            j = draw.randrange(60)
            at = draw.randrange(len(text))
            text[at:at] = benchmark[j].upper().split()
            planted.add((i, j))
        if i % 7 == 1:  # half an item is no leak
            half = benchmark[i % 60].split()
            text += half[: len(half) // 2]
        docs.append((i, " ".join(text), "x"))
    docs += [(500, None, "x"), (501, "", "x"), (None, benchmark[3], "x"), (502, benchmark[5], "x"), (502, benchmark[5], "x")]
    planted |= {(None, 3), (502, 5)}
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*enumerate(benchmark), (900, None), (901, "")], "item_id long, text string")
    runs = [sorted(map(tuple, benchmark_leaks(frame, bench, shard=shard).collect()), key=str) for shard in (4096, 13)]
    assert {r[:2] for r in runs[0]} == planted and runs[0] == runs[1]  # with equal scores
    assert benchmark_leaks(frame, bench.limit(0)).count() == 0 and benchmark_leaks(frame.limit(0), bench).count() == 0


def test_pruned_retrieval_equals_exhaustive_scores():
    """Every item whose exact BM25 reaches the threshold is retrieved: with an overlap of 0, leaks() lists just those."""
    draw = random.Random(1)
    texts = [" ".join(draw.choice(WORDS) for _ in range(draw.randrange(4, 15))) for _ in range(40)]
    index = ItemIndex(list(range(40)), texts, 0.7, Statistics.of(texts))
    dense = np.zeros((len(index.terms), 40))
    dense[np.repeat(np.arange(len(index.terms)), np.diff(index.ptr)), index.item] = index.impact
    column = pa.array([prose(draw, draw.randrange(1, 60)) for _ in range(50)] + texts[:5])
    for _, _, off, data in chunks(column):
        starts, ends, firsts = spans(off, data)
        words = word_hashes(data, starts, ends)
        got = {(r, i) for r, i, *_ in index.leaks(words, firsts, 0.0)}
        want = set()
        for r in range(len(firsts) - 1):
            own = words[firsts[r] : firsts[r + 1]]
            for a in range(0, len(own), index.length):
                passage = np.unique(own[a : a + 2 * index.length])
                at = np.flatnonzero(np.isin(index.terms, passage))
                want |= {(r, int(i)) for i in np.flatnonzero(dense[at].sum(0) >= 1 - 1e-4)}
        assert got == want and len(got) >= 5


def test_items_are_cut_at_their_question():
    q, a = question_and_answer("what is it? a cat")
    assert len(q) == 3 and len(a) == 2
    q, a = question_and_answer("one two three four five")
    assert len(q) == 3 and len(a) == 2


def test_pairwise_loss_and_cut_against_brute_force():
    """The ranking minimises the loss over the pairs it draws, and its cut is the best of the quantiles it may take."""
    from loomframe.llm.quality import MEASURES, PairwiseQuality

    draw = np.random.default_rng(4)
    y = (np.arange(120) % 3 > 0).astype(float)
    x = draw.normal(size=(120, len(MEASURES))) + y[:, None] * np.linspace(0, 1, len(MEASURES))
    model = PairwiseQuality(x, y)
    z = (x - x.mean(0)) / x.std(0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    pairs = [(g, bad[k]) for g, k in zip(np.tile(good, 8), np.random.default_rng(8).integers(0, len(bad), 8 * len(good)), strict=True)]

    def loss(w):
        return sum(np.log1p(np.exp(-(z[g] - z[b]) @ w)) for g, b in pairs) + w @ w / 2

    least = loss(model.weights)
    for j in range(len(MEASURES)):
        for step in (-0.02, 0.02):
            other = model.weights.copy()
            other[j] += step
            assert loss(other) > least
    u = z @ model.weights
    score = lambda cut: np.mean(u[good] >= cut) + np.mean(u[bad] < cut)
    assert score(model.cut) >= max(score(np.quantile(u, q)) for q in (1 / 3) * np.linspace(0.5, 1.5, 41)) - 0.05
    accepted = model.score(x, 0.3) >= 0.3
    assert (accepted == (u >= model.cut - 1e-9)).all()
