import random
import re

import pytest
from pyspark.sql import functions as F

from loomframe.llm.ngram_join import jaccard_groups
from loomframe.llm.stash import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def plain_groups(docs):
    """All pairs, and union-find."""
    sets = [(i, shingles(t)) for i, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    low = {}
    for a in range(len(sets)):
        if sets[a][0] is not None:
            low[find(a)] = min(low.get(find(a), sets[a][0]), sets[a][0])
    return sorted((i, len(s), low.get(find(a))) for a, (i, s) in enumerate(sets) if i is not None)


def corpus(seed):
    """Texts with exact copies, a large group of near copies of varying distance, and boilerplate that many share."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    boilerplate, origin = text(30), text(80)
    docs = []
    for _ in range(60):
        docs.append(" ".join(text(draw.randrange(1, 12)) + boilerplate))
    for _ in range(70):
        words = list(origin)
        for _ in range(draw.randrange(0, 4)):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        docs.append(" ".join(words))
    for _ in range(30):
        docs.append(" ".join(text(draw.randrange(1, 60)) + (boilerplate if draw.random() < 0.5 else [])))
    docs += [d.upper() for d in docs[:20]] + docs[60:75] + ["", None, "  ", "one", "ONE", "a b c d", "a b c d e", "A B C D E"]
    draw.shuffle(docs)
    return list(enumerate(docs, 100))


@pytest.mark.parametrize("seed,hot", [(1, 4), (2, 64)])
def test_equals_all_pairs(spark, seed, hot):
    docs = corpus(seed)
    got = jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), hot=hot)
    assert sorted(map(tuple, got.collect())) == plain_groups(docs)


def grown(seed, groups=40):
    """Small groups: a text, and it with words appended, put in front or cut off, at a similarity from 0.75 to 0.85."""
    draw = random.Random(seed)
    new = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    docs = []
    for _ in range(groups):
        n = draw.randrange(60, 130)
        words = new(n + 4)
        docs.append(words)
        more = round(n / draw.uniform(0.75, 0.85)) - n
        docs.append(draw.choice([words + new(more), new(more) + words, words[: n + 4 - round(n * draw.uniform(0.15, 0.25))]]))
    words = new(94)
    docs += [words, words + new(30)]  # exactly 90 / 120
    docs = [" ".join(d) for d in docs]
    draw.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("hot", [2, 64])
def test_no_link_of_a_text_within_another_is_lost(spark, hot):
    docs = [(i + 1000 * seed, t) for seed in range(5) for i, t in grown(seed)]
    got = jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), hot=hot)
    want = plain_groups(docs)
    assert len({c for _, _, c in want}) < 0.6 * len(want)
    assert sorted(map(tuple, got.collect())) == want


def test_nulls_repeats_clashes_and_empty(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f"), (None, None)]
    frame = spark.createDataFrame([(i, t, "x", 7) for i, t in docs], "doc_id long, text string, component_id string, id int")
    got = jaccard_groups(frame)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (2, 2, 1), (None, 0, None)], key=str)
    assert jaccard_groups(frame.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(5, 5), (200, 201), (200, 201)]
    draw = random.Random(3)
    draw.shuffle(edges)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert connected_components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0
