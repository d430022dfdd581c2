import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from loomframe.llm import exact_dedup, mixing
from loomframe.llm.exact_dedup import content_sort_dedup
from loomframe.llm.mixing import pareto_mixture

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = ["One text", "one TEXT", "É", "é", "", None, "other", "one text", "x" * 40 + "a", "x" * 40 + "b", "X" * 40 + "a"] + ["hot copy"] * 60


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("parts", [1, 7])
def test_exact_groups(spark, keep, parts):
    rows = [(i, t, "z") for i, t in enumerate(TEXTS)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)  # the hot text fills several ranges
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = content_sort_dedup(spark.createDataFrame(rows, "doc_id long, text string, norm string").repartition(5), keep=keep).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[(t or "").translate(LOWER)].append(i)
    assert len(got) == len(rows)
    for r in got:
        norm = (TEXTS[r["doc_id"]] or "").translate(LOWER)
        stays = (min if keep == "smallest" else max)(groups[norm])
        assert (r["keep_id"], r["group_size"], r["kept"]) == (stays, len(groups[norm]), r["doc_id"] == stays)
        assert r["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()


def test_repeated_rows_null_keys_and_no_rows(spark):
    rows = [(5, "a"), (5, "A"), (None, "a"), (None, "b"), (None, "b")]
    got = content_sort_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = [(r["doc_id"], r["group_size"]) for r in got if r["kept"]]
    assert sorted(kept, key=str) == [(5, 3), (None, 2)]
    assert content_sort_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        content_sort_dedup(spark.createDataFrame(rows, "doc_id long, text string"), keep="first")


def documents(spark):
    import random

    draw = random.Random(4)
    rows = [(i, " ".join(["w"] * draw.choice([0, 1, 5, 30, 200])), draw.choice(["a", "b", "c", "d", None])) for i in range(300)]
    rows += [(1000 + i, "w " * 40, "hot") for i in range(150)] + [(2000, None, "empty"), (7, rows[7][1], rows[7][2])]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mixture_meets_its_targets(spark):
    got = pareto_mixture(documents(spark)).collect()
    assert len(got) == 452
    taken, target, size = Counter(), {}, {}
    sources = {(r["doc_id"], r["source"]) for r in documents(spark).collect()}
    source = dict(sources)
    for r in got:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        target[s], size[s] = r["target"], r["source_size"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    for s, t in target.items():
        assert t <= 3 * size[s] + 1e-9
        assert abs(taken[s] - t) <= 100
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, pareto_mixture(documents(spark).repartition(9)).collect()), key=str)


def test_mixture_equals_sql_and_affinity_moves_it(spark, tmp_path):
    docs = documents(spark).where("doc_id <> 7")
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted(con.sql(mixing.ORACLE).fetchall(), key=str)
    got = [tuple(r) for r in pareto_mixture(docs, affinity=mixing.DIGITS).collect()]
    assert [(*w[:3], round(w[3], 6), w[4]) for w in want] == [(*g[:3], round(g[3], 6), g[4]) for g in sorted(got, key=str)]
    # with affinity 0, nothing is taken; the others, held at three copies, still meet a target that they can meet
    rows = pareto_mixture(docs, affinity="case when doc_id % 2 = 0 then 3 else 0 end").collect()
    assert all(r["taken"] == 0 for r in rows if r["doc_id"] % 2) and any(r["taken"] for r in rows)
    assert pareto_mixture(docs.limit(0)).count() == 0


def test_sampling_follows_the_inclusion_odds(spark):
    # two sources, so that the second is sampled at about half; sizes 8 and 127 have 4 and 7 digits
    rows = [(i, " ".join(["w"] * (8 if i % 2 else 127)), "a" if i < 500 else "b") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    share = Counter()
    for seed in range(4):
        for r in pareto_mixture(docs, affinity=mixing.DIGITS, seed=seed).collect():
            if r["doc_id"] < 500:
                share[r["size"]] += (r["taken"] > 0) / 1000
    assert share[8] / share[127] == pytest.approx(4 / 7, abs=0.08)


@pytest.mark.parametrize("affinity", [None, mixing.DIGITS])
def test_null_and_repeated_keys_meet_targets_in_any_partitioning(spark, affinity):
    draw = __import__("random").Random(8)
    rows = [(None if i % 3 else i % 40, " ".join(["w"] * draw.randrange(1, 60)) + f" {i % 200}", "a" if i % 2 else "b", 1, "x") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, liking int, id string")
    runs = [sorted(map(tuple, pareto_mixture(docs.repartition(n), affinity=affinity).collect()), key=str) for n in (1, 4, 9)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 600
    taken, target = Counter(), {}
    for _, size, source_size, goal, got in runs[0]:
        assert 0 <= got <= 3 * size
        taken[source_size] += got
        target[source_size] = goal
    assert all(abs(taken[s] - target[s]) <= 61 for s in target)


def test_dedup_equals_sql(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert sorted(con.sql(exact_dedup.ORACLE).fetchall()) == sorted(map(tuple, content_sort_dedup(docs, keep="largest").collect()))
    assert re.match("WITH", mixing.ORACLE.strip())
