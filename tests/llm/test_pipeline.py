import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture
def tables(spark, tmp_path):
    draw = random.Random(6)
    words = [f"{a}{b}" for a in ("lor", "ip", "dol", "sit", "am", "con", "vel") for b in ("um", "et", "or", "is", "an", "el", "us")]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    item = "which river " + prose(20) + "? " + prose(12)
    docs = [(i, prose(80), "s1" if i % 3 else "s2") for i in range(200)]
    bad = [(300 + i, " ".join(w + "$$$" for w in prose(60).split()), "s1") for i in range(40)]
    near = docs[10][1].split()
    near[40] = "changed"
    extra = [(400, docs[3][1].upper(), "s2"), (401, " ".join(near), "s1"), (402, prose(20) + " " + item + " " + prose(20), "s1"), (None, prose(50), "s1"), (5, docs[5][1], docs[5][2])]
    rows = [(i, t, "en", s, len(t)) for i, t, s in docs + bad + extra]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 200, 2)] + [(300 + i, 0, 0) for i in range(0, 40, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_keep_what_they_should(spark, tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "mixture"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    seen = [sorted(r[0] for r in docs.select("doc_id").where("doc_id is not null").collect())]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns == columns
        seen.append(sorted(r[0] for r in docs.select("doc_id").collect()))
    clean = [*range(200), 400, 401, 402]
    assert seen[1] == sorted([*clean, 5])
    assert seen[2] == sorted(set(clean) - {400})
    assert seen[3] == sorted(set(clean) - {400, 401})
    assert seen[4] == list(range(200))
    out = corpus_pipeline.run(spark, tables)
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(200))
    sums = out.withColumn("source", F.expr("case when doc_id % 3 = 0 then 's2' else 's1' end")).groupBy("source").agg(F.sum("taken"), F.first("target"))
    assert all(abs(r[1] - r[2]) <= 80 for r in sums.collect())


def test_stages_take_an_empty_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, tables).count() == 0


def test_decontaminate_shuffles_no_texts(spark, tables, capsys):
    from loomframe.llm.decontaminate import benchmark_leaks, without_leaks

    docs = spark.read.parquet(f"{tables}/documents.parquet").union(spark.createDataFrame([(None, None, "en", "s1", 0), (402, "", "en", "s1", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    docs = docs.withColumn("m", F.create_map("source", "n_chars"))
    benchmark = spark.read.parquet(f"{tables}/benchmark.parquet").union(docs.where("doc_id in (7, 8, 9)").select("doc_id", "text"))
    got = corpus_pipeline.decontaminate(spark, docs, tables)
    got.explain()
    assert "Exchange" not in capsys.readouterr().out
    keyed = docs.withColumn("k", F.struct("doc_id", "text"))
    for shard in (4096, 2):
        leaked = {(r["k"]["doc_id"], r["k"]["text"]) for r in benchmark_leaks(keyed, benchmark, key="k", shard=shard).collect()}
        kept = without_leaks(docs, benchmark, shard=shard).collect()
        want = [r for r in docs.collect() if (r["doc_id"], r["text"]) not in leaked]
        assert len(leaked) >= 4 and sorted(map(str, kept)) == sorted(map(str, want))
