import math
import os
from collections import Counter

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def plain(value):
    if hasattr(value, "tolist") and getattr(value, "ndim", 0):
        return [plain(v) for v in value.tolist()]
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return round(value, 5) if isinstance(value, float) else value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in found), key=lambda r: [str(v) for v in r])


def names():
    from loomframe.plans import catalogue

    return sorted(catalogue.ORACLE_SQL)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", names())
def test_equals_sql(spark, con, name):
    from loomframe.plans import catalogue

    got = catalogue.QUERIES[name](spark, SF)
    want = con.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


def test_every_query_of_the_entry_point_can_be_read(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 20


def test_tf_idf_gives_every_word_of_every_document(spark, tmp_path):
    from loomframe.plans import catalogue

    docs = [(1, "The cat  sat on the mat"), (2, " la la land\n"), (3, "the cat"), (4, ""), (5, None), (6, "Cat")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = {i: Counter((t or "").lower().split()) for i, t in docs}
    total = sum(counts.values(), Counter())
    want = {
        (i, w): round((0.5 + 0.5 * n / max(c.values())) * math.log((len(docs) + 1) / (total[w] + 1)), 5)
        for i, c in counts.items() for w, n in c.items()
    }
    got = catalogue.QUERIES["q83_tf_idf_all_words"](spark, str(tmp_path)).collect()
    assert len(got) == len(want)
    assert {(r["doc"], r["word"]): r["tf_idf"] for r in got} == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("frequent", [0, 3, 100_000])
def test_tf_idf_exchanges_only_rows_of_rare_words(spark, monkeypatch, capsys, frequent):
    from pyspark.sql import functions as F

    from loomframe.operators import text

    monkeypatch.setattr(text, "FREQUENT", frequent)
    rows = [(i, f"a b a w{i % 50} w{i}") for i in range(200)] + [(None, "a"), (7, "b b"), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "d long, t string").select("d", F.split("t", " ").alias("items"))
    counts = [(i, Counter((t or "").split(" ") if t is not None else [])) for i, t in rows]
    total = sum((c for _, c in counts), Counter())
    want = sorted(
        (str(i), w, round((0.5 + 0.5 * n / max(c.values())) * math.log((len(rows) + 1) / (total[w] + 1)), 8)) for i, c in counts for w, n in c.items()
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = text.tf_idf_rows(docs, "d", "items")
        got.explain()
        plan = capsys.readouterr().out
        assert (plan.count("BroadcastHashJoin"), plan.count("Exchange hashpartitioning")) == {0: (0, 2), 3: (2, 2), 100_000: (2, 2)}[frequent]
        found = got.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((str(r["doc"]), r["word"], round(r["tf_idf"], 8)) for r in found) == want
