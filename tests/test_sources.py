import gzip
import math

import pytest

from loomframe import Frame, Series
from loomframe.sources.readers import crossproduct

pytestmark = pytest.mark.usefixtures("spark")


def put(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_csv_dialects(tmp_path):
    want = [(1, "a"), (2, "b"), (3, "c")]
    assert Frame(put(tmp_path, "t.csv", "id,val\n1,a\n2,b\n3,c\n")).head_as_list(9) == want
    assert Frame(put(tmp_path, "t.tsv", "id\tval\n1\ta\n2\tb\n3\tc\n")).head_as_list(9) == want
    assert Frame(put(tmp_path, "t.psv", "id|val\n1|a\n2|b\n3|c\n")).head_as_list(9) == want
    with gzip.open(tmp_path / "z.csv.gz", "wt") as f:
        f.write("id,val\n1,a\n")
    assert Frame(str(tmp_path / "z.csv.gz")).head_as_list(9) == [(1, "a")]
    bare = Frame.read_csv(put(tmp_path, "n.csv", "1,a\n2,b\n"), header=False)
    assert bare.column_names() == ["X.0", "X.1"] and bare.num_rows() == 2
    assert Frame.read_csv(put(tmp_path, "c.csv", "id,val # x\n1,a#1\n# all\n2,b\n"), comment_char="#").head_as_list(9) == [(1, "a"), (2, "b")]
    assert Frame.read_csv(put(tmp_path, "e.csv", "id,val\n1,a\\,a\n")).head_as_list(9) == [(1, "a,a")]
    assert Frame.read_csv(put(tmp_path, "d.csv", "id,val\n1,a$,a\n"), escape_char="$").head_as_list(9) == [(1, "a,a")]
    assert Frame.read_csv(put(tmp_path, "s.csv", " id, val\n 1, a\n")).head_as_list(9) == [(1, "a")]
    assert Frame.read_csv(put(tmp_path, "h.csv", "id,val\n1,a\nid,val\n"), column_type_hints=str).head_as_list(9) == [("1", "a"), ("id", "val")]
    with pytest.raises(ValueError):
        Frame(str(tmp_path / "none.csv"))


def test_csv_types_missing_and_errors(tmp_path):
    auto = Frame(put(tmp_path, "a.csv", "i,f,s,l,d\n1,1.5,a,\"['a']\",{1:'a'}\n-2,2,b,['b'],{}\n"))
    assert auto.column_types() == [int, float, str, list, dict] and auto.head_as_list(1) == [(1, 1.5, "a", ["a"], {1: "a"})]
    na = put(tmp_path, "na.csv", "id,val\n1,NA\nNone,b\n3,c\n")
    assert Frame.read_csv(na, na_values=["NA", "None"]).head_as_list(9) == [(1, None), (None, "b"), (3, "c")]
    assert Frame.read_csv(na).head_as_list(1) == [("1", None)]
    hinted = Frame.read_csv(put(tmp_path, "x.csv", "a,b\n1,2\n"), column_type_hints={"a": str})
    assert hinted.column_types() == [str, int]
    got, bad = Frame.read_csv_with_errors(put(tmp_path, "w.csv", "id,val\n1\n2,x,y\n2,b\n3,c\n"))
    assert got.head_as_list(9) == [(2, "b"), (3, "c")] and list(bad["width"]) == ["1", "2,x,y"]
    got, bad = Frame.read_csv_with_errors(put(tmp_path, "z.csv", "id,val\n1,a\n2,\0b\n3,c\n"))
    assert got.num_rows() == 2 and len(bad["csv"]) == 1
    assert Frame.read_csv(na, nrows=2).num_rows() == 2


def test_text_and_round_trips(tmp_path):
    assert Frame.read_text(put(tmp_path, "l.txt", "one\ntwo\n")).head_as_list(9) == [("one",), ("two",)]
    assert Frame.read_text(put(tmp_path, "r.txt", "one\nmore;two"), delimiter=";").head_as_list(9) == [("one more",), ("two",)]
    f = Frame({"id": [1, 2], "val": ["a", "b"], "l": [[1], [2, 3]]})
    f.save(str(tmp_path / "saved"))
    back = Frame(str(tmp_path / "saved"))
    assert sorted(back.head_as_list(9)) == sorted(f.head_as_list(9)) and back.lineage() == f.lineage()
    f.save(str(tmp_path / "f.parquet"))
    assert sorted(Frame(str(tmp_path / "f.parquet")).head_as_list(9)) == sorted(f.head_as_list(9))
    f.select_columns(["id", "val"]).save(str(tmp_path / "f.csv"))
    assert (tmp_path / "f.csv").read_text() == "id,val\n1,a\n2,b\n"
    with pytest.raises(ValueError):
        f.save(str(tmp_path / "q"), "odd")
    s = Series([3, 1])
    s.save(str(tmp_path / "s.txt"))
    assert list(Series(str(tmp_path / "s.txt"))) == [3, 1]
    assert len(crossproduct({"a": [1, 2], "b": ["x", "y", "z"]})) == 6


def test_folders_of_files_come_back(tmp_path):
    f = Frame({"id": list(range(40)), "val": [f"v{i}" for i in range(40)]})
    wide = Frame.of(f.df.repartition(4))
    wide.save(str(tmp_path / "many.csv"), one_file=False)
    assert len(list((tmp_path / "many.csv").glob("part-*"))) == 4
    assert sorted(Frame(str(tmp_path / "many.csv")).head_as_list(99)) == sorted(f.head_as_list(99))
    wide.save(str(tmp_path / "many.csv"), one_file=False)  # takes the place of what was there
    assert Frame(str(tmp_path / "many.csv")).num_rows() == 40
    for name in ("s.txt", "s.csv"):
        wide["id"].save(str(tmp_path / name), one_file=False)
        assert (tmp_path / name).is_dir() and sorted(Series(str(tmp_path / name))) == list(range(40))


def test_sweep_against_plain_counts():
    from pyspark.ml.functions import vector_to_array

    from loomframe import ml

    f = Frame({"x": [float(i % 7) for i in range(60)], "z": [float(i % 5) for i in range(60)]})
    label = Series([int((i * 7919) % 11 < i % 7) for i in range(60)])
    for kind in ("LogisticRegression", "DecisionTree", "SVM"):
        model = ml.create_classifier(f, label, kind)
        got = model.model.transform(f.df)
        if "probability" in got.columns:
            scores = [r[0] for r in got.select(vector_to_array("probability")[1]).collect()]
        else:
            scores = [1 / (1 + math.exp(-r[0])) for r in got.select(vector_to_array("rawPrediction")[1]).collect()]
        y = list(label)
        rows = model.sweep(f, label, steps=20).df.orderBy("threshold").collect()
        assert len(rows) == 21
        for i, r in enumerate(rows):
            tp, fp = (sum(s >= i / 20 and t == c for s, t in zip(scores, y, strict=True)) for c in (1, 0))
            assert (r["threshold"], r["tp"], r["fp"], r["fn"], r["tn"]) == (i / 20, tp, fp, sum(y) - tp, len(y) - sum(y) - fp)
            assert r["tpr"] == tp / sum(y) and r["precision"] == (tp / (tp + fp) if tp + fp else None)
    assert rows[0]["fpr"] == 1.0
    nothing = model.sweep(f, Series([0] * 60), steps=2).df.collect()
    assert all(r["tpr"] is None and r["tp"] == 0 for r in nothing)


def test_models(tmp_path):
    from loomframe import ml

    f = Frame({"x": [0.0, 1.0, 2.0, 3.0] * 5, "y": [1.0, 0.0, 1.0, 0.0] * 5})
    label = f["x"] > 1.5
    model = ml.create_classifier(f, label, "LogisticRegression", standardize=True)
    assert model.evaluate(f, label)["accuracy"] == 1.0 and model.auc(f, label) == 1.0
    model.save(str(tmp_path / "m"))
    assert sum(ml.ClassificationModel.load(str(tmp_path / "m")).predict(f)) == 10
    r = Frame({"u": [1, 1, 2, 2, 3], "i": [1, 2, 1, 3, 2], "r": [5.0, 1.0, 4.0, 2.0, 1.0]})
    rec = ml.create_recommender(r, "u", "i", "r", rank=2, iterations=2)
    top = {(a, b) for a, b, _ in rec.recommend_top_k(2).head_as_list(9)}
    assert top and not top & {(1, 1), (1, 2), (2, 1), (2, 3), (3, 2)}


def test_files(tmp_path):
    from loomframe.sources import files

    path = str(tmp_path / "a" / "b.txt")
    files.make_dir(str(tmp_path / "a"))
    files.write_bytes(path, "één".encode())
    assert files.exists(path) and files.is_file(path) and files.is_dir(str(tmp_path / "a")) and files.list_dir(str(tmp_path / "a"))[-1] == "b.txt"
    assert files.length(path) == 5 and files.open_file(path).read() == "één" and files.modified(path) > 0
    files.rename(path, path + "2")
    assert not files.exists(path) and files.delete(path + "2")


def test_session(tmp_path):
    from loomframe.plans import session as s

    ini = tmp_path / "c.ini"
    ini.write_text("[spark]\nexecutor.memory = 2g\nspark.sql.shuffle.partitions = 7\n")
    got = s.settings(str(ini), {"spark.app.name": "x"})
    assert got["spark.executor.memory"] == "2g" and got["spark.sql.shuffle.partitions"] == "7" and got["spark.app.name"] == "x"
    assert s.version() and s.config() and s.jobs() == {} and s.spark_context() is not None
