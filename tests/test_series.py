import datetime
import math

import pytest

from loomframe import Frame, Series, columnwise

pytestmark = pytest.mark.usefixtures("spark")


def test_construct():
    assert Series([1, 2.5]).dtype() is float and list(Series([1, None])) == [1, None]
    with pytest.raises(TypeError):
        Series([1, "a"])
    assert list(Series(["1", "x"], dtype=int, ignore_cast_failure=True)) == [1, None]
    with pytest.raises(ValueError):
        Series(["x"], dtype=int)
    assert list(Series.from_const("a", 2)) == ["a", "a"] and list(Series.from_sequence(2, 5)) == [2, 3, 4]
    assert list(Series.from_sequence(3)) == [0, 1, 2] and len(Series.from_sequence(5, 1)) == 0
    with pytest.raises(ValueError):
        Series.from_const(1, 0)
    assert repr(Series([1, 2])) == "[1, 2]"


def test_operators():
    a = Series([1, 2, 3])
    assert list(a / 2) == [0, 1, 1] and list(a * 2 + 1) == [3, 5, 7] and list(7 - a) == [6, 5, 4] and list(a ** 2) == [1, 4, 9]
    assert list(-a) == [-1, -2, -3] and list(abs(-a)) == [1, 2, 3] and list(a / 2.0) == [0.5, 1.0, 1.5]
    assert list(a > 1) == [False, True, True] and list(a == 2) == [False, True, False]
    assert list(Series([1, None]) == None) == [False, True] and list(Series([1, None]) != None) == [True, False]  # noqa: E711
    assert list((a > 1) & (a < 3)) == [False, True, False] and list((a < 2) | (a > 2)) == [True, False, True]
    assert list(a + Series([10, 20, 30])) == [11, 22, 33]
    assert list(Series(["a", "b"]) + "x") == ["ax", "bx"] and list(Series([[1], [2]]) + Series([[3], [4]])) == [[1, 3], [2, 4]]
    assert list(Series([-3, 3]) / 2) == [-2, 1]


def test_rows():
    a = Series([3, 1, 2, 3])
    assert a[0] == 3 and a[-1] == 3 and list(a[1:3]) == [1, 2] and list(a[::2]) == [3, 2] and list(a.head(2)) == [3, 1] and list(a.tail(2)) == [2, 3]
    assert list(a[a > 1]) == [3, 2, 3] and list(a[Series([0, 1, 0, 1])]) == [1, 3]
    with pytest.raises(IndexError):
        a[Series([1])]
    assert list(a.topk_index(2)) == [True, False, False, True] and list(a.topk_index(1)) == [True, False, False, False]
    assert list(a.topk_index(2, reverse=True)) == [False, True, True, False]
    assert sorted(a.unique()) == [1, 2, 3] and list(a.sort()) == [1, 2, 3, 3] and list(a.sort(False)) == [3, 3, 2, 1]
    assert list(a.append(Series([9]))) == [3, 1, 2, 3, 9]
    with pytest.raises(RuntimeError):
        a.append(Series(["x"]))
    assert list(a.filter(lambda v: v > 2)) == [3, 3] and sorted(a.sample(1.0)) == [1, 2, 3, 3]


def test_reductions():
    a = Series([1, 2, 3])
    assert (a.sum(), a.mean(), a.max(), a.min(), a.std(), a.var(1)) == (6, 2.0, 3, 1, pytest.approx(math.sqrt(2 / 3)), 1.0)
    assert Series([], dtype=int).sum() is None and Series([], dtype=int).all() and not Series([], dtype=int).any()
    assert Series([0, 1, None]).nnz() == 1 and Series([1.0, float("nan")]).nnz() == 1 and not Series([1, None]).all()
    assert Series([[1, 2], [3, 4]]).sum() == [4, 6] and Series([{"a": 1, "b": 2}, {"a": 3}]).sum() == {"a": 4}
    with pytest.raises(ValueError):
        a.std(2)
    with pytest.raises(TypeError):
        Series(["a"]).max()


def test_values():
    assert list(Series([1, 2, 3]).apply(lambda v: v * 1.5)) == [1.5, 3.0, 4.5]
    assert list(Series([1, None]).apply(lambda v: v + 1)) == [2, None]
    assert list(Series([[1, 2], [3]]).flat_map()) == [1, 2, 3] and list(Series([1, 2]).flat_map(lambda v: [v] * v)) == [1, 2, 2]
    assert list(Series(["1", ""]).astype(int)) == [1, 0] and list(Series(["[1, 2]"]).astype(list)) == [[1, 2]]
    assert list(Series(['{"a": 1}']).astype(dict)) == [{"a": 1}] and list(Series([1, 2]).astype(str)) == ["1", "2"]
    assert list(Series(["Aug 23, 2015", "2015 8 24"]).astype(datetime.datetime)) == [datetime.datetime(2015, 8, 23), datetime.datetime(2015, 8, 24)]
    assert list(Series(["x"]).astype(int, undefined_on_failure=True)) == [None]
    with pytest.raises(Exception, match="astype"):
        list(Series(["x"]).astype(int))
    assert list(Series([1, 5, 9, None]).clip(2, 6)) == [2, 5, 6, None] and list(Series([[1, 9]]).clip_upper(4)) == [[1, 4]]
    assert list(Series([[1, 2, 3], [4]]).vector_slice(0, 2)) == [[1, 2], None] and list(Series([[1, 2], [4]]).vector_slice(1)) == [2, None]
    assert list(Series(["abc", None]).item_length()) == [3, None] and list(Series([{"a": 1}]).item_length()) == [1]
    w = Series([datetime.datetime(2015, 8, 21, 10, 5, 6)])
    assert list(w.datetime_to_str("%Y-%m-%dT%H:%M:%S")) == ["2015-08-21T10:05:06"]
    assert list(Series(["2015-08-21"]).str_to_datetime("%Y-%m-%d")) == [datetime.datetime(2015, 8, 21)]
    assert w.split_datetime("X", ["year", "day"]).head_as_list(1) == [(2015, 21)]
    assert list(Series([1, None, 3]).fillna(0)) == [1, 0, 3] and list(Series(["a", "", None]).dropna()) == ["a"]


def test_dicts():
    d = Series([{"a": 0, "b": 1, "c": 2}, {"x": 1}])
    assert list(d.dict_trim_by_keys(["a", "x"])) == [{"b": 1, "c": 2}, {}]
    assert list(d.dict_trim_by_keys(["a"], exclude=False)) == [{"a": 0}, {}]
    assert list(d.dict_trim_by_values(1)) == [{"b": 1, "c": 2}, {"x": 1}] and list(d.dict_trim_by_values(upper=0)) == [{"a": 0}, {}]
    assert list(d.dict_has_any_keys(["a", "q"])) == [True, False] and list(d.dict_has_all_keys(["a", "b"])) == [True, False]
    assert Series([{"a": 1}, {"b": 2}]).dict_keys().head_as_list(2) == [("a",), ("b",)]
    with pytest.raises(ValueError):
        d.dict_values()


def test_text_and_sketch():
    assert list(Series(["The cat the", ""])._count_words()) == [{"the": 2, "cat": 1}, {}]
    assert list(Series(["a b a b"])._count_ngrams(2)) == [{"a b": 2, "b a": 1}]
    assert list(Series(["abc"])._count_ngrams(2, "character")) == [{"ab": 1, "bc": 1}]
    got = list(Series(["this is a test", "another test"]).sketch_summary().tf_idf())
    assert got[0]["this"] == pytest.approx(0.4054651) and got[1]["test"] == pytest.approx(0.0)
    s = Series([1, 2, 3, 4, 5, None]).sketch_summary()
    assert (s.size(), s.num_undefined(), s.max(), s.min(), s.sum(), s.mean(), s.var()) == (5, 1, 5, 1, 15, 3.0, 2.0)
    assert s.quantile(0.5) == 3 and s.quantile(0.8) == 4 and s.num_unique() == 6 and s.std() == pytest.approx(1.41421, abs=1e-5)
    f = Series([1, 2, 3, 2]).sketch_summary()
    assert f.frequent_items() == {2: 2, 1: 1, 3: 1} and f.frequency_count(2) == 2 and f.frequency_count(9) == 0 and f.avg_length() == 1
    assert Series([[1, 2], [2]]).sketch_summary().element_summary().frequent_items() == {2: 2, 1: 1}
    with pytest.raises(ValueError):
        Series(["a"]).sketch_summary().max()
    assert Series([None], dtype=int).sketch_summary().size() == 0


def test_frequency_count_of_lists_and_dicts_beyond_the_frequent_items():
    lists = Series([[i % 700, 1] for i in range(1400)] + [[0, 1]]).sketch_summary()
    assert len(lists.frequent_items()) == 500
    assert [lists.frequency_count([i, 1]) for i in (0, 1, 698, 699, 700)] == [3, 2, 2, 2, 0]
    assert lists.frequency_count(["a"]) == 0 and lists.frequency_count([1]) == 0
    assert Series([[1.0, 2.5], [1.0]]).sketch_summary().frequency_count([1]) == 1
    dicts = Series([{"a": i, "b": 1} for i in range(600)] + [{"b": 1, "a": 599}]).sketch_summary()
    assert dicts.frequency_count({"b": 1, "a": 599}) == 2 and dicts.frequency_count({"a": 598, "b": 1}) == 1
    assert dicts.frequency_count({"a": 598}) == 0


def test_functions_keep_the_meaning_of_python(spark):
    values = [-7, -1, 5, None]
    for fn, dtype in [(lambda x: x % 3, int), (lambda x: x // 2, int), (lambda x: x**2, int), (lambda x: x + 0.5, float), (lambda x: x * 2, str), (lambda x: x > 0, bool)]:
        want = [None if v is None else str(fn(v)) if dtype is str else fn(v) for v in values]
        got = list(Series(values).apply(fn, dtype))
        assert got == want and [type(v) for v in got] == [type(v) for v in want]
    assert list(Series(["a", None]).apply(lambda x: x + "!", str)) == ["a!", None]
    assert list(Series([-7, -1, 5]).apply(lambda x: x % 3)) == [2, 2, 2]
    assert list(Series([1, None, 3]).apply(lambda x: 0 if x is None else x, int, skip_undefined=False)) == [1, 0, 3]
    assert list(Series([-7, 4, 6]).filter(lambda x: x % 3)) == [-7, 4]
    assert list(Series([2, 0]).flat_map(lambda x: [x] * x, int)) == [2, 2]
    doubled = Series([1, 2]).apply(columnwise(lambda c: c * 2), float)
    assert list(doubled) == [2.0, 4.0] and "Python" not in doubled.to_dataframe()._jdf.queryExecution().toString()
    assert Frame([("a", [-4, 5])]).filterby(lambda x: x % 3 == 2, "a").num_rows() == 2
