"""Registered queries of the table operators, and for each the SQL that gives the same rows."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.aggregates import ARGMAX, ARGMIN, CONCAT, COUNT, MAX, MEAN, MIN, QUANTILE, SELECT_ONE, STDV, SUM, VARIANCE
from ..operators.frame import Frame
from ..operators.plots import histogram_rows
from ..operators.series import Series, columnwise
from ..operators.text import tf_idf_rows, words
from .store import Scratch, stash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder as frames, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> Frame:
        return Frame.of(self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))


def query(sql: str | None = None):
    def register(build: Callable[[Tables], Frame | DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            got = build(Tables(spark, sf_dir))
            return got.df if isinstance(got, Frame) else got

        run.__name__ = name = build.__name__
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return build

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["q00_pricing_by_nation"](spark, sf_dir)


def rounded(frame: Frame, *names: str, digits: int = 4) -> Frame:
    return Frame.of(frame.df.select(*(F.round(F.col(f"`{n}`"), digits).alias(n) if n in names else F.col(f"`{n}`") for n in frame.df.columns)))


def reduced(t: Tables, **values) -> DataFrame:
    """Reductions are values; as a one-row frame they can be compared."""
    kinds = {bool: "boolean", int: "long", float: "double"}
    schema = ", ".join(f"{n} {kinds[type(v)]}" for n, v in values.items())
    return t.spark.createDataFrame([tuple(values.values())], schema)


@query("""SELECT n_name, l_returnflag, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
 round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY n_name, l_returnflag
 ORDER BY sum_base DESC, n_name, l_returnflag LIMIT 20""")
def q00_pricing_by_nation(t):
    line = t.lineitem
    line = line[line["l_shipdate"] <= datetime.datetime(1998, 9, 2)]
    line = line.join(t.orders, on={"l_orderkey": "o_orderkey"}).join(t.customer, on={"o_custkey": "c_custkey"})
    line = line.join(t.nation, on={"c_nationkey": "n_nationkey"})
    got = line.groupby(["n_name", "l_returnflag"], {"sum_qty": SUM("l_quantity"), "sum_base": SUM("l_extendedprice"), "avg_disc": MEAN("l_discount"), "n": COUNT()})
    got = rounded(rounded(got, "sum_qty", "sum_base", digits=2), "avg_disc", digits=6)
    return got.sort([("sum_base", False), ("n_name", True), ("l_returnflag", True)]).head(20)


@query("SELECT n_name FROM nation")
def q01_select_column(t):
    return Frame.from_series(t.nation["n_name"], "n_name")


@query("SELECT p_name, p_size FROM part")
def q02_select_columns(t):
    return t.part.select_columns(["p_name", "p_size"])


@query("SELECT n_regionkey AS region, n_name, n_nationkey FROM nation")
def q03_rename_reorder_swap(t):
    nation = t.nation.rename({"n_regionkey": "region"}).swap_columns("n_nationkey", "n_name")
    return nation.reorder_columns(["region", "n_name", "n_nationkey"])


@query("SELECT p_partkey, p_name, 7 AS seven FROM part")
def q04_remove_and_constant(t):
    part = t.part.remove_columns(["p_brand", "p_type", "p_size", "p_retailprice"])
    part["seven"] = 7
    return Frame.of(part.df.withColumn("seven", F.col("seven").cast("int")))


@query("SELECT * FROM orders WHERE o_totalprice > 200000")
def q05_logical_filter(t):
    orders = t.orders
    return orders[orders["o_totalprice"] > 200000.0]


@query("SELECT * FROM orders WHERE (o_totalprice > 100000 AND o_orderstatus = 'O') OR o_orderkey < 100")
def q06_compound_mask(t):
    o = t.orders
    return o[((o["o_totalprice"] > 100000.0) & (o["o_orderstatus"] == "O")) | (o["o_orderkey"] < 100)]


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def q07_filterby_value(t):
    return t.customer.filterby("BUILDING", "c_mktsegment")


@query("SELECT * FROM customer WHERE c_nationkey IN (1, 3, 5)")
def q08_filterby_list(t):
    return t.customer.filterby([1, 3, 5], "c_nationkey")


@query("SELECT * FROM customer WHERE c_nationkey NOT IN (1, 3, 5)")
def q09_filterby_exclude(t):
    return t.customer.filterby([1, 3, 5], "c_nationkey", exclude=True)


@query("SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def q10_semi_join(t):
    orders = t.orders
    return t.customer.filterby(orders[orders["o_totalprice"] > 300000.0]["o_custkey"], "c_custkey")


@query("SELECT * FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def q10_anti_join(t):
    orders = t.orders
    return t.customer.filterby(orders[orders["o_totalprice"] > 300000.0]["o_custkey"], "c_custkey", exclude=True)


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey")
def q11_join_inner(t):
    c = t.customer.select_columns(["c_custkey", "c_name"])
    return c.join(t.orders.select_columns(["o_custkey", "o_orderkey", "o_totalprice"]), on={"c_custkey": "o_custkey"})


@query("SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) ON c_custkey = o_custkey")
def q12_join_left(t):
    o = t.orders
    o = o[o["o_totalprice"] > 250000.0].select_columns(["o_custkey", "o_orderkey"])
    return t.customer.select_columns(["c_custkey", "c_name"]).join(o, on={"c_custkey": "o_custkey"}, how="left")


@query("SELECT n_nationkey, n_name, r_name FROM (SELECT * FROM nation WHERE n_nationkey > 20) RIGHT JOIN (SELECT r_regionkey * 8 AS k, r_name FROM region) ON n_nationkey = k WHERE n_nationkey IS NOT NULL UNION ALL SELECT r_regionkey * 8, NULL, r_name FROM region WHERE r_regionkey * 8 NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey > 20)")
def q13_join_right(t):
    n, r = t.nation, t.region
    n = n[n["n_nationkey"] > 20].select_columns(["n_nationkey", "n_name"])
    r["k"] = r["r_regionkey"] * 8
    r = Frame.of(r.df.withColumn("k", F.col("k").cast("int")))
    return n.join(r.select_columns(["k", "r_name"]), on={"n_nationkey": "k"}, how="right")


@query("SELECT coalesce(a.k, b.k) AS k, x, y FROM (SELECT c_nationkey AS k, count(*) AS x FROM customer WHERE c_nationkey < 15 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS y FROM supplier GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k")
def q14_join_full(t):
    c = t.customer
    a = c[c["c_nationkey"] < 15].groupby("c_nationkey", {"x": COUNT()}).rename({"c_nationkey": "k"})
    return a.join(t.supplier.groupby("s_nationkey", {"y": COUNT()}).rename({"s_nationkey": "k"}), on="k", how="full")


@query("SELECT a.r_regionkey, a.r_name, b.r_regionkey AS \"r_regionkey.1\", b.r_name AS \"r_name.1\" FROM region a, region b")
def q15_cartesian(t):
    return t.region.join(t.region, how="cartesian")


@query("SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, r.n FROM lineitem l JOIN (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2) r ON l.l_orderkey = r.l_orderkey AND l.l_linenumber = r.l_linenumber")
def q16_join_two_keys(t):
    line = t.lineitem
    n = line[line["l_quantity"] > 25.0].groupby(["l_orderkey", "l_linenumber"], {"n": COUNT()})
    return line.select_columns(["l_orderkey", "l_linenumber", "l_quantity"]).join(n)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def q17_count(t):
    return t.lineitem.groupby(["l_returnflag", "l_linestatus"], {"n": COUNT()})


@query("SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def q18_sum(t):
    return rounded(t.lineitem.groupby("l_suppkey", {"total": SUM("l_extendedprice")}), "total", digits=2)


@query("SELECT o_custkey, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1")
def q19_min_max(t):
    return t.orders.groupby("o_custkey", {"low": MIN("o_totalprice"), "high": MAX("o_totalprice")})


@query("SELECT l_partkey, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def q21_mean(t):
    return rounded(t.lineitem.groupby("l_partkey", {"mean": MEAN("l_quantity")}), "mean", digits=6)


@query("SELECT l_returnflag, round(var_pop(l_quantity), 4) AS v, round(stddev_pop(l_quantity), 4) AS s FROM lineitem GROUP BY 1")
def q22_variance_stdv(t):
    return rounded(t.lineitem.groupby("l_returnflag", {"v": VARIANCE("l_quantity"), "s": STDV("l_quantity")}), "v", "s")


@query("SELECT o_custkey, arg_max(o_orderkey, row(o_totalprice, -o_orderkey)) AS top, arg_min(o_orderkey, row(o_totalprice, o_orderkey)) AS bottom FROM orders GROUP BY 1")
def q24_argmax_argmin(t):
    return t.orders.sort("o_orderkey").groupby("o_custkey", {"top": ARGMAX("o_totalprice", "o_orderkey"), "bottom": ARGMIN("o_totalprice", "o_orderkey")})


@query("SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1")
def q26_concat_list(t):
    return t.orders.sort("o_orderkey").groupby("o_custkey", {"keys": CONCAT("o_orderkey")})


@query("SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS k, list(o_orderstatus ORDER BY o_orderkey) AS v FROM orders GROUP BY 1")
def q27_concat_dict(t):
    got = t.orders.groupby("o_custkey", {"m": CONCAT("o_orderkey", "o_orderstatus")}).df
    entries = F.array_sort(F.map_entries("m"))
    return got.select("o_custkey", F.transform(entries, lambda e: e["key"]).alias("k"), F.transform(entries, lambda e: e["value"]).alias("v"))


@query("SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS median FROM lineitem GROUP BY 1")
def q28_quantile(t):
    return t.lineitem.groupby("l_returnflag", {"median": QUANTILE("l_quantity", 0.5)})


@query("SELECT nullif(l_linenumber, 3) AS line, count(*) AS n, CAST(sum(nullif(l_linenumber, 2)) AS BIGINT) AS s, count(nullif(l_linenumber, 2)) AS k FROM lineitem GROUP BY 1")
def q29_group_with_missing(t):
    df = t.lineitem.df.select(F.expr("nullif(l_linenumber, 3)").alias("line"), F.expr("nullif(l_linenumber, 2)").alias("x"))
    got = Frame.of(df).groupby("line", {"n": COUNT(), "s": SUM("x"), "l": CONCAT("x")}).df
    return got.select("line", "n", "s", F.size("l").cast("long").alias("k"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def q30_distinct_keys(t):
    return t.lineitem.groupby(["l_returnflag", "l_linestatus"])


def _series_query(name: str, sql: str, build) -> None:
    def run(t):
        return Frame.from_series(build(t.lineitem), "v")

    run.__name__ = name
    query(f"SELECT {sql} AS v FROM lineitem")(run)


_series_query("q31_add", "l_quantity + l_tax", lambda x: x["l_quantity"] + x["l_tax"])
_series_query("q32_subtract", "l_quantity - 1.5", lambda x: x["l_quantity"] - 1.5)
_series_query("q33_multiply", "CAST(l_linenumber * CAST(3 AS BIGINT) AS BIGINT)", lambda x: x["l_linenumber"] * 3)
_series_query("q34_floor_divide", "CAST(floor((l_linenumber - 4) / 2.0) AS BIGINT)", lambda x: (x["l_linenumber"] - 4) / 2)
_series_query("q35_power", "CAST(pow(l_linenumber, 2) AS BIGINT)", lambda x: x["l_linenumber"] ** 2)
_series_query("q36_compare", "l_quantity >= 20", lambda x: x["l_quantity"] >= 20.0)
_series_query("q37_equal", "l_returnflag = 'A'", lambda x: x["l_returnflag"] == "A")
_series_query("q38_and_or", "(l_quantity > 10 AND l_tax < 0.05) OR l_linenumber = 1", lambda x: ((x["l_quantity"] > 10.0) & (x["l_tax"] < 0.05)) | (x["l_linenumber"] == 1))
_series_query("q39_negate", "-l_quantity", lambda x: -x["l_quantity"])
_series_query("q40_absolute", "abs(l_quantity - 25)", lambda x: abs(x["l_quantity"] - 25.0))
_series_query("q40_concat_text", "l_returnflag || l_linestatus", lambda x: x["l_returnflag"] + x["l_linestatus"])
_series_query("q47_clip", "least(greatest(l_quantity, 10), 40)", lambda x: x["l_quantity"].clip(10.0, 40.0))


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS total, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, round(var_samp(l_quantity), 6) AS var, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem")
def q41_reductions(t):
    line = t.lineitem
    q = line["l_quantity"]
    return reduced(t, total=line["l_linenumber"].sum(), mean=round(q.mean(), 6), std=round(q.std(), 6), var=round(q.var(1), 6), low=q.min(), high=q.max())


@query("SELECT CAST(count_if(l_linenumber - 3 <> 0) AS BIGINT) AS nnz, CAST(count_if(nullif(l_linenumber, 3) IS NULL) AS BIGINT) AS missing, bool_and(l_linenumber <> 0) AS every, bool_or(l_linenumber = 9) AS some FROM lineitem")
def q44_nnz_missing_all_any(t):
    line = t.lineitem
    n = line["l_linenumber"]
    gone = Series.over(line.df, F.expr("nullif(l_linenumber, 3)"), {"l_linenumber"})
    return reduced(t, nnz=(n - 3).nnz(), missing=gone.num_missing(), every=n.all(), some=(n == 9).any())


@query("SELECT CAST(p_size AS VARCHAR) AS s, CAST(p_retailprice AS BIGINT) AS i FROM (SELECT p_size, trunc(p_retailprice) AS p_retailprice FROM part)")
def q48_astype(t):
    part = t.part
    return Frame.of(part.df.select(part["p_size"].astype(str).expr.alias("s"), part["p_retailprice"].astype(int).expr.alias("i")))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS day FROM orders")
def q49_datetime_to_str(t):
    orders = t.orders
    orders["day"] = orders["o_orderdate"].datetime_to_str("%Y/%m/%d %H:%M")
    return orders.select_columns(["o_orderkey", "day"])


@query("SELECT o_orderkey, strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') AS day FROM orders")
def q49_str_to_datetime(t):
    orders = t.orders
    orders["day"] = orders["o_orderdate"].datetime_to_str("%Y-%m-%d").str_to_datetime("%Y-%m-%d")
    return orders.select_columns(["o_orderkey", "day"])


@query("SELECT doc_id, length(text) AS n FROM documents")
def q50_item_length(t):
    docs = t.documents
    docs["n"] = docs["text"].item_length()
    return docs.select_columns(["doc_id", "n"])


def _priced(t) -> Frame:
    return t.orders.groupby("o_custkey", {"m": CONCAT("o_orderstatus", "o_totalprice")})


_LAST = "SELECT o_custkey, o_orderstatus AS k, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1, 2"


@query(f"SELECT o_custkey, list(k ORDER BY k) FILTER (k <> 'F') AS keys FROM ({_LAST}) GROUP BY 1 HAVING count_if(k <> 'F') > 0")
def q51_dict_trim_by_keys(t):
    got = t.orders.sort("o_orderkey").groupby("o_custkey", {"m": CONCAT("o_orderstatus", "o_totalprice")})
    keys = F.array_sort(F.map_keys(got["m"].dict_trim_by_keys(["F"]).expr))
    return got.df.select("o_custkey", keys.alias("keys")).where("size(keys) > 0")


@query(f"SELECT o_custkey, list(k ORDER BY k) FILTER (v BETWEEN 50000 AND 150000) AS keys FROM ({_LAST}) GROUP BY 1 HAVING count_if(v BETWEEN 50000 AND 150000) > 0")
def q51_dict_trim_by_values(t):
    got = t.orders.sort("o_orderkey").groupby("o_custkey", {"m": CONCAT("o_orderstatus", "o_totalprice")})
    keys = F.array_sort(F.map_keys(got["m"].dict_trim_by_values(50000.0, 150000.0).expr))
    return got.df.select("o_custkey", keys.alias("keys")).where("size(keys) > 0")


@query("SELECT o_custkey, bool_or(o_orderstatus IN ('F', 'P')) AS some, bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus = 'P') AS every FROM orders GROUP BY 1")
def q52_dict_has_keys(t):
    got = _priced(t)
    return got.df.select("o_custkey", got["m"].dict_has_any_keys(["F", "P"]).expr.alias("some"), got["m"].dict_has_all_keys(["F", "P"]).expr.alias("every"))


@query("SELECT p_partkey, [CAST(p_size AS DOUBLE), p_retailprice] AS packed FROM part")
def q53_pack_list(t):
    return t.part.pack_columns(["p_size", "p_retailprice"], new_column_name="packed").select_columns(["p_partkey", "packed"])


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN ['c_name'] ELSE ['c_mktsegment', 'c_name'] END AS keys FROM customer")
def q54_pack_dict(t):
    df = t.customer.df.select("c_custkey", "c_name", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("c_mktsegment"))
    got = Frame.of(df).pack_columns(["c_name", "c_mktsegment"], dtype=dict, new_column_name="m")
    return got.df.select("c_custkey", F.array_sort(F.map_keys("m")).alias("keys"))


@query("SELECT vec_id, embedding[1] AS \"e.0\", embedding[3] AS \"e.2\" FROM embeddings")
def q55_unpack_list(t):
    return t.embeddings.select_columns(["vec_id", "embedding"]).unpack("embedding", "e", limit=[0, 2])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS \"props.k\" FROM events")
def q56_unpack_dict(t):
    df = t.events.df.select("event_id", F.from_json("props", "map<string,bigint>").alias("props"))
    return Frame.of(df).unpack("props", limit=["k"])


@query("SELECT vec_id, unnest(embedding) AS x FROM embeddings")
def q57_stack_list(t):
    return t.embeddings.select_columns(["vec_id", "embedding"]).stack("embedding", "x")


@query("SELECT event_id, 'k' AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS n FROM events")
def q58_stack_dict(t):
    df = t.events.df.select("event_id", F.from_json("props", "map<string,bigint>").alias("props"))
    return Frame.of(df).stack("props", ["key", "n"])


@query("SELECT n_regionkey, list(n_name ORDER BY n_name) AS names FROM nation GROUP BY 1")
def q59_unstack(t):
    got = t.nation.remove_column("n_nationkey").unstack("n_name", "names").df
    return got.select("n_regionkey", F.array_sort("names").alias("names"))


@query("SELECT o_orderkey, year(o_orderdate) AS \"o_orderdate.year\", month(o_orderdate) AS \"o_orderdate.month\", day(o_orderdate) AS \"o_orderdate.day\" FROM orders")
def q60_split_datetime(t):
    return t.orders.select_columns(["o_orderkey", "o_orderdate"]).split_datetime("o_orderdate", limit=["year", "month", "day"])


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def q61_topk(t):
    return t.orders.topk("o_totalprice", 10)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey DESC LIMIT 25")
def q62_sort_head(t):
    return t.orders.sort([("o_orderdate", True), ("o_orderkey", False)]).head(25).select_columns(["o_orderkey", "o_totalprice"])


@query("SELECT DISTINCT l_shipdate, l_linenumber FROM lineitem")
def q63_unique(t):
    return t.lineitem.select_columns(["l_shipdate", "l_linenumber"]).unique()


@query("SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_regionkey = 1")
def q64_append(t):
    nation = t.nation
    return nation.append(nation[nation["n_regionkey"] == 1])


@query("SELECT p_partkey, coalesce(nullif(p_size, 7), -1) AS size FROM part")
def q65_fillna(t):
    return Frame.of(t.part.df.select("p_partkey", F.expr("nullif(p_size, 7)").alias("size"))).fillna("size", -1)


@query("SELECT p_partkey, nullif(p_size, 7) AS size FROM part WHERE nullif(p_size, 7) IS NOT NULL")
def q66_dropna(t):
    return Frame.of(t.part.df.select("p_partkey", F.expr("nullif(p_size, 7)").alias("size"))).dropna()


@query("SELECT row_number() OVER (ORDER BY n_name) + 4 AS id, n_name FROM nation")
def q67_row_number(t):
    return t.nation.sort("n_name").select_columns(["n_name"]).add_row_number("id", start=5)


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i >= 10 AND i < 100 AND (i - 10) % 7 = 0")
def q68_slice(t):
    return t.orders.sort("o_orderkey").select_columns(["o_orderkey"])[10:100:7]


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ROLLUP (event_type)")
def q69_sql(t):
    return t.events.sql("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM frame GROUP BY ROLLUP (event_type)")


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def q70_frequent_items(t):
    return t.spark.createDataFrame(list(t.events["event_type"].sketch_summary().frequent_items().items()), "value string, n long")


_WORDS = "SELECT doc_id AS doc, unnest(string_split_regex(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s+')) AS word FROM documents"


_TF_IDF = f"""WITH w AS (SELECT doc, word, count(*) AS n FROM ({_WORDS}) WHERE word <> '' GROUP BY 1, 2),
 m AS (SELECT doc, max(n) AS most FROM w GROUP BY 1), c AS (SELECT word, sum(n) AS total FROM w GROUP BY 1)
 SELECT w.doc, w.word, round((0.5 + 0.5 * n / most) * ln(((SELECT count(*) FROM documents) + 1.0) / (total + 1)), 6) AS tf_idf
 FROM w JOIN m ON w.doc = m.doc JOIN c ON w.word = c.word"""


def _tf_idf_of_documents(t):
    rows = tf_idf_rows(t.documents.df.select("doc_id", words(F.col("text")).alias("items")), "doc_id", "items")
    # half away from zero like round(), which goes through a decimal for each row
    return rows.withColumn("tf_idf", F.signum("tf_idf") * F.floor(F.abs("tf_idf") * 1e6 + 0.5) / 1e6)


@query(_TF_IDF)
def q71_tf_idf(t):
    return _tf_idf_of_documents(t)


@query(f"SELECT doc, count(*) AS n, count(DISTINCT word) AS kinds FROM ({_WORDS}) WHERE word <> '' GROUP BY 1")
def q72_word_counts(t):
    docs = t.documents
    docs["m"] = docs["text"]._count_words()
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, n: a + n)
    return docs.df.select(F.col("doc_id").alias("doc"), total.alias("n"), F.size("m").cast("long").alias("kinds")).where("kinds > 0")


@query("WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) SELECT CAST(least(floor((l_quantity - lo) / ((hi - lo) / 10)), 9) AS BIGINT) AS bucket, count(*) AS n FROM lineitem, b GROUP BY 1")
def q73_histogram(t):
    return histogram_rows(t.lineitem.df, "l_quantity", 10, 0.0, 1.0).select("bucket", "n")


@query("SELECT count(*) AS size, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, count(DISTINCT o_totalprice) AS kinds FROM orders")
def q74_sketch(t):
    s = t.orders["o_totalprice"].sketch_summary()
    return reduced(t, size=s.size(), low=s.min(), high=s.max(), mean=round(s.mean(), 4), std=round(s.std(), 4), kinds=s.num_unique())


@query("SELECT vec_id, embedding[3:5] AS part, embedding[4] AS one, len(embedding) AS n FROM embeddings")
def q75_vector_slice(t):
    e = t.embeddings
    v = e["embedding"]
    return e.df.select("vec_id", v.vector_slice(2, 5).expr.alias("part"), v.vector_slice(3).expr.alias("one"), v.item_length().expr.alias("n"))


@query("SELECT o_orderkey, o_totalprice * 2 AS v FROM orders")
def q76_apply_function(t):
    orders = t.orders.select_columns(["o_orderkey", "o_totalprice"])
    orders["v"] = orders["o_totalprice"].apply(lambda x: x * 2.0, float)
    return orders.select_columns(["o_orderkey", "v"])


@query("SELECT n_nationkey, upper(n_name) || '!' AS n_name FROM nation")
def q77_transform_col(t):
    return t.nation.select_columns(["n_nationkey", "n_name"]).transform_col("n_name", lambda r: r["n_name"].upper() + "!", str)


@query("SELECT r_name AS name, unnest(range(r_regionkey)) AS i FROM region")
def q78_flat_map(t):
    return t.region.flat_map(["name", "i"], lambda r: [[r["r_name"], i] for i in range(r["r_regionkey"])], [str, int])


@query("SELECT a.n_nationkey, a.n_name, b.r AS r FROM (SELECT *, row_number() OVER (ORDER BY n_name) AS i FROM nation) a JOIN (SELECT n_regionkey AS r, row_number() OVER (ORDER BY n_nationkey DESC) AS i FROM nation) b ON a.i = b.i")
def q79_positional_column(t):
    left = t.nation.sort("n_name").select_columns(["n_nationkey", "n_name"])
    return left.add_column(t.nation.sort("n_nationkey", ascending=False)["n_regionkey"], "r")


@query("SELECT true AS near, CAST(0 AS BIGINT) AS strangers FROM region WHERE r_regionkey = 0")
def q80_sample(t):
    line = t.lineitem.add_row_number("row")
    got = Frame.of(stash(line.sample(0.1, seed=7).df, "sample"))
    n = line.num_rows()
    return reduced(t, near=abs(got.num_rows() - 0.1 * n) < 5 * (0.09 * n) ** 0.5, strangers=got.num_rows() - line.filterby(got["row"], "row").num_rows())


@query("SELECT o_custkey, true AS own FROM orders GROUP BY 1")
def q81_select_one(t):
    got = t.orders.groupby("o_custkey", {"one": SELECT_ONE("o_orderkey"), "all": CONCAT("o_orderkey")}).df
    return got.select("o_custkey", F.array_contains("all", F.col("one")).alias("own"))


@query("SELECT count(*) AS rows_of_both, count(DISTINCT o_orderkey) AS keys, CAST(0 AS BIGINT) AS shared, CAST(sum(o_orderkey) AS BIGINT) AS total, true AS near FROM orders")
def q82_random_split(t):
    a, b = t.orders.random_split(0.3, seed=5)
    both = a.append(b)
    return reduced(
        t, rows_of_both=both.num_rows(), keys=both.select_columns(["o_orderkey"]).unique().num_rows(),
        shared=a.filterby(b["o_orderkey"], "o_orderkey").num_rows(), total=both["o_orderkey"].sum(),
        near=abs(a.num_rows() - 0.3 * both.num_rows()) < 5 * (0.21 * both.num_rows()) ** 0.5,
    )


@query(_TF_IDF)
def q83_tf_idf_all_words(t):
    return _tf_idf_of_documents(t)


# --- readers and writers: what is written comes back --------------------------------------------------------------
def _folder(t: Tables) -> str:
    return Scratch(t.spark, "round-trip").folder


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def q84_csv_round_trip(t):
    path = f"{_folder(t)}/customer.csv"
    t.customer.select_columns(["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]).save(path)
    return Frame.read_csv(path, column_type_hints={"c_custkey": int, "c_acctbal": float})


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def q85_csv_inferred_types(t):
    path = f"{_folder(t)}/nation.csv"
    t.nation.select_columns(["n_nationkey", "n_name"]).save(path)
    return Frame(path)


@query("SELECT 'width' AS kind, n_name || ',1,2' AS line FROM nation UNION ALL SELECT 'good', n_name FROM nation")
def q86_csv_with_errors(t):
    path = f"{_folder(t)}/bad.csv"
    nation = t.nation
    lines = nation["n_name"].apply(columnwise(lambda c: F.concat(c, F.lit(",1"))), str).append(nation["n_name"].apply(columnwise(lambda c: F.concat(c, F.lit(",1,2"))), str))
    lines.save(path, format="text")  # the first line tells the width
    good, bad = Frame.read_csv_with_errors(path, header=False)
    wrong = bad["width"].to_dataframe("line").select(F.lit("width").alias("kind"), "line")
    return wrong.union(good.df.select(F.lit("good"), F.col("`X.0`")))


@query("SELECT r_name AS text FROM region")
def q87_text_read(t):
    path = f"{_folder(t)}/region.txt"
    t.region["r_name"].save(path)
    return Frame.read_text(path)


@query("SELECT * FROM supplier")
def q88_saved_frame(t):
    path = f"{_folder(t)}/supplier"
    t.supplier.save(path)
    return Frame.load(path)


@query("SELECT * FROM part WHERE p_size > 10")
def q89_parquet_round_trip(t):
    path = f"{_folder(t)}/part.parquet"
    part = Frame.read_parquet(f"{t.sf_dir}/part.parquet")
    part[part["p_size"] > 10].save_as_parquet(path)
    return Frame(path)


@query("SELECT CAST(p_size AS BIGINT) AS v FROM part")
def q90_series_round_trip(t):
    path = f"{_folder(t)}/sizes"
    t.part["p_size"].save(path)
    return Frame.from_series(Series(path).astype(int), "v")


@query("SELECT CAST(p_size AS BIGINT) AS v FROM part")
def q91_series_text_round_trip(t):
    path = f"{_folder(t)}/sizes.txt"
    t.part["p_size"].save(path, format="text")
    return Frame.from_series(Series(path, int), "v")


# --- positions ----------------------------------------------------------------------------------------------------
@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 15")
def q92_tail(t):
    return t.orders.sort("o_orderkey").select_columns(["o_orderkey"]).tail(15)


@query("SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS id, l_orderkey, l_linenumber FROM lineitem")
def q93_row_number_of_many(t):
    line = t.lineitem.sort(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return line.add_row_number("id").select_columns(["id", "l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def q94_topk_mask(t):
    orders = t.orders.sort("o_orderkey")
    return orders[orders["o_totalprice"].topk_index(20)].select_columns(["o_orderkey"])


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i = 1000 OR i = 5")
def q95_index(t):
    orders = t.orders.sort("o_orderkey").select_columns(["o_orderkey"])
    return t.spark.createDataFrame([(orders[1000]["o_orderkey"],), (orders[5]["o_orderkey"],)], "o_orderkey long")


# --- functions of values, with Python's meaning -------------------------------------------------------------------
@query("SELECT o_orderkey, (((o_custkey - 500) % 7) + 7) % 7 AS v FROM orders")
def q96_apply_modulo(t):
    orders = t.orders.select_columns(["o_orderkey", "o_custkey"])
    orders["v"] = (orders["o_custkey"] - 500).apply(lambda x: x % 7, int)
    return orders.select_columns(["o_orderkey", "v"])


@query("SELECT * FROM nation WHERE length(n_name) % 2 = 0")
def q97_filterby_function(t):
    return t.nation.filterby(lambda name: len(name) % 2 == 0, "n_name")


@query("SELECT * FROM nation WHERE n_nationkey > n_regionkey * 6")
def q98_filterby_row_function(t):
    return t.nation.filterby(lambda r: r["n_nationkey"] > r["n_regionkey"] * 6)


@query("SELECT l_quantity AS v FROM lineitem WHERE CAST(l_quantity AS BIGINT) % 3 = 1")
def q99_series_filter(t):
    return Frame.from_series(t.lineitem["l_quantity"].filter(lambda q: int(q) % 3 == 1), "v")


@query("SELECT unnest(string_split(r_name, 'A')) AS v FROM region")
def r01_series_flat_map(t):
    return Frame.from_series(t.region["r_name"].flat_map(lambda s: s.split("A"), str, skip_undefined=False), "v")


@query("SELECT n_nationkey * 10 + n_regionkey AS v FROM nation")
def r02_frame_apply(t):
    return Frame.from_series(t.nation.apply(lambda r: r["n_nationkey"] * 10 + r["n_regionkey"], int), "v")


@query("SELECT n_regionkey AS n_nationkey, n_nationkey AS n_regionkey, n_name FROM nation")
def r03_transform_cols(t):
    nation = t.nation.select_columns(["n_nationkey", "n_regionkey", "n_name"])
    got = nation.transform_cols(["n_nationkey", "n_regionkey"], lambda r: [r["n_regionkey"], r["n_nationkey"]], [int, int])
    return got.select_columns(["n_nationkey", "n_regionkey", "n_name"])


# --- the rest -----------------------------------------------------------------------------------------------------
@query("SELECT n_regionkey, list(n_name ORDER BY n_name) AS names FROM nation GROUP BY 1")
def r04_unstack_dict(t):
    got = t.nation.unstack(["n_name", "n_nationkey"], "m").df
    return got.select("n_regionkey", F.array_sort(F.map_keys("m")).alias("names"))


@query("SELECT n_nationkey, [length(n_name) - 1, 2] AS v FROM nation")
def r05_character_ngrams(t):
    nation = t.nation
    m = nation["n_name"]._count_ngrams(2, "character", ignore_space=False).expr
    total = F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, n: a + n)
    return nation.df.select("n_nationkey", F.array(total, F.lit(2).cast("long")).alias("v"))


@query("SELECT event_id, 'k' AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS v FROM events")
def r06_dict_keys_and_values(t):
    events = Frame.of(t.events.df.select("event_id", F.from_json("props", "map<string,bigint>").alias("props")))
    events["k"], events["v"] = events["props"].dict_keys()["X.0"], events["props"].dict_values()["X.0"]
    return events.select_columns(["event_id", "k", "v"])


@query("SELECT l_shipmode AS m FROM (SELECT l_returnflag AS l_shipmode FROM lineitem) GROUP BY 1")
def r07_series_unique(t):
    return Frame.from_series(t.lineitem["l_returnflag"].unique(), "m")


@query("SELECT n_name AS v FROM nation UNION ALL SELECT r_name FROM region")
def r08_series_append(t):
    return Frame.from_series(t.nation["n_name"].append(t.region["r_name"]), "v")


@query("SELECT quantile_disc(o_totalprice, 0.25) AS q, count_if(o_totalprice = 0) AS zero, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS f FROM orders")
def r09_sketch_quantile_frequency(t):
    price, status = t.orders["o_totalprice"].sketch_summary(), t.orders["o_orderstatus"].sketch_summary()
    price.set_quantile_accumulator_parms(epsilon=1e-7)
    return reduced(t, q=price.quantile(0.25), zero=price.frequency_count(0.0), f=status.frequency_count("F"))


@query("SELECT count(*) AS n, min(x) AS low, max(x) AS high, (SELECT avg(len(embedding)) FROM embeddings) AS width FROM (SELECT unnest(embedding) AS x FROM embeddings)")
def r10_element_summary(t):
    sketch = t.embeddings["embedding"].sketch_summary()
    inner = sketch.element_summary()
    return reduced(t, n=inner.size(), low=inner.min(), high=inner.max(), width=sketch.avg_length())


@query("SELECT p_partkey, p_size AS size FROM part WHERE p_size <> 7 UNION ALL SELECT -p_partkey, NULL FROM part WHERE p_size = 7")
def r11_dropna_split(t):
    good, bad = Frame.of(t.part.df.select("p_partkey", F.expr("nullif(p_size, 7)").alias("size"))).dropna_split()
    return good.df.union(bad.df.select(-F.col("p_partkey"), "size"))


@query("SELECT o_orderkey, o_custkey AS o_totalprice FROM orders")
def r12_replace_column(t):
    orders = t.orders.select_columns(["o_orderkey", "o_custkey", "o_totalprice"])
    return orders.replace_column("o_totalprice", orders["o_custkey"]).remove_column("o_custkey")


@query("SELECT CAST(7 AS BIGINT) AS v, n_name FROM nation")
def r13_constant_and_pandas(t):
    nation = Frame(t.nation.to_pandas_dataframe()[["n_name"]])
    return nation.add_column(Series.from_const(7, 25), "v").select_columns(["v", "n_name"])


@query("SELECT a, b FROM (VALUES (1), (2)) x(a), (VALUES ('u'), ('v'), ('w')) y(b)")
def r14_cross_product_of_options(t):
    from ..sources.readers import crossproduct

    return Frame.of(crossproduct({"a": [1, 2], "b": ["u", "v", "w"]}).df.select(F.col("a").cast("int").alias("a"), "b"))

