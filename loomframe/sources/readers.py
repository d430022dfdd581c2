"""Readers of text, CSV and saved frames."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.types import classify_all, infer, parse_literal, spark_type, text_cast
from ..plans.lineage import Lineage
from ..plans.session import session

SAMPLE = 100
SIDECAR = "_frame.json"


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path: local, HDFS and object stores alike."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    return bool(fs.exists(where))


def is_directory(spark: SparkSession, path: str) -> bool:
    fs, where = file_system(spark, path)
    if not fs.exists(where):
        raise ValueError(f"no such path: {path}")
    return bool(fs.getFileStatus(where).isDirectory())


def small_text(spark: SparkSession, path: str) -> str:
    """A small file's text; Spark's own readers pass over names that begin with an underscore."""
    fs, where = file_system(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def text_lines(spark: SparkSession, path: str, delimiter: str | None = None, nrows: int | None = None) -> DataFrame:
    """One column ``text``; with a delimiter, records end there, and line ends within them become spaces."""
    lines = spark.read.text(path, lineSep=delimiter) if delimiter else spark.read.text(path)
    lines = lines.toDF("text")
    if delimiter:
        lines = lines.select(F.trim(F.regexp_replace("text", r"[\r\n]+", " ")).alias("text"))
    return lines.limit(nrows) if nrows is not None else lines


def _cells(line: str, options: dict) -> list[str] | None:
    try:
        return next(csv.reader(io.StringIO(line), strict=True, **options), [])
    except csv.Error:
        return None


def read_csv(
    url, delimiter=",", header=True, error_bad_lines=False, comment_char="", escape_char="\\", double_quote=True, quote_char='"',
    skip_initial_space=True, column_type_hints=None, na_values=None, nrows=None, verbose=False, errors=False,
):
    """A frame, and where ``errors`` is set the bad lines by kind: header, width (wrong number of cells), csv (unreadable).

    Spark's reader splits the lines; types come from the first rows unless hints give them. Comments are cut off
    within lines as well. Cells equal to one of ``na_values`` are missing; an empty cell of a typed column is its zero.
    The first line of each file is its header.
    """
    from ..operators.frame import Frame
    from ..operators.series import Series

    spark = session()
    paths = [p.strip() for p in url.split(",")] if isinstance(url, str) else list(url)
    for p in paths:
        if "*" not in p and not exists(spark, p):
            raise ValueError(f"no such path: {p}")
    lines = spark.read.text(paths).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    if comment_char:
        lines = lines.withColumn("line", F.rtrim(F.regexp_replace("line", re.escape(comment_char) + ".*$", "")))
    lines = lines.where(F.trim("line") != "")
    options = {"delimiter": delimiter, "quotechar": quote_char, "escapechar": escape_char or None, "doublequote": double_quote, "skipinitialspace": skip_initial_space}
    first = lines.first()
    bad: dict[str, DataFrame] = {}
    if first is None:
        return Frame(), {}
    cells = _cells(first["line"], options)
    if header and (cells is None or "\0" in first["line"]):
        if not errors:
            raise ValueError("the header cannot be read")
        return Frame(), {"header": Series.rows(spark.createDataFrame([(first["line"],)], "value string"))}
    width = len(cells)
    names = cells if header else [f"X.{i}" for i in range(width)]
    if header:
        # a header is the first line of its file, in the file's first block
        marked = lines.withColumn("at", F.monotonically_increasing_id())
        heads = marked.where("block = 0").groupBy("file").agg(F.min_by("line", "at").alias("head"), F.min("at").alias("at"))
        heads = heads.where(F.col("head") == first["line"]).select("file", "at")
        lines = marked.join(F.broadcast(heads), ["file", "at"], "left_anti")
    split = F.udf(lambda t: None if "\0" in t else _cells(t, options), T.ArrayType(T.StringType()), useArrow=True)
    rows = lines.select("line", split("line").alias("cells"))
    good = rows.where(F.size("cells") == width)
    if errors:
        bad = {"csv": rows.where(F.col("cells").isNull()), "width": rows.where(F.size("cells") != width)}
    if nrows is not None:
        good = good.limit(nrows)
    na = ["NA"] if na_values is None else [na_values] if isinstance(na_values, str) else list(na_values)
    sample = [[None if v in na else v for v in r["cells"]] for r in good.take(SAMPLE)]
    kinds = _hinted(column_type_hints, names)
    out = []
    for i, name in enumerate(names):
        if name == "":
            continue
        column = [r[i] for r in sample]
        kind = kinds.get(name) or classify_all(column)
        cell = F.col("cells")[i]
        cell = F.when(~cell.isin(na), cell)
        element = spark_type(kind, [v for v in (parse_literal(t, kind) for t in column) if v is not None]) if kind in (list, dict) else None
        out.append((text_cast(cell, kind, element, empty_is_zero=True) if isinstance(kind, type) else cell.try_cast(kind)).alias(name))
    df = good.select(*out)
    frame = Frame.of(df, Lineage.of(url if isinstance(url, str) else ",".join(url), df.columns))
    if error_bad_lines and not errors and not rows.where(F.size("cells") != width).isEmpty():
        raise RuntimeError("lines with a wrong number of cells")
    return frame, {k: Series.rows(v.select("line")) for k, v in bad.items() if not v.isEmpty()}


def _hinted(hints, names: list[str]) -> dict:
    if hints is None:
        return {}
    if isinstance(hints, dict):
        return dict(hints)
    if isinstance(hints, (list, tuple)):
        if len(hints) != len(names):
            raise ValueError("one type for each column")
        return dict(zip(names, hints, strict=True))
    return {n: hints for n in names}


def load_frame(path: str):
    """A saved frame: Parquet files, and a sidecar with its lineage."""
    from ..operators.frame import Frame

    spark = session()
    if not exists(spark, path):
        raise ValueError(f"no such path: {path}")
    df = spark.read.parquet(path)
    side = f"{path.rstrip('/')}/{SIDECAR}"
    lineage = Lineage.from_json(small_text(spark, side)) if exists(spark, side) else Lineage.of(path, df.columns)
    return Frame.of(df, lineage)


def crossproduct(options: dict):
    """A frame with every combination of the values of each name."""
    from ..operators.frame import Frame

    spark = session()
    df = None
    for name in options:
        values = list(options[name])
        one = spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField(name, infer(values))]))
        df = one if df is None else df.crossJoin(one)
    return Frame.of(df, Lineage.of("PROGRAM", df.columns)) if df is not None else Frame()
