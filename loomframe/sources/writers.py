"""Writers of frames and series."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..functions.types import spark_type
from ..plans.order import quoted
from .readers import SIDECAR, file_system


def _one_file(df, path: str, write) -> None:
    """Write one part in a folder beside the target, then give it the target's name; works in every Hadoop file system."""
    spark = df.sparkSession
    folder = f"{path}.{uuid.uuid4().hex}"
    write(df.coalesce(1).write, folder)
    fs, where = file_system(spark, path)
    _, parts = file_system(spark, folder)
    part = next(f.getPath() for f in fs.listStatus(parts) if f.getPath().getName().startswith("part-"))
    fs.delete(where, True)
    fs.rename(part, where)
    fs.delete(parts, True)


def _written(df, path: str, one_file: bool, write) -> None:
    """One file, which is one task's work, or a folder of files that all tasks write."""
    if one_file:
        _one_file(df, path, write)
    else:
        write(df.write.mode("overwrite"), path)


def save_frame(frame, path: str, format: str | None = None, one_file: bool = True) -> None:
    if format is None:
        format = "csv" if path.endswith((".csv", ".csv.gz")) else "parquet" if path.endswith(".parquet") else "binary"
    elif format in ("csv", "parquet") and not path.endswith(f".{format}"):
        path = f"{path}.{format}"
    if format == "csv":
        flat = frame.df.select(*(F.to_json(F.col(quoted(f.name))).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(quoted(f.name)) for f in frame.df.schema))
        _written(flat, path, one_file, lambda w, p: w.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(p, header=True))
    elif format == "parquet":
        save_parquet(frame, path)
    elif format == "binary":
        frame.df.write.mode("overwrite").parquet(path)
        spark = frame.df.sparkSession
        fs, where = file_system(spark, f"{path.rstrip('/')}/{SIDECAR}")
        out = fs.create(where, True)
        out.write(bytearray(frame._lineage.to_json().encode()))
        out.close()
    else:
        raise ValueError(f"unknown format {format!r}")


def save_parquet(frame, path: str, column_names=None, column_type_hints=None) -> None:
    df = frame.df
    if column_type_hints:
        hints = column_type_hints if isinstance(column_type_hints, dict) else dict(zip(df.columns, column_type_hints, strict=True))
        df = df.select(*(F.col(quoted(n)).cast(spark_type(hints[n])).alias(n) if n in hints else F.col(quoted(n)) for n in df.columns))
    names = column_names or [re.sub(r"[\s,;{}()]", "_", n) for n in df.columns]
    df.toDF(*names).write.mode("overwrite").parquet(path)


def save_series(series, path: str, format: str | None = None, one_file: bool = True) -> None:
    df = series.to_dataframe("value")
    format = format or ("text" if path.endswith(".txt") else "csv" if path.endswith(".csv") else "binary")
    if format == "text":
        _written(df.select(F.col("value").cast("string")), path, one_file, lambda w, p: w.text(p))
    elif format == "csv":
        _written(df, path, one_file, lambda w, p: w.csv(p))
    elif format == "binary":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown format {format!r}")
