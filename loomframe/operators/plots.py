"""The data of plots, computed by Spark; drawing needs matplotlib, which may be absent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.missing import undefined
from ..plans.order import quoted


def histogram_rows(df, column: str, bins: int = 50, lower_cutoff: float = 0.0, upper_cutoff: float = 0.99):
    """(bucket, low, n): equal widths between two quantiles; values beyond them are counted at the ends."""
    c = F.col(quoted(column)).cast("double")
    good = df.where(~undefined(c, df.select(c.alias("c")).schema[0].dataType)).select(c.alias("v"))
    low, high = good.agg(F.percentile_approx("v", [lower_cutoff, upper_cutoff], 10_000)).first()[0] or (0.0, 0.0)
    width = (high - low) / bins or 1.0
    slot = F.least(F.greatest(F.floor((F.col("v") - low) / width), F.lit(0)), F.lit(bins - 1)).cast("long")
    return good.groupBy(slot.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).withColumn("low", low + F.col("bucket") * width)


class Plot:
    def __init__(self, frame, axes=None):
        self.frame, self.axes = frame, axes

    def _bars(self, labels: list, values: list, xlabel: str | None, ylabel: str | None, title: str | None):
        try:
            import matplotlib.pyplot as plt
        except ImportError:
            return None
        axes = self.axes or plt.subplots()[1]
        axes.barh(list(map(str, labels)), values)
        axes.set(xlabel=xlabel or "", ylabel=ylabel or "", title=title or "")
        return axes

    def histogram(self, column: str, title=None, bins: int | None = None, sketch=None, xlabel=None, ylabel=None, lower_cutoff=0.0, upper_cutoff=0.99) -> list:
        rows = histogram_rows(self.frame.df, column, bins or 50, lower_cutoff, upper_cutoff).orderBy("bucket").collect()
        self._bars([r["low"] for r in rows], [r["n"] for r in rows], xlabel, ylabel, title)
        return [(r["low"], r["n"]) for r in rows]

    def top_values(self, x_col: str, y_col: str, k: int = 15, title=None, xlabel=None, ylabel=None) -> list:
        rows = self.frame.topk(x_col, k).select_columns([x_col, y_col]).head_as_list(k)
        self._bars([y for _, y in rows], [x for x, _ in rows], xlabel, ylabel, title)
        return [(y, x) for x, y in rows]

    def frequent_values(self, column: str, k: int = 15, title=None, xlabel=None, ylabel=None) -> list:
        items = list(self.frame[column].sketch_summary().frequent_items().items())[:k]
        self._bars([v for v, _ in items], [n for _, n in items], xlabel, ylabel, title)
        return items

    def col_info(self, column: str, table_name=None, title=None, topk=None, bins=None, cutoff=False) -> str:
        sketch = self.frame[column].sketch_summary()
        return f"{table_name or 'frame'}.{column}\n{sketch!r}"
