"""The corpus pipeline: stages from documents to a mixture, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomframe.llm.decontaminate import without_leaks
from loomframe.llm.exact_dedup import content_sort_dedup
from loomframe.llm.mixing import DIGITS, pareto_mixture
from loomframe.llm.ngram_join import jaccard_groups
from loomframe.llm.quality import accepted, fit_quality
from loomframe.llm.stash import documents, stash


#: Names a row: its doc_id, null last, and its text. Rows that agree in both are copies of each other.
KEY = "__row"


def _keyed(docs: DataFrame) -> DataFrame:
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return docs.withColumn(KEY, key)


def _one_of_each(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Of the rows with one key, the one whose columns come first (dicts, which have no order, aside)."""
    order = [f.name for f in rows.select(*columns).schema if "map<" not in f.dataType.simpleString()]
    first = F.min_by(F.struct(*columns), F.struct(*order)).alias("row")
    return rows.groupBy(KEY).agg(first).select(*(F.col("row")[c].alias(c) for c in columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking accepts, in one pass and without a shuffle.

    Defined cases: every row is judged by its whole text alone, so null keys, repeated rows and ties are kept or rejected
    like any other row; null and empty texts are measured as empty; without labels of both kinds all rows stay; an empty
    table stays empty; further columns, whatever their names, are carried along.
    """
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return accepted(docs, model)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of those with the same text after lower-casing A-Z: the one with the smallest doc_id.

    Defined cases: a null doc_id stays only where its group has no other; of equal doc_ids the text with the smaller
    digest stays, and of rows that repeat one; null texts are empty texts, and all of these are one group; texts are
    compared whole; an empty table stays empty; further columns are carried along.
    """
    keyed = _keyed(docs)
    kept = content_sort_dedup(keyed, key=KEY, keep="smallest").where("kept").select(KEY)
    return _one_of_each(keyed.join(kept.hint("merge"), KEY, "left_semi"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram similarity links: the one with the smallest doc_id, null last.

    Defined cases: texts without words link with nothing and stay; of rows that repeat one stays, and of equal doc_ids
    in a group the text with the smaller digest; texts are compared whole; an empty table stays empty; further columns
    are carried along.
    """
    keyed = _keyed(docs)
    kept = jaccard_groups(keyed, key=KEY).where(F.col(KEY) == F.col("component_id")).select(KEY).distinct()
    return _one_of_each(keyed.join(kept.hint("merge"), KEY, "left_semi"), docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, in one pass and without a shuffle.

    Defined cases: every row is judged by its whole text, so rows with a null doc_id, repeated rows and ties fare alike;
    null and empty texts hold nothing and stay; an empty benchmark removes nothing; an empty table stays empty; further
    columns are carried along.
    """
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mixture takes, one row for each row: see ``pareto_mixture`` for the cases."""
    return pareto_mixture(docs, affinity=DIGITS)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mixture", mixture),
]
#: The first stage is a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read back before the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
