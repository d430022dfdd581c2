"""Regression, clustering and word vectors."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler, Word2Vec, Word2VecModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F, types as T

from ..operators.frame import Frame
from ..operators.series import Series
from ..operators.text import words

LABEL = "__label"


def regression(features: Frame, labels: Series, kind: str = "linear", **kwargs) -> PipelineModel:
    """linear, ridge or lasso: the penalty is none, on squares, or on absolute values."""
    mix = {"linear": {"regParam": 0.0}, "ridge": {"elasticNetParam": 0.0, "regParam": 0.1}, "lasso": {"elasticNetParam": 1.0, "regParam": 0.1}}
    if kind not in mix:
        raise ValueError(f"kind: of {', '.join(mix)}")
    df = features.add_column(labels, LABEL).df.withColumn(LABEL, F.col(LABEL).cast("double"))
    stages = [VectorAssembler(inputCols=features.column_names(), outputCol="__raw"), LinearRegression(featuresCol="__raw", labelCol=LABEL, **(mix[kind] | kwargs))]
    return Pipeline(stages=stages).fit(df)


def cluster(features: Frame, k: int = 2, seed: int = 0, **kwargs) -> PipelineModel:
    stages = [VectorAssembler(inputCols=features.column_names(), outputCol="__raw"), KMeans(featuresCol="__raw", k=k, seed=seed, **kwargs)]
    return Pipeline(stages=stages).fit(features.df)


def word2vec(series: Series, vector_size: int = 100, seed: int = 42, min_count: int = 5) -> Word2VecModel:
    """Vectors of the words of texts, or of the items of lists; ``findSynonyms`` of the result gives neighbours."""
    items = series.expr if isinstance(series.kind, T.ArrayType) else words(series.expr)
    df = series.df.select(items.alias("words"))
    return Word2Vec(vectorSize=vector_size, seed=seed, minCount=min_count, inputCol="words", outputCol="vector").fit(df)
