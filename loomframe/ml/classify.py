"""Classifiers of two classes, their predictions and measures."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, NaiveBayes
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window, functions as F

from ..operators.frame import Frame
from ..operators.series import Series
from ..plans.order import quoted

TYPES = {
    "LogisticRegression": LogisticRegression, "LogisticRegressionWithSGD": LogisticRegression, "LogisticRegressionWithLBFGS": LogisticRegression,
    "SVM": LinearSVC, "SVMWithSGD": LinearSVC, "NaiveBayes": NaiveBayes, "DecisionTree": DecisionTreeClassifier,
}
LABEL = "__label"


def create(features: Frame, labels: Series, classifier_type: str = "DecisionTree", standardize: bool = False, **kwargs) -> ClassificationModel:
    if classifier_type not in TYPES:
        raise ValueError(f"classifier_type: of {', '.join(TYPES)}")
    names = features.column_names()
    df = features.add_column(labels, LABEL).df.withColumn(LABEL, F.col(LABEL).cast("double"))
    if classifier_type == "NaiveBayes":
        df = df.select(*(F.greatest(F.col(quoted(n)), F.lit(0)).alias(n) for n in names), LABEL)
    stages = [VectorAssembler(inputCols=names, outputCol="__raw", handleInvalid="keep")]
    if standardize:
        stages.append(StandardScaler(inputCol="__raw", outputCol="__features", withMean=True))
    column = "__features" if standardize else "__raw"
    stages.append(TYPES[classifier_type](featuresCol=column, labelCol=LABEL, **kwargs))
    return ClassificationModel(Pipeline(stages=stages).fit(df), names)


class ClassificationModel:
    def __init__(self, model: PipelineModel, names: list[str]):
        self.model, self.names = model, names

    def _predicted(self, data: Frame):
        return self.model.transform(data.df)

    def predict(self, data: Frame) -> Series:
        return Series.rows(self._predicted(data).select("prediction"))

    def evaluate(self, data: Frame, labels: Series) -> dict:
        """Counts, accuracy, precision, recall, and the rates of true and false positives; nan where nothing divides."""
        rows = self._predicted(data.add_column(labels, LABEL)).select(F.col("prediction") == 1, F.col(LABEL).cast("double") == 1).toDF("p", "y")
        c = rows.agg(*(F.count_if((F.col("p") == p) & (F.col("y") == y)).alias(n) for n, p, y in (("tp", True, True), ("fp", True, False), ("fn", False, True), ("tn", False, False)))).first().asDict()
        share = lambda a, b: a / b if b else float("nan")
        total = sum(c.values())
        return c | {
            "accuracy": share(c["tp"] + c["tn"], total), "precision": share(c["tp"], c["tp"] + c["fp"]), "recall": share(c["tp"], c["tp"] + c["fn"]),
            "tpr": share(c["tp"], c["tp"] + c["fn"]), "fpr": share(c["fp"], c["fp"] + c["tn"]),
        }

    def auc(self, data: Frame, labels: Series) -> float:
        rows = self._predicted(data.add_column(labels, LABEL)).withColumn(LABEL, F.col(LABEL).cast("double"))
        return BinaryClassificationEvaluator(labelCol=LABEL).evaluate(rows)

    def sweep(self, data: Frame, labels: Series, steps: int = 100) -> Frame:
        """The points of the ROC and the precision/recall curve: counts and rates at the thresholds 0, 1/steps ... 1.

        A row is positive at a threshold that its score reaches. The score is the probability of class 1, or for models
        without one the logistic function of the margin. Rates are null where nothing divides. One grouped count over the
        rows; what follows has steps + 1 rows.
        """
        rows = self._predicted(data.add_column(labels, LABEL))
        if "probability" in rows.columns:
            score = vector_to_array("probability")[1]
        else:
            score = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
        rows = rows.select(score.alias("score"), (F.col(LABEL).cast("double") == 1).alias("y"))
        near = F.round(F.col("score") * steps)
        slot = F.when(F.col("score") >= near / steps, near).otherwise(near - 1).cast("long")
        counted = rows.groupBy(slot.alias("id")).agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))
        at = data.df.sparkSession.range(steps + 1).join(counted, "id", "left").fillna(0, ["pos", "neg"])
        reached, everything = Window.orderBy(F.desc("id")), Window.partitionBy()
        at = at.select(
            (F.col("id") / steps).alias("threshold"), *(F.sum(n).over(reached).alias(c) for n, c in (("pos", "tp"), ("neg", "fp"))),
            *(F.sum(n).over(everything).alias(f"all_{n}") for n in ("pos", "neg")),
        )
        share = lambda a, b: F.try_divide(F.col(a).cast("double"), b)
        return Frame.of(at.select(
            "threshold", "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"), (F.col("all_neg") - F.col("fp")).alias("tn"),
            share("tp", F.col("tp") + F.col("fp")).alias("precision"), share("tp", F.col("all_pos")).alias("tpr"), share("fp", F.col("all_neg")).alias("fpr"),
        ))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> ClassificationModel:
        model = PipelineModel.load(path)
        return cls(model, model.stages[0].getInputCols())
