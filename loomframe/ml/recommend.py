"""Recommenders by alternating least squares."""

from __future__ import annotations

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import functions as F

from ..operators.frame import Frame
from ..plans.order import quoted
from ..plans.session import session


def create(data: Frame, user_col: str, item_col: str, rating_col: str, recommender_type: str = "ALS", rank: int = 50, iterations: int = 10, lambda_: float = 0.01, seed: int = 0, **kwargs) -> RecommenderModel:
    """Types: ALS, and ImplicitALS for counts instead of ratings. Users and items are integers."""
    if recommender_type not in ("ALS", "ImplicitALS"):
        raise ValueError("recommender_type: ALS or ImplicitALS")
    data._check([user_col, item_col, rating_col])
    als = ALS(
        userCol=user_col, itemCol=item_col, ratingCol=rating_col, rank=rank, maxIter=iterations, regParam=lambda_, seed=seed,
        implicitPrefs=recommender_type == "ImplicitALS", coldStartStrategy="nan", **kwargs,
    )
    return RecommenderModel(als.fit(data.df), data.select_columns([user_col, item_col, rating_col]), (user_col, item_col, rating_col))


class RecommenderModel:
    def __init__(self, model: ALSModel, ratings: Frame, columns: tuple[str, str, str]):
        self.model, self.ratings, self.columns = model, ratings, columns

    def predict(self, user: int, item: int) -> float:
        u, i, _ = self.columns
        one = session().createDataFrame([(user, item)], f"{quoted(u)} int, {quoted(i)} int")
        return self.model.transform(one).first()["prediction"]

    def predict_frame(self, data: Frame) -> Frame:
        """Predictions for rows of users and items."""
        return Frame.of(self.model.transform(data.df).withColumnRenamed("prediction", "rating"))

    predict_all = predict_frame

    def recommend_top_k(self, k: int = 10, users: Frame | None = None) -> Frame:
        """The k best items that a user has not rated: as many more are asked for as the busiest user has rated."""
        u, i, _ = self.columns
        wanted = (users or self.ratings).df.select(u).distinct()
        rated = self.ratings.df.join(wanted, u, "left_semi").select(u, i)
        most = rated.groupBy(u).count().agg(F.max("count")).first()[0] or 0
        got = self.model.recommendForUserSubset(wanted, k + most).select(u, F.explode("recommendations").alias("r"))
        got = got.select(u, F.col(f"r.{i}").alias(i), F.col("r.rating").alias("rating")).join(rated, [u, i], "left_anti")
        best = F.slice(F.sort_array(F.collect_list(F.struct(F.col("rating"), F.col(i))), asc=False), 1, k)
        return Frame.of(got.groupBy(u).agg(best.alias("b")).select(u, F.explode("b").alias("b")).select(u, f"b.{i}", "b.rating"))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        self.ratings.save(f"{path}/ratings", "binary")
        session().createDataFrame([self.columns], "user string, item string, rating string").write.mode("overwrite").json(f"{path}/columns")

    @classmethod
    def load(cls, path: str) -> RecommenderModel:
        columns = session().read.json(f"{path}/columns").select("user", "item", "rating").first()
        return cls(ALSModel.load(f"{path}/model"), Frame.load(f"{path}/ratings"), tuple(columns))
