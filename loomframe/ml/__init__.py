"""Models over frames, trained by Spark's own machine learning library."""

from .classify import ClassificationModel, create as create_classifier
from .models import cluster, regression, word2vec
from .recommend import RecommenderModel, create as create_recommender

__all__ = ["ClassificationModel", "RecommenderModel", "cluster", "create_classifier", "create_recommender", "regression", "word2vec"]
