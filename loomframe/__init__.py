"""Analytics frames and training-data operators on Spark DataFrames."""

from .functions.aggregates import ARGMAX, ARGMIN, AVG, CONCAT, COUNT, MAX, MEAN, MIN, QUANTILE, SELECT_ONE, STDV, SUM, VARIANCE
from .operators.frame import Frame
from .operators.series import Series, columnwise
from .operators.sketch import Sketch
from .plans.session import session, version

__all__ = [
    "ARGMAX", "ARGMIN", "AVG", "CONCAT", "COUNT", "MAX", "MEAN", "MIN", "QUANTILE", "SELECT_ONE", "STDV", "SUM", "VARIANCE",
    "Frame", "Series", "Sketch", "columnwise", "session", "version",
]
