"""Linear structure-retention regression: least squares of the retention time on all features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from chromaspark.functions.columns import clean_double, col
from chromaspark.models.linear import LinearModel, fit_linear, sse
from chromaspark.operators.moments import Gram, gram
from chromaspark.schema import RETENTION, RUN_ID


@dataclass
class QsrrFit:
    model: LinearModel
    n: int
    dropped: int
    r2: float | None
    rmse: float
    target: str

    def coefficients(self, spark) -> DataFrame:
        rows = list(zip(self.model.features, self.model.coef)) + [("(intercept)", self.model.intercept)]
        return spark.createDataFrame(rows, "feature string, coefficient double")

    def summary(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(self.n, self.dropped, self.r2, self.rmse)], "n bigint, dropped bigint, r2 double, rmse double"
        )

    def points(self, df: DataFrame, key: str = RUN_ID) -> DataFrame:
        """Actual and fitted value of every run with a known target."""
        known = df.where(clean_double(self.target).isNotNull())
        return self.model.predict(known).select(
            col(key), col(self.target).alias("actual"), F.col("prediction").alias("fitted")
        )


def qsrr(df: DataFrame, features: list[str], y: str = RETENTION) -> QsrrFit:
    """Minimum-norm least squares on the raw features, in-sample R2 and RMSE.

    Rows without a target are left out and counted.
    """
    g: Gram = gram(df, features, y)
    missing = df.where(clean_double(y).isNull()).count()
    model = fit_linear("LR", g, {}, scaled=False)
    error = sse(g, np.array(model.coef), model.intercept)
    r2 = 1.0 - error / g.yy if g.yy > 0 else None
    return QsrrFit(model, int(g.n), missing, r2, float(np.sqrt(error / g.n)), y)
