"""Least squares, ridge and lasso from Gram matrices.

One aggregation per training table gives a Gram per fold; every grid point, every fold and every
validation score then comes from d x d arithmetic, with no further data pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from chromaspark.functions.columns import dot
from chromaspark.models.base import Model, TrainingTable
from chromaspark.operators.moments import Gram, grams

CUTOFF = 1e-10  # relative eigenvalue cut-off of the minimum-norm solution


@dataclass
class LinearModel(Model):
    coef: list[float] = field(default_factory=list)
    intercept: float = 0.0
    kind = "linear"

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", dot(self.features, self.coef, self.intercept))

    def state(self) -> dict:
        return {"coef": self.coef, "intercept": self.intercept}


def min_norm(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum-norm solution of the normal equations, also when features are collinear."""
    values, vectors = np.linalg.eigh(a)
    keep_ = values > CUTOFF * max(float(values.max(initial=0.0)), 0.0)
    inverse = np.where(keep_, 1.0 / np.where(keep_, values, 1.0), 0.0)
    return vectors @ (inverse * (vectors.T @ b))


def lasso_path(a: np.ndarray, b: np.ndarray, penalty: float, rounds: int = 1000, tol: float = 1e-10) -> np.ndarray:
    """Coordinate descent for 1/2 w'aw - b'w + penalty * |w|_1 with ``a``, ``b`` per row."""
    w = np.zeros(len(b))
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(b)):
            if a[j, j] > 0:
                rho = b[j] - a[j] @ w + a[j, j] * w[j]
                w[j] = np.sign(rho) * max(abs(rho) - penalty, 0.0) / a[j, j]
        if np.max(np.abs(w - before), initial=0.0) <= tol * max(1.0, np.max(np.abs(w), initial=0.0)):
            break
    return w


def solve(name: str, g: Gram, params: dict, scaled: bool = True) -> tuple[np.ndarray, float]:
    """Raw-scale coefficients and intercept of LR, Ridge or Lasso from a Gram."""
    std = np.sqrt(np.maximum(np.diag(g.xx), 0.0) / g.n) if scaled else np.ones(len(g.features))
    live = std > 1e-12 * np.maximum(1.0, np.abs(g.mean))
    safe = np.where(live, std, 1.0)
    xx = g.xx / np.outer(safe, safe) * np.outer(live, live)
    xy = g.xy / safe * live
    if name == "LR":
        w = min_norm(xx, xy)
    elif name == "Ridge":
        w = np.linalg.solve(xx + float(params.get("alpha", 1.0)) * np.eye(len(xy)), xy)
    else:
        w = lasso_path(xx / g.n, xy / g.n, float(params.get("alpha", 0.1)))
    raw = w / safe * live
    y_mean = g.y_mean if params.get("fit_intercept", True) else 0.0
    return raw, float(y_mean - raw @ g.mean)


def sse(g: Gram, coef: np.ndarray, intercept: float) -> float:
    """Squared error of a linear model over the rows behind a Gram."""
    shift = g.y_mean - coef @ g.mean - intercept
    return float(max(g.yy - 2 * coef @ g.xy + coef @ g.xx @ coef, 0.0) + g.n * shift * shift)


def fold_grams(table: TrainingTable) -> dict:
    return grams(table.rows, table.features, "y", by="fold")


def total(parts: list[Gram]) -> Gram:
    whole = parts[0]
    for g in parts[1:]:
        whole = whole.merge(g)
    return whole


def cv_scores(name: str, by_fold: dict, grid: list[dict]) -> list[tuple[int, int, float]]:
    """``(grid_id, fold, rmse)``: train = all Grams minus the fold's, score on the fold's."""
    whole = total(list(by_fold.values()))
    out = []
    for f, g in sorted(by_fold.items()):
        rest = whole.merge(g, -1.0)
        if rest.n <= 0:
            continue
        for i, params in enumerate(grid):
            coef, b = solve(name, rest, params)
            out.append((i, f, float(np.sqrt(sse(g, coef, b) / g.n))))
    return out


def fit_linear(name: str, g: Gram, params: dict, scaled: bool = True) -> LinearModel:
    coef, b = solve(name, g, params, scaled)
    return LinearModel(name, "regression", list(g.features), dict(params), 0, [float(c) for c in coef], b)
