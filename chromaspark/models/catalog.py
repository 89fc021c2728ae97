"""The model catalogue: default grids, fitting by name, loading from disk."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import SparkSession

from chromaspark.models import knn, linear
from chromaspark.models.base import Model, TrainingTable, read_json
from chromaspark.models.kernel import FourierMap, SvrModel, svr_from_table
from chromaspark.models.linear import LinearModel
from chromaspark.models.mlp import MlpModel, fit_mlp, layers_of
from chromaspark.models.spark_ml import LogisticModel, SvcModel, fit_logistic, fit_svc
from chromaspark.models.trees import TreesModel, fit_trees, read_trees
from chromaspark.operators.moments import Scaler
from chromaspark.schema import CLASSIFICATION_CATALOG, REGRESSION_CATALOG

# The default search grid of every model.
DEFAULT_GRIDS = {
    ("regression", "LR"): {"fit_intercept": [True, False]},
    ("regression", "Ridge"): {"alpha": [1.0, 10.0]},
    ("regression", "Lasso"): {"alpha": [0.1, 1.0]},
    ("regression", "RF"): {"n_estimators": [50, 100], "max_depth": [None, 10]},
    ("regression", "GB"): {"n_estimators": [50, 100], "learning_rate": [0.1], "max_depth": [3, 5]},
    ("regression", "SVR"): {"C": [1, 10], "gamma": ["scale"]},
    ("regression", "MLP"): {"hidden_layer_sizes": [(50,)], "alpha": [1e-3]},
    ("regression", "KNN"): {"n_neighbors": [3, 5, 7]},
    ("regression", "DT"): {"max_depth": [None, 5, 10]},
    ("classification", "RFC"): {"n_estimators": [50, 100], "max_depth": [None, 10]},
    ("classification", "GBC"): {"n_estimators": [50, 100], "learning_rate": [0.1], "max_depth": [3]},
    ("classification", "SVC"): {"C": [1, 10], "gamma": ["scale"]},
    ("classification", "MLPC"): {"hidden_layer_sizes": [(50,)], "alpha": [1e-3]},
    ("classification", "KNN"): {"n_neighbors": [3, 5, 7]},
    ("classification", "DT"): {"max_depth": [None, 5, 10]},
    ("classification", "LR"): {"C": [1.0, 10.0]},
}
LINEAR = ("LR", "Ridge", "Lasso")


def catalog(task: str) -> list[str]:
    return REGRESSION_CATALOG if task == "regression" else CLASSIFICATION_CATALOG


def expand(grid: dict[str, list]) -> list[dict]:
    """All grid points; the first key varies slowest."""
    keys = list(grid)
    return [dict(zip(keys, values)) for values in product(*(grid[k] for k in keys))]


def fit(name: str, table: TrainingTable, params: dict) -> Model:
    """Fit one catalogue model on all rows of a training table."""
    if table.task == "regression" and name in LINEAR:
        return linear.fit_linear(name, linear.total(list(linear.fold_grams(table).values())), params)
    if name == "KNN":
        return knn.fit(table, params)
    if name == "SVR":
        return svr_from_table(table, params)
    if name in ("MLP", "MLPC"):
        return fit_mlp(table.packed, table.features, params, table.task, table.n_labels, name)
    if name == "SVC":
        return fit_svc(table, params)
    if name == "LR":
        return fit_logistic(table, params)
    return fit_trees(name, table, params)


def _scaler(head: dict) -> Scaler:
    return Scaler(head["features"], head["state"]["mean"], head["state"]["std"])


def _restore(spark: SparkSession, path: str, head: dict) -> Model:
    base = (head["name"], head["task"], head["features"], head["params"], head["n_labels"])
    s = head["state"]
    readers: dict[str, Callable[[], Model]] = {
        "linear": lambda: LinearModel(*base, s["coef"], s["intercept"]),
        "svr": lambda: SvrModel(*base, FourierMap.from_state(s["map"]), s["coef"], s["bias"]),
        "mlp": lambda: MlpModel(*base, _scaler(head), layers_of(s["hidden"]), s["weights"]),
        "trees": lambda: TreesModel(*base, *read_trees(spark, path, s), s["start"], s["importances"]),
        "logistic": lambda: LogisticModel(*base, _scaler(head), LogisticRegressionModel.load(f"{path}/fitted")),
        "svc": lambda: SvcModel(*base, FourierMap.from_state(s["map"]), s["coef"], s["bias"],
                                LogisticRegressionModel.load(f"{path}/platt")),
        "knn": lambda: knn.load(spark, path, head),
    }
    return readers[head["kind"]]()


def load_model(spark: SparkSession, path: str) -> Model:
    return _restore(spark, path, read_json(spark, f"{path}/manifest"))
