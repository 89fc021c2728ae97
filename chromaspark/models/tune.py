"""Grid search, training runs and learning curves."""

from __future__ import annotations

import random
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession, functions as F

from chromaspark.functions.columns import col, hash32
from chromaspark.functions.reuse import keep
from chromaspark.models import catalog as cat, knn, linear, trees
from chromaspark.models.base import Model, TrainingTable, distinct_features, packed_score, predict_distinct, training_table
from chromaspark.operators.clean import Dataset, class_counts, known_target
from chromaspark.operators.evaluate import accuracy, class_report, rank_models, regression_metrics
from chromaspark.operators.split import exact_split, fold_count, hash_folds, stratified_folds
from chromaspark.schema import (
    DEFAULT_CLASSIFICATION, DEFAULT_REGRESSION, QUALITY, QUALITY_CODE, RETENTION, RUN_ID,
)

METRICS_SCHEMA = (
    "task string, model string, catalog_pos int, rmse double, r2 double, mae double, accuracy double, "
    "precision double, recall double, f1 double, support bigint, params string"
)
SCORES_SCHEMA = "task string, model string, grid_id int, fold int, score double, params string"


@dataclass
class Search:
    """Scores of one grid search and the point chosen."""

    grid: list[dict]
    scores: list[tuple[int, int, float]]
    best: int


def choose(scores: list[tuple[int, int, float]], lower_is_better: bool) -> int:
    """Grid point with the best mean over folds; ties go to the earlier point."""
    by_point: dict[int, list[float]] = {}
    for i, _, s in scores:
        by_point.setdefault(i, []).append(s)
    if not by_point:
        return 0
    sign = 1.0 if lower_is_better else -1.0
    return min(by_point, key=lambda i: (sign * sum(by_point[i]) / len(by_point[i]), i))


def mean_scores(scores: DataFrame, lower_is_better: bool = True) -> DataFrame:
    """Fold means per grid point and the winner flag, from a score table ``(grid_id, fold, score)``."""
    means = scores.groupBy("grid_id").agg(F.avg("score").alias("mean_score"))
    order = F.struct((F.col("mean_score") if lower_is_better else -F.col("mean_score")).alias("s"), "grid_id")
    best = means.agg(F.min(order).alias("b")).select(F.col("b.grid_id").alias("best_id"))
    # One row per grid point: a grid-sized table.
    return means.join(F.broadcast(best), F.col("grid_id") == F.col("best_id"), "left").select(
        "grid_id", "mean_score", F.col("best_id").isNotNull().alias("is_best")
    )


def _part(table: TrainingTable, condition) -> TrainingTable:
    return TrainingTable(
        table.rows.where(condition), table.packed.where(condition), table.features, table.task, table.n_labels, table.folds
    )


def grid_search(name: str, table: TrainingTable, grid: list[dict], parallelism: int = 3) -> Search:
    """Score every grid point on every fold.

    Linear models need one aggregation for the whole search, neighbour models one search per fold, tree models
    one growth for all points and folds; the others are fitted per (point, fold), a few at a time.
    """
    regression = table.task == "regression"
    if regression and name in cat.LINEAR:
        scores = linear.cv_scores(name, linear.fold_grams(table), grid)
    elif name == "KNN":
        scores = knn.cv_scores(table, grid, parallelism)
    elif name in trees.NAMES[table.task]:
        scores = trees.cv_scores(name, table, grid)
    else:
        def one(job: tuple[int, int]) -> tuple[int, int, float]:
            i, f = job
            model = cat.fit(name, _part(table, F.col("fold") != f), grid[i])
            return i, f, packed_score(model.predict(table.packed.where(F.col("fold") == f)), table.task)

        jobs = [(i, f) for i in range(len(grid)) for f in range(table.folds)]
        with ThreadPool(max(1, parallelism)) as pool:
            scores = pool.map(one, jobs)
    return Search(grid, scores, choose(scores, regression))


@dataclass
class TrainResult:
    """Fitted models with their test metrics."""

    task: str
    features: list[str]
    labels: list[str]
    models: dict[str, Model] = field(default_factory=dict)
    searches: dict[str, Search] = field(default_factory=dict)
    metrics: DataFrame | None = None
    test: DataFrame | None = None
    target: str = RETENTION
    skipped: str | None = None

    def ranked(self) -> DataFrame:
        return rank_models(self.metrics)

    def best_name(self) -> str | None:
        top = self.ranked().where(F.col("rank") == 1).select("model").first() if self.metrics is not None else None
        return top["model"] if top else None

    @property
    def best(self) -> Model | None:
        name = self.best_name()
        return self.models.get(name) if name else None

    def scores(self, spark: SparkSession) -> DataFrame:
        rows = [
            (self.task, m, i, f, float(s), str(search.grid[i]))
            for m, search in self.searches.items() for i, f, s in search.scores
        ]
        return spark.createDataFrame(rows, SCORES_SCHEMA)


def _train(
    result: TrainResult, train: DataFrame, models: list[str], grids: dict, folds: int, parallelism: int
) -> TrainResult:
    spark = train.sparkSession
    order = cat.catalog(result.task)
    table = training_table(train, result.features, result.target, result.task, len(result.labels), folds)
    test = keep(result.test)
    result.test = test
    vectors = keep(distinct_features(test, result.features))  # shared by the models

    def one(name: str) -> tuple[Model, Search, dict]:
        grid = grids.get((result.task, name)) or cat.DEFAULT_GRIDS[(result.task, name)]
        search = grid_search(name, table, cat.expand(grid), parallelism)
        model = cat.fit(name, table, search.grid[search.best])
        scored = predict_distinct(model, test, vectors)
        head = {"task": result.task, "model": name, "catalog_pos": order.index(name), "params": str(model.params)}
        if result.task == "regression":
            m = regression_metrics(scored, result.target).first()
            return model, search, {**head, "rmse": m["rmse"], "r2": m["r2"], "mae": m["mae"]}
        report = class_report(keep(scored.select(QUALITY_CODE, "prediction")), QUALITY_CODE, "prediction", result.labels)
        rows = {r["label"]: r for r in report.collect()}
        macro = rows["macro avg"]
        return model, search, {
            **head, "accuracy": rows["accuracy"]["f1"], "precision": macro["precision"],
            "recall": macro["recall"], "f1": macro["f1"], "support": macro["support"],
        }

    names = [m for m in order if m in models]
    if any(n in trees.NAMES[result.task] for n in names):
        trees.rows_of(table)  # shared by the tree models, so made before they start
    # most fits wait for short jobs, so several models are fitted at a time
    with ThreadPool(max(1, parallelism)) as pool:
        fitted = pool.map(one, names, chunksize=1)
    for name, (model, search, _) in zip(names, fitted):
        result.models[name], result.searches[name] = model, search
    lines = [line for _, _, line in fitted]
    fields = [p.split()[0] for p in METRICS_SCHEMA.split(", ")]
    result.metrics = spark.createDataFrame([tuple(x.get(c) for c in fields) for x in lines], METRICS_SCHEMA)
    return result


def split_regression(ds: Dataset, seed: int = 42) -> DataFrame:
    return exact_split(known_target(ds.df), None, RUN_ID, seed)


def split_classification(ds: Dataset, seed: int = 42) -> DataFrame:
    return exact_split(ds.df.where(col(QUALITY_CODE).isNotNull()), QUALITY_CODE, RUN_ID, seed)


def train_regression(
    ds: Dataset, models: list[str] | None = None, grids: dict | None = None, seed: int = 42, parallelism: int = 3
) -> TrainResult:
    """Tune and test regression models of the retention time. Unknown model names are skipped."""
    result = TrainResult("regression", ds.features, [], target=RETENTION)
    if RETENTION not in ds.df.columns or known_target(ds.df).isEmpty():
        result.skipped = f"no known {RETENTION}"
        return result
    split = split_regression(ds, seed)
    result.test = split.where("is_test")
    train = hash_folds(split.where("NOT is_test"))
    return _train(result, train, models or DEFAULT_REGRESSION, grids or {}, 3, parallelism)


def train_classification(
    ds: Dataset, models: list[str] | None = None, grids: dict | None = None, seed: int = 42, parallelism: int = 3
) -> TrainResult:
    """Tune and test separation-quality classifiers; needs two rows in every class."""
    result = TrainResult("classification", ds.features, ds.labels, target=QUALITY_CODE)
    if QUALITY not in ds.df.columns:
        result.skipped = f"no {QUALITY}"
        return result
    low = class_counts(ds.df).agg(F.min("n")).first()[0]
    if low is None or low < 2:
        result.skipped = "a class has fewer than two rows"
        return result
    split = split_classification(ds, seed)
    result.test = split.where("is_test")
    smallest = class_counts(split.where("NOT is_test")).agg(F.min("n")).first()[0]
    folds = fold_count(smallest)
    train = stratified_folds(split.where("NOT is_test"), QUALITY_CODE, folds)
    return _train(result, train, models or DEFAULT_CLASSIFICATION, grids or {}, folds, parallelism)


def results_table(*results: TrainResult) -> DataFrame:
    """Metrics of several tasks stacked, with the task as ``type``."""
    tables = [r.metrics.withColumn("type", F.initcap("task")) for r in results if r.metrics is not None]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def random_grid(grid: dict[str, list], n: int, seed: int = 42) -> list[dict]:
    """``n`` distinct random points of a grid, in grid order."""
    points = cat.expand(grid)
    chosen = sorted(random.Random(seed).sample(range(len(points)), min(n, len(points))))
    return [points[i] for i in chosen]


def learning_curve(
    name: str, df: DataFrame, features: list[str], y: str, task: str, params: dict | None = None,
    n_labels: int = 0, sizes: tuple[float, ...] = (0.1, 0.325, 0.55, 0.775, 1.0), folds: int = 3, seed: int = 44,
) -> DataFrame:
    """Mean train and validation score per training size.

    The training rows of a smaller size are a subset of those of a larger one: a row takes part once
    its hash falls under the size. Returns ``(size, fold, train_score, test_score)``.
    """
    spark = df.sparkSession
    base = df if "fold" in df.columns else hash_folds(df, folds)
    spread = keep(base.withColumn("_u", (hash32(RUN_ID, seed) % 10_000) / F.lit(10_000.0)))
    params = params or cat.expand(cat.DEFAULT_GRIDS[(task, name)])[0]
    lines = []
    whole = training_table(spread, features, y, task, n_labels, folds)
    for size in sizes:
        table = whole if size >= 1 else training_table(spread.where(F.col("_u") < size), features, y, task, n_labels, folds)
        fitted = trees.fold_fits(name, table, params) if name in trees.NAMES[task] else None
        for f in range(folds):
            part = _part(table, F.col("fold") != f)
            model = fitted[f] if fitted else cat.fit(name, part, params)
            train = packed_score(model.predict(part.packed), task)
            test = packed_score(model.predict(whole.packed.where(F.col("fold") == f)), task)
            lines.append((float(size), f, train, test))
    return spark.createDataFrame(lines, "size double, fold int, train_score double, test_score double")


def learning_curve_means(curve: DataFrame) -> DataFrame:
    return curve.groupBy("size").agg(
        F.avg("train_score").alias("train_score"), F.avg("test_score").alias("test_score")
    )
