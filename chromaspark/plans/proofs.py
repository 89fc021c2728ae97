"""Further registered queries: results that SQL can follow although the fit behind them is iterative.

A fitted model obeys equations that link its predictions with plain moments of the data (normal
equations, leaf means, class shares, the sum of squares a merge tree removes). These queries return the
side that comes from the model; their SQL twins compute the other side from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from chromaspark.analysis import pca as pca_mod, ward
from chromaspark.analysis.qsrr import qsrr
from chromaspark.functions.columns import col
from chromaspark.functions.reuse import keep
from chromaspark.models import catalog as cat, knn as knn_model, tune
from chromaspark.operators import clean, conditions as cond, evaluate as ev
from chromaspark.plans import registry as reg
from chromaspark.plans.given import dataset, raw_runs, read_table
from chromaspark.plans.registry import once, scratch, tidy
from chromaspark.schema import QUALITY_CODE, RETENTION, RUN_ID, quoted
from chromaspark.sources import report as rep, session as ses, tables

K_VALUES = (3, 5, 7)
_FOUND: dict[str, reg.Query] = {}


def query(fn):
    _FOUND[fn.__name__] = fn
    return fn


# --- reading and writing --------------------------------------------------------------------------


@query
def read_dispatch(spark, sf):
    """Rows and known targets of one run table read back from each format, the format told by the suffix."""
    folder, runs, parts = scratch(spark, "formats"), raw_runs(spark, sf), []
    tables.write_runs(runs, f"{folder}/runs.CSV")
    tables.write_runs(runs, f"{folder}/runs.Parquet", "parquet")
    runs.write.json(f"{folder}/runs.json")
    for suffix in ("CSV", "Parquet", "json"):
        back = tables.read_runs(spark, f"{folder}/runs.{suffix}")
        parts.append(back.agg(F.count(F.lit(1)).alias("n_rows"), F.count(RETENTION).alias("n_known")).withColumn("suffix", F.lit(suffix)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def two_tables(spark, sf):
    """A chromatogram table that travels beside the runs as it is."""
    folder = scratch(spark, "pair")
    tables.write_runs(raw_runs(spark, sf), f"{folder}/runs.csv")
    read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").write.option("header", True).csv(f"{folder}/trace.csv")
    return tables.read_dataset(spark, f"{folder}/runs.csv", f"{folder}/trace.csv").chromatogram


@query
def task_guards(spark, sf):
    df = dataset(spark, sf).df
    rows = [("retention", clean.has_target(df, RETENTION)), ("absent", clean.has_target(df, "no such column")), ("classes", clean.can_classify(df))]
    return spark.createDataFrame(rows, "guard string, passed boolean")


# --- neighbour models of several sizes as a model set ---------------------------------------------


@once
def _knn_metrics(spark, sf):
    rows = []
    reg_test, clf_test = (keep(f(spark, sf).where("is_test")) for f in (reg._reg_split, reg._clf_split))
    for i, k in enumerate(K_VALUES):
        said = cat.fit("KNN", reg._reg_table(spark, sf), {"n_neighbors": k}).predict(reg_test)
        m = ev.regression_metrics(said, RETENTION).first()
        rows.append(("regression", f"KNN{k}", i, m["rmse"], m["r2"], m["mae"], None))
        said = cat.fit("KNN", reg._clf_table(spark, sf), {"n_neighbors": k}).predict(clf_test)
        rows.append(("classification", f"KNN{k}", i, None, None, None, ev.accuracy(said, QUALITY_CODE).first()["accuracy"]))
    return spark.createDataFrame(
        rows, "task string, model string, catalog_pos int, rmse double, r2 double, mae double, accuracy double"
    )


@query
def knn_rank(spark, sf):
    return tidy(ev.rank_models(_knn_metrics(spark, sf)).select("task", "model", "rank"))


@query
def knn_bars(spark, sf):
    return tidy(ev.metric_bars(_knn_metrics(spark, sf)))


@query
def model_metrics(spark, sf):
    """Metrics of the best model of each task."""
    metrics = _knn_metrics(spark, sf)
    best = ev.rank_models(metrics).where("rank = 1").select("task", "model").collect()  # one row per task
    parts = [ev.model_metrics(metrics, r["task"], r["model"]) for r in best]
    return tidy(parts[0].unionByName(parts[1]).drop("catalog_pos"))


@query
def random_grid_scores(spark, sf):
    points = tune.random_grid({"n_neighbors": list(K_VALUES)}, 2)
    rows = [(points[i]["n_neighbors"], f, s) for i, f, s in knn_model.cv_scores(reg._reg_table(spark, sf), points)]
    return tidy(spark.createDataFrame(rows, "n_neighbors int, fold int, score double"))


@once
def _knn_results(spark, sf):
    """One neighbour model of each task as training results."""
    ds = dataset(spark, sf)
    r = tune.TrainResult("regression", ds.features, [], {"KNN": reg._reg_knn(spark, sf)}, target=RETENTION)
    r.test = reg._reg_split(spark, sf).where("is_test")
    m = ev.regression_metrics(reg._reg_scored(spark, sf), RETENTION).first()
    c = tune.TrainResult("classification", ds.features, ds.labels, {"KNN": reg._clf_knn(spark, sf)}, target=QUALITY_CODE)
    c.test = reg._clf_split(spark, sf).where("is_test")
    lines = {x["label"]: x for x in ev.class_report(reg._clf_scored(spark, sf), QUALITY_CODE, "prediction", ds.labels).collect()}
    macro = lines["macro avg"]
    for result, values in (
        (r, (m["rmse"], m["r2"], m["mae"], None, None, None, None, None)),
        (c, (None, None, None, lines["accuracy"]["f1"], macro["precision"], macro["recall"], macro["f1"], macro["support"])),
    ):
        params = str(result.models["KNN"].params)
        result.metrics = spark.createDataFrame([(result.task, "KNN", 0, *values, params)], tune.METRICS_SCHEMA)
    return [r, c]


@query
def session_knn(spark, sf):
    """Predictions of the best regression model of a session that was saved and loaded."""
    ds, folder = dataset(spark, sf), scratch(spark, "session")
    heat = cond.condition_heatmap(ds.df, reg._conditions_scored(spark, sf), ds.solvents)
    ses.save_session(spark, ses.Session(ds, _knn_results(spark, sf), heat), folder)
    back = ses.load_session(spark, folder).results[0]
    return tidy(back.best.predict(back.test).select(RUN_ID, "prediction"))


@query
def result_files(spark, sf):
    """Metrics tables written as CSV files, read back."""
    parts = []
    for path in rep.write_results(_knn_results(spark, sf), scratch(spark, "results")):
        back = spark.read.option("header", True).csv(path).drop("params")
        parts.append(back.select("model", *[F.col(c).cast("double").alias(c) for c in back.columns if c != "model"]))
    return tidy(parts[0].unionByName(parts[1], allowMissingColumns=True))


@query
def report_metrics(spark, sf):
    """The report's lines of metrics, rounded for display."""
    lines = rep.report_lines(spark, dataset(spark, sf), _knn_results(spark, sf))
    return lines.where("text LIKE 'KNN |%'").select("section", "text")


@query
def no_condition(spark, sf):
    """The best condition where no observed one reaches a listed quality: no row."""
    ranked = cond.with_priority(reg._conditions_scored(spark, sf), dataset(spark, sf).labels, priority=["none of them"])
    return cond.best_condition(ranked).select("org", "buf", "label")


# --- linear models: moments of predictions --------------------------------------------------------


def _moments(scored: DataFrame, features: list[str], plus: list[float]) -> DataFrame:
    """Mean of feature times prediction, with what the penalty holds back (``plus``), per feature."""
    means = [F.avg(F.coalesce(col(f).cast("double"), F.lit(0.0)) * F.col("prediction")) for f in features]
    row = scored.agg(*[m.alias(f"m{i}") for i, m in enumerate(means)]).first()
    rows = [(f, round(row[i] + p, 4)) for i, (f, p) in enumerate(zip(features, plus))]
    return scored.sparkSession.createDataFrame(rows, "feature string, moment double")


def _spread(rows: DataFrame, features: list[str]):
    cells = [F.var_pop(col(f)) for f in features]
    row = rows.agg(F.count(F.lit(1)), *cells).first()
    return row[0], list(row[1:])


@query
def qsrr_moments(spark, sf):
    ds = dataset(spark, sf)
    fit = qsrr(ds.df, ds.features)
    return _moments(fit.model.predict(clean.known_target(ds.df)), ds.features, [0.0] * len(ds.features))


@query
def ridge_moments(spark, sf):
    table, alpha = reg._reg_table(spark, sf), 1.0
    model = cat.fit("Ridge", table, {"alpha": alpha})
    n, var = _spread(table.rows, table.features)
    return _moments(model.predict(table.rows), table.features, [alpha * c * v / n for c, v in zip(model.coef, var)])


@query
def lasso_moments(spark, sf):
    table, alpha = reg._reg_table(spark, sf), 0.1
    model = cat.fit("Lasso", table, {"alpha": alpha})
    n, var = _spread(table.rows, table.features)
    scored = model.predict(table.rows)
    left = [F.avg((F.col("y") - F.col("prediction")) * col(f)) for f in table.features]
    plus = []
    for c, v, g in zip(model.coef, var, scored.agg(*left).first()):
        most = alpha * v**0.5  # the slope of the penalty: met where a coefficient is used, not exceeded elsewhere
        plus.append(most * (1 if c > 0 else -1) if c else min(max(g, -most), most))
    return _moments(scored, table.features, plus)


# --- classifiers and trees: shares and leaf means -------------------------------------------------


def _shares(scored: DataFrame, n_labels: int, digits: int) -> DataFrame:
    """Mean predicted probability of every class over weighted rows."""
    cells = [F.round(F.sum(F.col("probability")[i] * F.col("w")) / F.sum("w"), digits).alias(f"p{i}") for i in range(n_labels)]
    row = scored.agg(*cells).first()
    return scored.sparkSession.createDataFrame([(i, row[i]) for i in range(n_labels)], "code bigint, share double")


@query
def logistic_shares(spark, sf):
    table = reg._clf_table(spark, sf)
    return _shares(reg.fitted(spark, sf, "LR", "classification", {"C": 1.0}).predict(table.packed), table.n_labels, 3)


@query
def tree_shares(spark, sf):
    table = reg._clf_table(spark, sf)
    return _shares(reg.fitted(spark, sf, "DT", "classification", {"max_depth": 10}).predict(table.packed), table.n_labels, 6)


@query
def tree_leaf_means(spark, sf):
    """Training rows, mean prediction, and leaves whose prediction is not the mean of their rows."""
    scored = reg.fitted(spark, sf, "DT", "regression", {"max_depth": 10}).predict(reg._reg_table(spark, sf).rows)
    leaves = scored.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"))
    return tidy(leaves.agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("prediction")) / F.sum("n")).alias("mean"),
        F.count_if(F.abs(F.col("m") - F.col("prediction")) > 1e-6).alias("wrong_leaves"),
    ))


@query
def boosting_mean(spark, sf):
    """Every tree of a squared-loss booster leaves residuals whose mean is zero."""
    model = reg.fitted(spark, sf, "GB", "regression", {"n_estimators": 50, "learning_rate": 0.1, "max_depth": 3})
    return model.predict(reg._reg_table(spark, sf).rows).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("prediction"), 4).alias("mean"))


# --- multivariate analysis ------------------------------------------------------------------------

PAIR = ["LogP", "pH"]


@once
def _pca_two(spark, sf):
    return pca_mod.pca(dataset(spark, sf).df, PAIR, 2)


@query
def pca_two_variance(spark, sf):
    return tidy(_pca_two(spark, sf).variance_table(spark))


@query
def pca_two_loadings(spark, sf):
    return tidy(_pca_two(spark, sf).loadings_table(spark))


@query
def pca_two_scores(spark, sf):
    return tidy(_pca_two(spark, sf).scores(dataset(spark, sf).df))


@query
def ward_energy(spark, sf):
    """Merges, and the sum of squares they remove, per run."""
    n = dataset(spark, sf).df.count()
    merges = reg._ward(spark, sf).merges
    return tidy(merges.agg(F.count(F.lit(1)).alias("n_merges"), (F.sum(F.col("height") * F.col("height")) / 2 / n).alias("energy")))


@query
def ward_label_energy(spark, sf):
    """Sum of squares inside two clusters, with what the last merge removes, per run."""
    ds, tree = dataset(spark, sf), reg._ward(spark, sf)
    labels = ward.ward_labels(tree, ds.df, 2).withColumnRenamed(RUN_ID, "_run")
    label = next(c for c in labels.columns if c != "_run")
    rows = ds.df.selectExpr(RUN_ID, *[f"coalesce(cast({quoted(f)} AS double), 0D) AS x{i}" for i, f in enumerate(ds.features)])
    both = rows.join(labels, F.col(RUN_ID) == F.col("_run"))
    inside = sum((F.var_pop(f"x{i}") for i in range(len(ds.features))), F.lit(0.0)) * F.count(F.lit(1))
    groups = both.groupBy(label).agg(F.count(F.lit(1)).alias("n"), inside.alias("ss"))
    last = tree.merges.agg(F.max("height")).first()[0]
    return tidy(groups.agg(F.sum("n").alias("n"), ((F.sum("ss") + last * last / 2) / F.sum("n")).alias("energy")))


def _graph_facts(edges: DataFrame) -> DataFrame:
    """Nodes, sum of weights, edges outside [0, 1] or without an equal counterpart."""
    pair = edges.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "p").groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), (F.max("p") - F.min("p")).alias("gap"), F.sum("p").alias("s"), F.max("p").alias("top")
    )
    one_sided = pair.agg(
        F.sum("s").alias("total"), F.count_if((F.col("n") != 2) | (F.col("gap") > 1e-9) | (F.col("top") > 1 + 1e-9)).alias("odd_edges")
    ).first()
    return edges.agg(F.count_distinct("i").alias("nodes")).select(
        "nodes", F.lit(one_sided["total"]).alias("total"), F.lit(one_sided["odd_edges"]).alias("odd_edges")
    )


@query
def tsne_graph_facts(spark, sf):
    return tidy(_graph_facts(reg._tsne_edges(spark, sf)))


@query
def umap_graph_facts(spark, sf):
    return tidy(_graph_facts(reg._umap_edges(spark, sf)).drop("total"))


def queries() -> dict[str, reg.Query]:
    return dict(_FOUND)
