"""Every operator wired to the given tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from chromaspark.analysis import embed, pca as pca_mod, ward
from chromaspark.analysis.qsrr import qsrr
from chromaspark.functions.columns import col
from chromaspark.functions.nearest import nearest
from chromaspark.functions.reuse import keep, shared_folder
from chromaspark.models import catalog as cat, knn as knn_model, linear, tune
from chromaspark.models.base import predict_distinct, training_table
from chromaspark.operators import clean, conditions as cond, descriptors as desc, evaluate as ev, moments, split
from chromaspark.operators.explain import feature_importance, most_influential
from chromaspark.operators.neighbours import as_vectors, distinct_vectors, knn_join
from chromaspark.operators.predict import predict_quality, predict_retention, prepare_compounds
from chromaspark.plans import given
from chromaspark.plans.given import dataset, descriptor_lookup, raw_runs
from chromaspark.schema import DESCRIPTORS, QUALITY, QUALITY_CODE, RETENTION, RUN_ID, SMILES, quoted
from chromaspark.sources import report as rep, session as ses, tables
from chromaspark.streaming import score as stream

FILE_RUNS = 1_000_000  # of one file of arriving runs, at most

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}
_memo: dict = {}


def query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def once(fn):
    """Share a fitted model or scored table between the queries of one session and folder."""

    def wrapped(spark: SparkSession, sf: str):
        slot = (fn.__name__, spark.sparkContext.applicationId, sf)
        if slot not in _memo:
            _memo[slot] = fn(spark, sf)
        return _memo[slot]

    return wrapped


def forget(spark: SparkSession) -> None:
    _memo.clear()
    given.forget(spark)


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: whole numbers as BIGINT, doubles to six places."""

    def cell(name: str, kind: str) -> str:
        c = quoted(name)
        if kind in ("tinyint", "smallint", "int"):
            return f"cast({c} AS bigint) AS {c}"
        return f"round({c}, 6) + 0D AS {c}" if kind == "double" else c

    return df.selectExpr(*[cell(n, t) for n, t in df.dtypes])


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- cleaning -------------------------------------------------------------------------------------


@query
def ingest_runs(spark, sf):
    return raw_runs(spark, sf)


@query
def csv_roundtrip(spark, sf):
    path = scratch(spark, "runs") + ".csv"
    tables.write_runs(raw_runs(spark, sf), path)
    return tables.read_runs(spark, path)


@query
def ph_coerce(spark, sf):
    return clean.coerce_ph(raw_runs(spark, sf)).select(RUN_ID, "pH")


@query
def label_fill(spark, sf):
    return clean.fill_labels(raw_runs(spark, sf)).select(RUN_ID, QUALITY)


@query
def label_encode(spark, sf):
    return tidy(dataset(spark, sf).df.select(RUN_ID, QUALITY, QUALITY_CODE))


@query
def label_decode(spark, sf):
    ds = dataset(spark, sf)
    return clean.decode_labels(ds.df, ds.labels).select(RUN_ID, "label")


@query
def label_dictionary(spark, sf):
    return tidy(clean.label_table(spark, dataset(spark, sf).labels))


@query
def feature_table(spark, sf):
    return tidy(clean.feature_table(dataset(spark, sf).df, [RETENTION, QUALITY_CODE]))


@query
def known_target(spark, sf):
    return clean.known_target(dataset(spark, sf).df).select(RUN_ID, RETENTION)


@query
def preview(spark, sf):
    df = dataset(spark, sf).df.select(RUN_ID, "Compound", SMILES, QUALITY, "pH")
    return clean.preview(df, 1000, 20)


@query
def run_label(spark, sf):
    return clean.with_run_label(dataset(spark, sf).df).select(RUN_ID, "run_label")


@query
def dataset_summary(spark, sf):
    names = [RUN_ID, "Compound", SMILES, RETENTION, QUALITY, "Buffer_%", "Organic_%", "pH", *DESCRIPTORS, QUALITY_CODE]
    return tidy(clean.summary(dataset(spark, sf).df.select(*[col(c) for c in names])))


@query
def descriptor_enrich(spark, sf):
    out = desc.enrich_descriptors(raw_runs(spark, sf), descriptor_lookup(spark))
    return tidy(out.select(RUN_ID, SMILES, *DESCRIPTORS))


@query
def descriptor_strict(spark, sf):
    valid, _ = desc.strict_descriptors(raw_runs(spark, sf), descriptor_lookup(spark))
    return tidy(valid.select(RUN_ID, SMILES, *DESCRIPTORS))


@query
def descriptor_rejects(spark, sf):
    _, rejected = desc.strict_descriptors(raw_runs(spark, sf), descriptor_lookup(spark))
    return rejected.select(RUN_ID, SMILES)


@once
def _compounds(spark, sf):
    valid, _ = prepare_compounds(dataset(spark, sf).df, descriptor_lookup(spark), dataset(spark, sf).solvents)
    return keep(valid)


@query
def default_condition(spark, sf):
    return tidy(_compounds(spark, sf).drop(RUN_ID))


# --- splits and moments ---------------------------------------------------------------------------


@query
def split_random(spark, sf):
    return split.hash_split(raw_runs(spark, sf)).select(RUN_ID, "is_test")


@once
def _reg_split(spark, sf):
    return tune.split_regression(dataset(spark, sf))


@once
def _clf_split(spark, sf):
    return tune.split_classification(dataset(spark, sf))


@query
def split_exact(spark, sf):
    return _reg_split(spark, sf).select(RUN_ID, "is_test")


@query
def split_stratified(spark, sf):
    return tidy(_clf_split(spark, sf).select(RUN_ID, col(QUALITY_CODE).alias("code"), "is_test"))


@query
def folds(spark, sf):
    return tidy(split.hash_folds(raw_runs(spark, sf)).select(RUN_ID, "fold"))


@query
def folds_stratified(spark, sf):
    out = split.stratified_folds(dataset(spark, sf).df.select(RUN_ID, QUALITY_CODE), QUALITY_CODE)
    return tidy(out.select(RUN_ID, col(QUALITY_CODE).alias("code"), "fold"))


@query
def class_counts(spark, sf):
    return tidy(clean.class_counts(dataset(spark, sf).df))


@query
def axis_values(spark, sf):
    df = dataset(spark, sf).df
    parts = [clean.axis_values(df, c).select(F.lit(c).alias("axis"), "value") for c in ("pH", "Buffer_%", "Organic_%")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def standardize(spark, sf):
    ds = dataset(spark, sf)
    return tidy(moments.standardize(clean.feature_table(ds.df), ds.features))


@query
def gram(spark, sf):
    """Gram cells per run: sums grow with the table, so six decimals are compared after dividing by n."""
    ds = dataset(spark, sf)
    n = ds.df.count()
    cells = moments.gram_table(ds.df, ds.features)
    return tidy(cells.select("x", "y", (F.col("value") / n).alias("value_per_run")))


@query
def correlation(spark, sf):
    ds = dataset(spark, sf)
    return tidy(moments.correlation(ds.df, [*ds.features, RETENTION]))


# --- neighbour models and their evaluation --------------------------------------------------------


@once
def _reg_knn(spark, sf):
    ds, rows = dataset(spark, sf), _reg_split(spark, sf)
    table = training_table(rows.where("NOT is_test"), ds.features, RETENTION, "regression")
    return knn_model.fit(table, {"n_neighbors": 5})


@once
def _clf_knn(spark, sf):
    ds, rows = dataset(spark, sf), _clf_split(spark, sf)
    table = training_table(rows.where("NOT is_test"), ds.features, QUALITY_CODE, "classification", len(ds.labels))
    return knn_model.fit(table, {"n_neighbors": 5})


@once
def _reg_scored(spark, sf):
    test = _reg_split(spark, sf).where("is_test")
    return keep(_reg_knn(spark, sf).predict(test).select(RUN_ID, RETENTION, "prediction"))


@once
def _clf_scored(spark, sf):
    test = _clf_split(spark, sf).where("is_test")
    return keep(_clf_knn(spark, sf).predict(test).select(RUN_ID, QUALITY_CODE, "prediction", "probability"))


@once
def _clf_accuracy(spark, sf):
    return ev.accuracy(_clf_scored(spark, sf), QUALITY_CODE).first()["accuracy"]


@once
def _reg_r2(spark, sf):
    return ev.regression_metrics(_reg_scored(spark, sf), RETENTION).first()["r2"]


@query
def knn_neighbours(spark, sf):
    rows, ds = _reg_split(spark, sf), dataset(spark, sf)
    return tidy(knn_join(rows.where("is_test"), rows.where("NOT is_test"), ds.features, 3))


_REGISTRY["knn_join"] = _REGISTRY.pop("knn_neighbours")


@query
def knn_continuous(spark, sf):
    """Five nearest train rows of each query row over continuous columns; every row of ``lineitem`` is on one side."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(
        *[F.min(c).cast("double").alias(c) for c in ("l_extendedprice", "l_quantity", "l_discount", "l_tax")]
    ).selectExpr(
        "CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS id",
        "array(l_extendedprice / 20000D, l_quantity / 10D, l_discount * 20D, l_tax * 20D) AS v", "1D AS w",
    )
    split = keep(rows.withColumn("asked", F.expr("CAST(conv(substring(md5(concat('42:', CAST(id AS STRING))), 1, 8), 16, 10) AS BIGINT) % 100 < 5")))
    near = nearest(split.where("asked"), split.where("NOT asked"), 5)
    order = "row_number() OVER (PARTITION BY qid ORDER BY d2, tid) AS rank"
    return tidy(near.selectExpr("qid AS run_id", order, "tid AS neighbour", "d2"))


@query
def csv_multiline(spark, sf):
    """Supplier rows through CSV with line breaks and quotes inside a field."""
    path = scratch(spark, "multiline")
    rows = spark.read.parquet(f"{sf}/supplier.parquet").select(
        F.col("s_suppkey").cast("bigint").alias(RUN_ID), F.concat("s_name", F.lit('\n"line" two, '), F.col("s_nationkey").cast("string")).alias("Compound")
    )
    tables.write_runs(rows, path)
    return tables.read_runs(spark, path, "csv").select(RUN_ID, "Compound")


@query
def knn_regress(spark, sf):
    return tidy(ev.predicted_vs_actual(_reg_scored(spark, sf), RETENTION, RUN_ID))


@query
def knn_classify(spark, sf):
    return tidy(ev.predicted_vs_actual(_clf_scored(spark, sf), QUALITY_CODE, RUN_ID))


@query
def knn_grid_scores(spark, sf):
    ds = dataset(spark, sf)
    train = split.hash_folds(_reg_split(spark, sf).where("NOT is_test"))
    table = training_table(train, ds.features, RETENTION, "regression")
    rows = knn_model.cv_scores(table, [{"n_neighbors": k} for k in (3, 5, 7)])
    return tidy(spark.createDataFrame(rows, "grid_id int, fold int, score double"))


@query
def reg_metrics(spark, sf):
    return tidy(ev.regression_metrics(_reg_scored(spark, sf), RETENTION))


@query
def clf_metrics(spark, sf):
    return tidy(ev.accuracy(_clf_scored(spark, sf), QUALITY_CODE))


@query
def confusion(spark, sf):
    return tidy(ev.confusion(_clf_scored(spark, sf), QUALITY_CODE, "prediction", len(dataset(spark, sf).labels)))


@query
def class_report(spark, sf):
    return tidy(ev.class_report(_clf_scored(spark, sf), QUALITY_CODE, "prediction", dataset(spark, sf).labels))


@once
def _ovr(spark, sf):
    return keep(ev.one_vs_rest(_clf_scored(spark, sf), QUALITY_CODE, len(dataset(spark, sf).labels)))


@query
def roc_ovr(spark, sf):
    return tidy(ev.roc_points(_ovr(spark, sf)))


@query
def auc_ovr(spark, sf):
    return tidy(ev.auc(_ovr(spark, sf)))


@query
def pr_ovr(spark, sf):
    return tidy(ev.pr_points(_ovr(spark, sf)))


@query
def residuals(spark, sf):
    return tidy(ev.residuals(_reg_scored(spark, sf), RETENTION, RUN_ID))


@query
def identity_line(spark, sf):
    return ev.identity_line(_reg_scored(spark, sf), RETENTION)


@query
def results_table(spark, sf):
    reg = ev.regression_metrics(_reg_scored(spark, sf), RETENTION).select(
        F.lit("KNN").alias("model"), F.lit("Regression").alias("type"), "rmse", "r2", "mae")
    clf = ev.accuracy(_clf_scored(spark, sf), QUALITY_CODE).select(
        F.lit("KNN").alias("model"), F.lit("Classification").alias("type"), "accuracy")
    return tidy(reg.unionByName(clf, allowMissingColumns=True))


# --- conditions and predictions -------------------------------------------------------------------


def _as_ph(df: DataFrame) -> DataFrame:
    return tidy(df.withColumnRenamed("pH", "ph"))


@once
def _conditions(spark, sf):
    ds = dataset(spark, sf)
    return keep(cond.observed_conditions(ds.df, ds.solvents))


@once
def _conditions_scored(spark, sf):
    ds = dataset(spark, sf)
    return keep(cond.score_conditions(_clf_knn(spark, sf).predict, _conditions(spark, sf), ds.solvents))


def _ranked(spark, sf):
    return cond.with_priority(_conditions_scored(spark, sf), dataset(spark, sf).labels)


def _all_ranked(spark, sf):
    return cond.with_priority(_conditions_scored(spark, sf), dataset(spark, sf).labels, unlisted=True)


@query
def conditions(spark, sf):
    return _as_ph(_conditions(spark, sf))


@query
def condition_scores(spark, sf):
    return _as_ph(_conditions_scored(spark, sf))


@query
def best_condition(spark, sf):
    return _as_ph(cond.best_condition(_ranked(spark, sf)).select("pH", "org", "buf", "label"))


@query
def top_conditions(spark, sf):
    return _as_ph(cond.top_conditions(_all_ranked(spark, sf)).select("pH", "org", "buf", "label"))


@query
def top_conditions_code(spark, sf):
    return _as_ph(cond.top_conditions(_all_ranked(spark, sf), order="code").select("pH", "org", "buf", "label"))


@query
def heatmap(spark, sf):
    ds = dataset(spark, sf)
    return _as_ph(cond.condition_heatmap(ds.df, _conditions_scored(spark, sf), ds.solvents))


@query
def suggest_per_compound(spark, sf):
    ds = dataset(spark, sf)
    out = cond.suggest_conditions(
        _compounds(spark, sf), _conditions(spark, sf), ds.solvents, _clf_knn(spark, sf).predict, ds.labels,
        _reg_knn(spark, sf).predict, accuracy=_clf_accuracy(spark, sf), r2=_reg_r2(spark, sf),
    )
    return _as_ph(out.select(SMILES, "pH", "org", "buf", "label", "retention", "accuracy", "r2"))


@query
def predict_retention_default(spark, sf):
    return tidy(predict_retention(_reg_knn(spark, sf), _compounds(spark, sf)))


@query
def predict_quality_default(spark, sf):
    said = predict_quality(_clf_knn(spark, sf), _compounds(spark, sf), dataset(spark, sf).labels, _clf_accuracy(spark, sf))
    return tidy(said)


_REGISTRY["predict_retention"] = _REGISTRY.pop("predict_retention_default")
_REGISTRY["predict_quality"] = _REGISTRY.pop("predict_quality_default")


# --- linear models --------------------------------------------------------------------------------


@query
def qsrr_single(spark, sf):
    fit = qsrr(dataset(spark, sf).df, ["MolWt"])
    rows = [(fit.model.coef[0], fit.model.intercept, fit.r2, fit.n)]
    return tidy(spark.createDataFrame(rows, "slope double, intercept double, r2 double, n bigint"))


@query
def qsrr_two(spark, sf):
    m = qsrr(dataset(spark, sf).df, ["LogP", "pH"]).model
    return tidy(spark.createDataFrame([(*m.coef, m.intercept)], "logp double, ph double, intercept double"))


@query
def ridge_two(spark, sf):
    g = moments.gram(dataset(spark, sf).df, ["LogP", "pH"], RETENTION)
    m = linear.fit_linear("Ridge", g, {"alpha": 1.0})
    return tidy(spark.createDataFrame([(*m.coef, m.intercept)], "logp double, ph double, intercept double"))


@query
def qsrr_points(spark, sf):
    df = dataset(spark, sf).df
    return tidy(qsrr(df, ["MolWt"]).points(df))


@query
def qsrr_full(spark, sf):
    ds = dataset(spark, sf)
    return qsrr(ds.df, ds.features).coefficients(spark)


@query
def qsrr_summary(spark, sf):
    ds = dataset(spark, sf)
    return qsrr(ds.df, ds.features).summary(spark)


@once
def _reg_table(spark, sf):
    ds = dataset(spark, sf)
    return training_table(split.hash_folds(_reg_split(spark, sf).where("NOT is_test")), ds.features, RETENTION, "regression")


@once
def _clf_table(spark, sf):
    ds = dataset(spark, sf)
    rows = split.stratified_folds(_clf_split(spark, sf).where("NOT is_test"), QUALITY_CODE)
    return training_table(rows, ds.features, QUALITY_CODE, "classification", len(ds.labels))


def _coefficients(spark, model) -> DataFrame:
    rows = list(zip(model.features, model.coef)) + [("(intercept)", model.intercept)]
    return spark.createDataFrame(rows, "feature string, coefficient double")


@query
def ridge(spark, sf):
    return _coefficients(spark, cat.fit("Ridge", _reg_table(spark, sf), {"alpha": 1.0}))


@query
def lasso(spark, sf):
    return _coefficients(spark, cat.fit("Lasso", _reg_table(spark, sf), {"alpha": 0.1}))


@query
def linear_grid_scores(spark, sf):
    table, rows = _reg_table(spark, sf), []
    grams = linear.fold_grams(table)
    for name in cat.LINEAR:
        grid = cat.expand(cat.DEFAULT_GRIDS[("regression", name)])
        rows += [("regression", name, i, f, s, str(grid[i])) for i, f, s in linear.cv_scores(name, grams, grid)]
    return spark.createDataFrame(rows, tune.SCORES_SCHEMA)


def fitted(spark, sf, name: str, task: str, params: dict):
    """A model fitted on the training rows, shared by the queries that ask for it."""
    slot = (f"{task} {name} {params}", spark.sparkContext.applicationId, sf)
    if slot not in _memo:
        _memo[slot] = cat.fit(name, (_reg_table if task == "regression" else _clf_table)(spark, sf), params)
    return _memo[slot]


def _test_scores(spark, sf, name: str, task: str, params: dict) -> DataFrame:
    rows = _reg_split if task == "regression" else _clf_split
    target = RETENTION if task == "regression" else QUALITY_CODE
    model = fitted(spark, sf, name, task, params)
    return predict_distinct(model, rows(spark, sf).where("is_test")).select(RUN_ID, col(target).alias("actual"), "prediction")


@query
def logistic(spark, sf):
    return _test_scores(spark, sf, "LR", "classification", {"C": 1.0})


@query
def decision_tree_regress(spark, sf):
    return _test_scores(spark, sf, "DT", "regression", {"max_depth": 10})


@query
def decision_tree_classify(spark, sf):
    return _test_scores(spark, sf, "DT", "classification", {"max_depth": 10})


@query
def forest_regress(spark, sf):
    return _test_scores(spark, sf, "RF", "regression", {"n_estimators": 50, "max_depth": 10})


@query
def forest_classify(spark, sf):
    return _test_scores(spark, sf, "RFC", "classification", {"n_estimators": 50, "max_depth": 10})


@query
def boosting_regress(spark, sf):
    return _test_scores(spark, sf, "GB", "regression", {"n_estimators": 50, "learning_rate": 0.1, "max_depth": 3})


@query
def boosting_classify(spark, sf):
    return _test_scores(spark, sf, "GBC", "classification", {"n_estimators": 50, "learning_rate": 0.1, "max_depth": 3})


@query
def svr(spark, sf):
    return _test_scores(spark, sf, "SVR", "regression", {"C": 1})


@query
def svc(spark, sf):
    return _test_scores(spark, sf, "SVC", "classification", {"C": 1})


@query
def mlp_regress(spark, sf):
    return _test_scores(spark, sf, "MLP", "regression", {"hidden_layer_sizes": (50,), "alpha": 1e-3})


@query
def mlp_classify(spark, sf):
    return _test_scores(spark, sf, "MLPC", "classification", {"hidden_layer_sizes": (50,), "alpha": 1e-3})


# --- training runs --------------------------------------------------------------------------------

@once
def _trained_reg(spark, sf):
    return tune.train_regression(dataset(spark, sf), [*tune.DEFAULT_REGRESSION, "Ridge", "Lasso", "KNN", "DT"])


@once
def _trained_clf(spark, sf):
    return tune.train_classification(dataset(spark, sf), [*tune.DEFAULT_CLASSIFICATION, "KNN", "DT", "LR"])


@once
def _tuned_knn(spark, sf):
    return tune.train_regression(dataset(spark, sf), ["KNN"])


@once
def _tuned_tree(spark, sf):
    return tune.train_classification(dataset(spark, sf), ["DT"])


@query
def train_regression(spark, sf):
    return _trained_reg(spark, sf).metrics


@query
def train_classification(spark, sf):
    return _trained_clf(spark, sf).metrics


@query
def grid_scores(spark, sf):
    return _trained_reg(spark, sf).scores(spark).unionByName(_trained_clf(spark, sf).scores(spark))


@query
def grid_means(spark, sf):
    return tidy(tune.mean_scores(_tuned_knn(spark, sf).scores(spark).where("model = 'KNN'")))


@query
def model_rank(spark, sf):
    return ev.rank_models(_trained_reg(spark, sf).metrics.unionByName(_trained_clf(spark, sf).metrics))


@query
def metric_bars(spark, sf):
    return ev.metric_bars(_trained_reg(spark, sf).metrics.unionByName(_trained_clf(spark, sf).metrics))


@query
def feature_importance_table(spark, sf):
    return feature_importance(spark, _tuned_tree(spark, sf).models["DT"])


@query
def most_influential_feature(spark, sf):
    return most_influential(spark, _tuned_tree(spark, sf).models["DT"])


@query
def learning_curve(spark, sf):
    ds = dataset(spark, sf)
    curve = tune.learning_curve("DT", _reg_split(spark, sf).where("NOT is_test"), ds.features, RETENTION, "regression",
                                {"max_depth": 5})
    return tune.learning_curve_means(curve)


@query
def report(spark, sf):
    best = cond.best_condition(_ranked(spark, sf))
    return rep.report_lines(spark, dataset(spark, sf), [_trained_reg(spark, sf), _trained_clf(spark, sf)], best)


# --- multivariate analysis ------------------------------------------------------------------------


@once
def _pca(spark, sf):
    ds = dataset(spark, sf)
    return pca_mod.pca(ds.df, ds.features)


@query
def pca_scores(spark, sf):
    return _pca(spark, sf).scores(dataset(spark, sf).df)


@query
def pca_variance(spark, sf):
    return _pca(spark, sf).variance_table(spark)


@query
def pca_loadings(spark, sf):
    return _pca(spark, sf).loadings_table(spark)


@query
def pca_total_variance(spark, sf):
    return tidy(spark.createDataFrame([(_pca(spark, sf).total,)], "total double"))


@query
def embedding_scatter(spark, sf):
    df = dataset(spark, sf).df
    return pca_mod.scatter(_pca(spark, sf).scores(df), df, QUALITY)


@once
def _ward(spark, sf):
    ds = dataset(spark, sf)
    return ward.ward_tree(ds.df, ds.features)


@query
def ward_merges(spark, sf):
    return ward.numbered_merges(_ward(spark, sf))


@query
def ward_labels(spark, sf):
    return ward.ward_labels(_ward(spark, sf), dataset(spark, sf).df, 2)


def _embedding_vectors(spark, sf):
    """Distinct vectors of the given embedding table."""
    e = given.read_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return keep(e.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).cast("double").alias("w")))


@query
def knn_graph(spark, sf):
    v = _embedding_vectors(spark, sf)
    near = nearest(v, v, 14, exclude_self=True)
    packed = near.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("d2", "tid"))).alias("near"))
    flat = packed.select("qid", F.posexplode("near"))
    return tidy(flat.select(
        F.col("qid").alias("i"), F.col("col.tid").alias("j"), (F.col("pos") + 1).alias("rank"),
        F.sqrt("col.d2").alias("distance")))


@once
def _run_vectors(spark, sf):
    ds = dataset(spark, sf)
    return keep(as_vectors(distinct_vectors(ds.df, ds.features), None, ds.features))


@once
def _umap_edges(spark, sf):
    return keep(embed.umap_graph(_run_vectors(spark, sf)))


@once
def _tsne_edges(spark, sf):
    return keep(embed.tsne_graph(_run_vectors(spark, sf)))


@query
def umap_graph(spark, sf):
    return _umap_edges(spark, sf)


@query
def tsne_graph(spark, sf):
    return _tsne_edges(spark, sf)


@query
def tsne_2d(spark, sf):
    ds = dataset(spark, sf)
    return embed.tsne(ds.df, ds.features, 2).points(ds.df)


@query
def tsne_3d(spark, sf):
    ds = dataset(spark, sf)
    return embed.tsne(ds.df, ds.features, 3).points(ds.df)


@query
def umap_2d(spark, sf):
    ds = dataset(spark, sf)
    return embed.umap(ds.df, ds.features, 2).points(ds.df)


@query
def umap_3d(spark, sf):
    ds = dataset(spark, sf)
    return embed.umap(ds.df, ds.features, 3).points(ds.df)


# --- persistence and streaming --------------------------------------------------------------------


@query
def model_roundtrip(spark, sf):
    ds = dataset(spark, sf)
    path = scratch(spark, "model")
    qsrr(ds.df, ["MolWt"]).model.save(spark, path)
    return tidy(cat.load_model(spark, path).predict(ds.df).select(RUN_ID, "prediction"))


@query
def session_roundtrip(spark, sf):
    folder = scratch(spark, "session")
    heat = cond.condition_heatmap(dataset(spark, sf).df, _conditions_scored(spark, sf), dataset(spark, sf).solvents)
    ses.save_session(spark, ses.Session(dataset(spark, sf), [_trained_reg(spark, sf), _trained_clf(spark, sf)], heat), folder)
    back = ses.load_session(spark, folder)
    return back.results[0].best.predict(back.results[0].test).select(RUN_ID, "prediction")


@query
def score_stream(spark, sf):
    ds = dataset(spark, sf)
    model = qsrr(ds.df, ["MolWt"]).model
    folder = scratch(spark, "stream")
    runs = raw_runs(spark, sf)
    runs.write.parquet(f"{folder}/in")
    arriving = stream.stream_runs(spark, f"{folder}/in", runs.schema)
    scored = stream.score_stream(arriving, descriptor_lookup(spark), model)
    stream.run_once(scored.select(RUN_ID, "prediction"), f"{folder}/out", f"{folder}/state")
    return tidy(spark.read.parquet(f"{folder}/out"))


@query
def stream_knn(spark, sf):
    """All runs arrive as a stream in several batches and are scored by the neighbour model."""
    folder = scratch(spark, "stream")
    runs = raw_runs(spark, sf)
    lines = given.read_table(spark, sf, "lineitem").count()  # from the footers
    half = 2 * max(1, -(-lines // (4 * FILE_RUNS)))
    runs.repartition(2 * half).write.parquet(f"{folder}/in")
    arriving = stream.stream_runs(spark, f"{folder}/in", runs.schema, files_per_batch=half)
    stream.run_batches(arriving, descriptor_lookup(spark), _reg_knn(spark, sf), [RUN_ID, "prediction"], f"{folder}/out", f"{folder}/state")
    return tidy(spark.read.parquet(f"{folder}/out").drop("batch"))


def queries() -> dict[str, Query]:
    from chromaspark.plans import proofs  # builds on the queries above

    return _REGISTRY | proofs.queries()


