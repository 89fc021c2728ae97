"""Metrics, confusion tables and evaluation curves over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chromaspark.functions.columns import col
from chromaspark.functions.reuse import keep
from chromaspark.functions.running import running_totals
from chromaspark.operators.clean import label_text


def regression_metrics(scored: DataFrame, y: str, pred: str = "prediction", weight: Column | None = None) -> DataFrame:
    """One row: n, rmse, r2 (around the evaluated rows' own mean, NULL if constant), mae."""
    e = col(y) - col(pred)
    one = scored.agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.var_pop(col(y)).alias("var"),
    )
    return one.select(
        "n", F.sqrt("mse").alias("rmse"), (F.lit(1.0) - F.try_divide("mse", "var")).alias("r2"), "mae"
    )


def accuracy(scored: DataFrame, y: str, pred: str = "prediction") -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("n"), F.avg((col(y) == col(pred)).cast("int")).alias("accuracy")
    )


def _pairs(scored: DataFrame, n_labels: int) -> DataFrame:
    codes = F.array(*[F.lit(i) for i in range(n_labels)])
    one = scored.sparkSession.range(1)
    return one.select(F.explode(codes).alias("actual")).select("actual", F.explode(codes).alias("predicted"))


def confusion(scored: DataFrame, y: str, pred: str, n_labels: int) -> DataFrame:
    """Counts for every (actual, predicted) pair of codes, zeros included."""
    seen = scored.groupBy(col(y).alias("actual"), col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return _pairs(scored, n_labels).join(seen, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n")
    )


def class_report(scored: DataFrame, y: str, pred: str, labels: list[str]) -> DataFrame:
    """Precision, recall, F1 and support per label, then ``accuracy``, macro and weighted averages."""
    table = confusion(scored, y, pred, len(labels))
    side = table.select(
        F.inline(F.array(
            F.struct(F.col("actual").alias("code"), F.col("n").alias("support"), F.lit(0).alias("named"),
                     F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
            F.struct(F.col("predicted").alias("code"), F.lit(0).alias("support"), F.col("n").alias("named"),
                     F.lit(0).alias("hit")),
        ))
    )
    sums = side.groupBy("code").agg(*[F.sum(c).alias(c) for c in ("support", "named", "hit")])
    p = F.coalesce(F.try_divide("hit", "named"), F.lit(0.0))
    r = F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.lit(2) * F.col("hit"), F.col("named") + F.col("support")), F.lit(0.0))
    per = sums.select(
        label_text(F.col("code"), labels).alias("label"), p.alias("precision"), r.alias("recall"), f1.alias("f1"),
        F.col("support").alias("support"), "hit",
    )
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    averages = per.agg(
        *[F.avg(c).alias(f"m_{c}") for c in names],
        *[F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), total), F.lit(0.0)).alias(f"w_{c}") for c in names],
        total.alias("support"), F.try_divide(F.sum("hit"), total).alias("accuracy"),
    ).select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("label"), *[F.col("accuracy").alias(c) for c in names], "support"),
        F.struct(F.lit("macro avg").alias("label"), *[F.col(f"m_{c}").alias(c) for c in names], "support"),
        F.struct(F.lit("weighted avg").alias("label"), *[F.col(f"w_{c}").alias(c) for c in names], "support"),
    )))
    return per.drop("hit").unionByName(averages)


def score_counts(scores: DataFrame) -> DataFrame:
    """Per class and distinct score, positives and negatives; input ``(class, score, positive)``."""
    hit = F.col("positive").cast("int")
    return scores.groupBy("class", "score").agg(
        F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg")
    )


def one_vs_rest(scored: DataFrame, y: str, n_labels: int, probability: str = "probability") -> DataFrame:
    """Scores of every class against the others, from a probability array."""
    p = scored.select(col(y).alias("_y"), F.posexplode(F.slice(col(probability), 1, n_labels)))
    return p.select(F.col("pos").alias("class"), F.col("col").alias("score"), (F.col("_y") == F.col("pos")).alias("positive"))


def _cumulative(scores: DataFrame) -> DataFrame:
    counts = keep(score_counts(scores))
    run = running_totals(counts, "class", "score", ["pos", "neg"])
    totals = F.broadcast(counts.groupBy("class").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")))
    return run.join(totals, "class")


def roc_points(scores: DataFrame) -> DataFrame:
    """``(class, threshold, fpr, tpr)`` for each distinct score; the origin has no threshold."""
    c = _cumulative(scores)
    points = c.select(
        "class", F.col("score").alias("threshold"), F.try_divide("cum_neg", "N").alias("fpr"),
        F.try_divide("cum_pos", "P").alias("tpr"),
    )
    origin = points.select("class").distinct().select(
        "class", F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.unionByName(points)


def auc(scores: DataFrame) -> DataFrame:
    """Area under the ROC curve per class by the trapezoid rule, as one aggregation."""
    c = _cumulative(scores)
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0))
    return c.groupBy("class", "P", "N").agg(area.alias("a")).select(
        "class", F.try_divide(F.col("a"), (F.col("P") * F.col("N")).cast("double")).alias("auc")
    )


def pr_points(scores: DataFrame) -> DataFrame:
    """``(class, threshold, precision, recall)`` with the closing point (precision 1, recall 0)."""
    c = _cumulative(scores)
    points = c.select(
        "class", F.col("score").alias("threshold"),
        F.try_divide(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        F.try_divide("cum_pos", "P").alias("recall"),
    )
    end = points.select("class").distinct().select(
        "class", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return end.unionByName(points)


def binary_curves(scores: DataFrame, n_labels: int) -> DataFrame | str:
    """ROC of the positive class (code 1) when there are two classes, otherwise a note."""
    if n_labels != 2:
        return "ROC and precision-recall plots need exactly two classes; use the one-vs-rest points"
    return roc_points(scores.where(F.col("class") == 1))


def predicted_vs_actual(scored: DataFrame, y: str, key: str, pred: str = "prediction") -> DataFrame:
    return scored.select(col(key), col(y).alias("actual"), col(pred).alias("predicted"))


def identity_line(scored: DataFrame, y: str) -> DataFrame:
    """Ends of the identity line: smallest and largest actual value."""
    return scored.agg(F.min(col(y)).alias("low"), F.max(col(y)).alias("high"))


def residuals(scored: DataFrame, y: str, key: str, pred: str = "prediction") -> DataFrame:
    return scored.select(col(key), col(pred).alias("predicted"), (col(y) - col(pred)).alias("residual"))


def rank_models(metrics: DataFrame) -> DataFrame:
    """Rank of each model in its task: lowest RMSE or highest accuracy, ties by catalogue place.

    A classifier that got nothing right is never best, so it takes no rank.
    """
    order = F.when(F.col("task") == "regression", F.col("rmse")).otherwise(-F.col("accuracy"))
    usable = (F.col("task") == "regression") | (F.col("accuracy") > 0)
    w = W.partitionBy("task").orderBy("_o", "catalog_pos")
    ranked = metrics.where(usable).withColumn("_o", order).withColumn("rank", F.row_number().over(w))
    return ranked.drop("_o")


def model_metrics(metrics: DataFrame, task: str, model: str) -> DataFrame:
    return metrics.where((F.col("task") == task) & (F.col("model") == model))


def metric_bars(metrics: DataFrame) -> DataFrame:
    """Bar-chart data ``(task, model, metric, value)``."""
    cells = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("rmse", "r2", "accuracy")
    ])
    return metrics.select("task", "model", F.inline(cells)).where("value IS NOT NULL")
