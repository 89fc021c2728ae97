import pytest
from pyspark.sql import functions as F

from chromaspark.operators import conditions as cond

LABELS = ["Completely separated", "No data", "Overlaping", "Partially separated", "Partialy separated"]


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(3.0, 20.0, 80.0, 2), (2.5, 40.0, 60.0, 4), (2.5, 20.0, 80.0, 4), (7.0, 20.0, 80.0, 3)]
    return spark.createDataFrame(rows, "pH double, org double, buf double, code int")


def test_observed_needs_the_complement(spark):
    df = spark.createDataFrame(
        [(2.5, 20.0, 80.0, 1.0), (2.5, 20.0, 75.0, 0.0), (None, 20.0, 80.0, 0.0), (2.5, 20.0, 80.0, 9.0)],
        "pH double, `A_%` double, `B_%` double, `C_%` double")
    assert [tuple(r) for r in cond.observed_conditions(df, ["A_%", "B_%", "C_%"]).collect()] == [(2.5, 20.0, 80.0)]
    one = cond.observed_conditions(df, ["A_%"]).collect()
    assert [tuple(r) for r in one] == [(2.5, 20.0, 0.0)]
    feats = cond.condition_features(cond.observed_conditions(df, ["A_%", "B_%", "C_%"]), ["A_%", "B_%", "C_%"]).first()
    assert feats["C_%"] == 0.0 and feats["MolWt"] == 0.0


def test_best_by_priority_then_ph_then_org(scored):
    best = cond.best_condition(cond.with_priority(scored, LABELS)).first()
    assert (best["pH"], best["org"], best["label"]) == (2.5, 20.0, "Partialy separated")
    aliased = cond.with_priority(scored, LABELS, aliases={"Partially separated": "Partialy separated"})
    assert aliased.count() == 4 and cond.with_priority(scored, LABELS).count() == 3


def test_no_listed_class_gives_no_condition(scored):
    assert cond.best_condition(cond.with_priority(scored, ["x"] * 5)).count() == 0


def test_top_orders(scored):
    ranked = cond.with_priority(scored, LABELS)
    assert [r["code"] for r in cond.top_conditions(ranked, 2).collect()] == [4, 4]
    assert [r["code"] for r in cond.top_conditions(ranked, 3, order="code").collect()] == [4, 4, 2]


def test_heatmap_is_dense(ds, scored):
    long = cond.condition_heatmap(ds.df, scored.where("pH = 2.5"), ds.solvents)
    assert long.count() == 9 and long.where("code IS NOT NULL").count() == 2
    assert len(cond.condition_heatmap(ds.df, scored, ds.solvents, pivot=True).columns) == 4


def test_suggestions_keep_compounds_without_a_class(spark, lookup, ds):
    conditions = cond.observed_conditions(ds.df, ds.solvents)

    def classify(df):
        return df.withColumn("prediction", F.when(F.col("MolWt") > 40, F.lit(0)).otherwise(F.lit(9)))

    out = {r["SMILES"]: r for r in cond.suggest_conditions(lookup, conditions, ds.solvents, classify, LABELS,
                                                           lambda d: d.withColumn("prediction", F.col("pH") * 2)).collect()}
    assert len(out) == 4 and out["CO"]["label"] is None
    assert (out["CCO"]["pH"], out["CCO"]["org"], out["CCO"]["retention"]) == (2.5, 20.0, 5.0)
    grid = cond.cross_conditions(lookup, conditions, per_block=2)
    assert grid.count() == 4 * conditions.count()


def test_unlisted_labels_stay_in_the_top_list(spark):
    from chromaspark.operators.conditions import top_conditions, with_priority

    scored = spark.createDataFrame([(3.0, 20.0, 80.0, 0), (4.0, 20.0, 80.0, 1)], "pH double, org double, buf double, code int")
    ranked = with_priority(scored, ["Overlaping", "quite new"], unlisted=True)
    assert [r["label"] for r in top_conditions(ranked).collect()] == ["Overlaping", "quite new"]
    assert [r["label"] for r in top_conditions(ranked, order="code").collect()] == ["quite new", "Overlaping"]
