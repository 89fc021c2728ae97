import pandas as pd
import pytest
from pyspark.sql import functions as F

from chromaspark.operators import clean
from chromaspark.operators.descriptors import enrich_descriptors, strict_descriptors
from chromaspark.operators.lookup import lookup_join
from chromaspark.schema import feature_columns, solvent_columns


def test_ph_coercion_edges(spark):
    df = spark.createDataFrame([(1, "n/a"), (2, ""), (3, " 3.5 "), (4, "1e1"), (5, "7d"), (6, None)], "run_id int, pH string")
    got = {r["run_id"]: r["pH"] for r in clean.coerce_ph(df).collect()}
    assert got == {1: None, 2: None, 3: 3.5, 4: 10.0, 5: None, 6: None}


def test_labels_sorted_and_decoded(ds):
    assert ds.labels == sorted(ds.labels) and "No data" in ds.labels
    back = clean.decode_labels(ds.df, ds.labels).where("label <> Separation_Quality OR label IS NULL")
    assert back.count() == 0


def test_unknown_label_and_code(spark):
    df = spark.createDataFrame([("zzz",)], "Separation_Quality string")
    assert clean.encode_labels(df, ["a", "b"]).first()["SepQuality_Code"] is None
    code = spark.createDataFrame([(5,)], "SepQuality_Code int")
    assert clean.decode_labels(code, ["a", "b"]).first()["label"] is None


def test_columns_in_file_order():
    names = ["run_id", "B_%", "A_%", "pH"]
    assert solvent_columns(names) == ["B_%", "A_%"]
    assert feature_columns(names) == ["B_%", "A_%", "MolWt", "LogP", "TPSA", "HBD", "HBA", "pH"]


def test_enrich_and_strict(runs, lookup):
    rows = enrich_descriptors(runs, lookup).collect()
    assert len(rows) == 120
    assert all(r["MolWt"] == 0 and r["HBD"] == 0 for r in rows if r["SMILES"] in (None, "bad"))
    valid, rejected = strict_descriptors(runs, lookup)
    assert valid.count() == 80 and rejected.count() == 40


def test_function_provider_sees_distinct_structures(runs):
    def provider(smiles):
        ok = smiles != "bad"
        n = smiles.str.len().astype(float).where(ok)
        return pd.DataFrame({"MolWt": n, "LogP": n, "TPSA": n, "HBD": n, "HBA": n})

    out = enrich_descriptors(runs, provider)
    assert out.where("SMILES = 'CCO'").select("MolWt").distinct().collect()[0][0] == 3.0
    assert out.where("SMILES = 'bad'").select("MolWt").distinct().collect()[0][0] == 0.0


def test_name_clash_is_refused(ds, lookup):
    with pytest.raises(ValueError):
        enrich_descriptors(ds.df, lookup)
    assert enrich_descriptors(ds.df, lookup, overwrite=True).count() == 120


def test_salted_lookup_equals_broadcast(spark):
    facts = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"))
    dim = facts.select("k").distinct().withColumn("v", F.length("k"))
    a = lookup_join(facts, dim, ["k"], "left")
    b = lookup_join(facts, dim, ["k"], "left", spread=F.xxhash64("id"), max_rows=3)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_preview_and_summary(ds):
    p = clean.preview(ds.df, 5, 8).orderBy("run_id").collect()
    assert [r["run_id"] for r in p] == [0, 1, 2, 3, 4]
    assert p[0]["Separation_Quality"] in ("No data",) and p[1]["Separation_Quality"].endswith("...")
    s = clean.summary(ds.df).first()
    assert s["n_rows"] == 120 and s["n_cols"] == len(ds.df.columns)


def test_task_guards(spark, ds):
    assert clean.has_target(ds.df, "Retention_Time_min") and not clean.has_target(ds.df, "nope")
    assert clean.can_classify(ds.df)
    rare = spark.createDataFrame([(0,), (0,), (1,)], "SepQuality_Code int")
    assert not clean.can_classify(rare)


def test_salted_lookup_keeps_rows_without_a_key(spark):
    from chromaspark.operators.lookup import lookup_join

    facts = spark.createDataFrame([(i, None if i % 3 else "a", i % 2) for i in range(30)], "id int, k string, m int")
    dim = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), (None, 0, 9.0)], "k string, m int, x double")
    for limit in (100, 0):
        got = {r["id"]: r["x"] for r in lookup_join(facts, dim, ["k", "m"], max_rows=limit).collect()}
        assert got == {i: None if i % 3 else float(1 + i % 2) for i in range(30)}
        assert lookup_join(facts, dim, ["k", "m"], "inner", max_rows=limit).count() == 10
