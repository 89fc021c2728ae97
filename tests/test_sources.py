import pytest
from pyspark.sql import functions as F

from chromaspark.analysis.qsrr import qsrr
from chromaspark.models import catalog as cat, tune
from chromaspark.models.base import training_table
from chromaspark.operators.predict import predict_quality, predict_retention, prepare_compounds
from chromaspark.sources import report, session, tables
from chromaspark.streaming import score


def test_unknown_suffix(spark):
    for name in ("x.txt", "x"):
        with pytest.raises(ValueError):
            tables.read_runs(spark, name)
    assert tables.source_format("A.CSV") == "csv"


def test_csv_sample(spark, tmp_path):
    p = tmp_path / "runs.csv"
    p.write_text("Compound,SMILES,Retention_Time_min,Separation_Quality,Buffer_%,Organic_%,pH\n"
                 "\"A, first\",CCO,3.5,Partially separated,60,40,3.0\nB,NA,n/a,,70,30,n/a\n")
    side = tmp_path / "chrom.csv"
    side.write_text("t,signal\n0,1\n")
    files = tables.read_dataset(spark, str(p), str(side))
    a, b = files.runs.orderBy("Compound").collect()
    assert a["Compound"] == "A, first" and a["Buffer_%"] == 60.0
    assert b["SMILES"] is None and b["Retention_Time_min"] is None and b["Separation_Quality"] is None and b["pH"] is None
    assert files.chromatogram.count() == 1


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_write_and_read_back(spark, runs, tmp_path, fmt):
    path = f"{tmp_path}/out.{fmt}"
    tables.write_runs(runs, path, fmt)
    back = tables.read_runs(spark, path)
    assert back.count() == 120 and back.agg({"Buffer_%": "sum"}).first()[0] == runs.agg({"Buffer_%": "sum"}).first()[0]


def test_session_and_models_round_trip(spark, ds, lookup, tmp_path):
    quick = {("regression", "DT"): {"max_depth": [3]}}
    reg = tune.train_regression(ds, ["LR", "KNN", "DT", "MLP", "SVR"], {
        **quick, ("regression", "MLP"): {"max_iter": [5]}, ("regression", "SVR"): {"max_iter": [5]},
        ("regression", "KNN"): {"n_neighbors": [3]}})
    clf = tune.train_classification(ds, ["KNN", "LR", "SVC", "GBC"], {
        ("classification", "LR"): {"C": [1.0]}, ("classification", "KNN"): {"n_neighbors": [3]},
        ("classification", "SVC"): {"max_iter": [5]}, ("classification", "GBC"): {"n_estimators": [2], "max_depth": [2]}})
    session.save_session(spark, session.Session(ds, [reg, clf]), str(tmp_path / "s"))
    back = session.load_session(spark, str(tmp_path / "s"))
    assert back.dataset.labels == ds.labels and back.results[0].best_name() == reg.best_name()
    for old, new in zip((reg, clf), back.results):
        for name in old.models:
            a = old.models[name].predict(old.test).orderBy("run_id").select("prediction").collect()
            b = new.models[name].predict(old.test).orderBy("run_id").select("prediction").collect()
            assert [r[0] for r in a] == pytest.approx([r[0] for r in b])
    loaded = session.load_models(spark, str(tmp_path / "s" / "trained"))
    assert "best_model_regression" in loaded and "model_clf_KNN" in loaded

    prepared, rejected = prepare_compounds(ds.df.select("SMILES"), lookup, ds.solvents)
    assert prepared.count() == 4 and [r[0] for r in rejected.collect()] == ["bad"]
    assert predict_retention(loaded["best_model_regression"], prepared).count() == 4
    assert predict_quality(loaded["model_clf_KNN"], prepared, ds.labels, 0.5).first()["label"] in ds.labels

    lines = report.report_lines(spark, ds, [reg, clf])
    report.write_report(lines, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == lines.count()
    assert len(report.write_results([reg, clf], str(tmp_path / "results"))) == 2


def test_stream_scores_new_files_once(spark, runs, ds, lookup, tmp_path):
    model = qsrr(ds.df, ["MolWt"]).model
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    runs.where("run_id < 50").write.mode("append").parquet(src)
    for _ in range(2):
        scored = score.score_stream(score.stream_runs(spark, src, runs.schema), lookup, model)
        score.run_once(scored.select("run_id", "prediction"), out, state)
        if _ == 0:
            runs.where("run_id >= 50").write.mode("append").parquet(src)
    got = {r["run_id"]: r["prediction"] for r in spark.read.parquet(out).collect()}
    want = {r["run_id"]: r["prediction"] for r in model.predict(ds.df).collect()}
    assert len(got) == 120 and got == pytest.approx(want)


def test_neighbour_stream_and_restart(spark, runs, ds, lookup, tmp_path):
    """Batches equal a prediction of the whole table; a batch that is repeated after a crash replaces its first try."""
    known = ds.df.where("Retention_Time_min IS NOT NULL").withColumn("fold", F.lit(0))
    model = cat.fit("KNN", training_table(known, ds.features, "Retention_Time_min", "regression"), {"n_neighbors": 3})
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    want = {r["run_id"]: r["prediction"] for r in model.predict(ds.df).collect()}

    def go():
        score.run_batches(score.stream_runs(spark, src, runs.schema), lookup, model, ["run_id", "prediction"], out, state)
        return [(r["run_id"], r["prediction"]) for r in spark.read.parquet(out).collect()]

    runs.where("run_id < 50").write.mode("append").parquet(src)
    assert len(go()) == 50 and len(go()) == 50
    runs.where("run_id >= 50").write.mode("append").parquet(src)
    assert len(go()) == 120
    # as if the session had died after the write and before the commit of the last batch
    last = max(int(f.name) for f in (tmp_path / "state" / "commits").iterdir() if f.name.isdigit())
    (tmp_path / "state" / "commits" / str(last)).unlink()
    (tmp_path / "state" / "commits" / f".{last}.crc").unlink(missing_ok=True)
    before = set((tmp_path / "out" / f"batch={last}").iterdir())
    got = go()
    assert len(got) == 120 and dict(got) == pytest.approx(want)
    assert not before & set((tmp_path / "out" / f"batch={last}").glob("part-*"))


def test_quoted_line_break_and_content_keys(spark, tmp_path):
    from chromaspark.sources.tables import read_runs

    (tmp_path / "a.csv").write_text('Compound,SMILES,pH\n"two\nlines",CO,3\nplain,CN,4\nplain,CN,4\n')
    runs = read_runs(spark, str(tmp_path / "a.csv"))
    keys = sorted(r["run_id"] for r in runs.collect())
    assert len(set(keys)) == 3
    assert sorted(r["Compound"] for r in runs.collect()) == ["plain", "plain", "two\nlines"]
    runs.drop("run_id").repartition(3).write.parquet(str(tmp_path / "b.parquet"))
    assert sorted(r["run_id"] for r in read_runs(spark, str(tmp_path / "b.parquet")).collect()) == keys
