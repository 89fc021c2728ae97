import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def runs(spark):
    """120 runs of six compounds over a small pH x solvent grid, with gaps."""
    rng = np.random.default_rng(7)
    labels = ["Completely separated", "Overlaping", "Partialy separated"]
    rows = []
    for i in range(120):
        org = float(rng.choice([20, 40, 60]))
        rows.append((
            i, f"c{i % 6}", [None, "bad", "CO", "CCO", "CN", "CCN"][i % 6],
            None if i % 17 == 0 else float(np.round(2 + 0.05 * org + rng.normal(0, 0.3), 3)),
            None if i % 11 == 0 else labels[int(rng.integers(3))], org, 100.0 - org,
            "n/a" if i % 13 == 0 else str(float(rng.choice([2.5, 3.0, 7.0]))),
        ))
    return spark.createDataFrame(
        rows, "run_id bigint, Compound string, SMILES string, Retention_Time_min double, "
        "Separation_Quality string, `Buffer_%` double, `Organic_%` double, pH string")


@pytest.fixture(scope="session")
def lookup(spark):
    return spark.createDataFrame(
        [("CO", 32.04, -0.39, 20.2, 1, 1), ("CCO", 46.07, 0.0, 20.2, 1, 1), ("CN", 31.06, -0.4, 26.0, 1, 1),
         ("CCN", 45.08, -0.03, 26.0, 1, 1)],
        "SMILES string, MolWt double, LogP double, TPSA double, HBD int, HBA int")


@pytest.fixture(scope="session")
def ds(runs, lookup):
    from chromaspark.functions.reuse import keep
    from chromaspark.operators.clean import load_dataset
    from chromaspark.operators.descriptors import enrich_descriptors

    d = load_dataset(enrich_descriptors(runs, lookup))
    d.df = keep(d.df)
    return d
