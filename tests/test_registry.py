"""What the registered queries hand to the operators."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from chromaspark.models import tune
from chromaspark.plans import registry


@pytest.mark.parametrize("name", ["tsne_2d", "tsne_3d", "umap_2d", "umap_3d"])
def test_layouts_run_all_their_epochs(monkeypatch, name):
    asked = []

    def layout(df, features, dims, **options):
        asked.append((dims, options))
        return SimpleNamespace(points=lambda df: df)

    monkeypatch.setattr(registry, "dataset", lambda spark, sf: SimpleNamespace(df=None, features=[]))
    monkeypatch.setattr(registry.embed, name[:4], layout)
    registry.queries()[name](None, None)
    assert asked == [(int(name[5]), {})]


@pytest.mark.parametrize("name, default", [("train_regression", tune.DEFAULT_REGRESSION), ("train_classification", tune.DEFAULT_CLASSIFICATION)])
def test_training_queries_hold_the_default_models(monkeypatch, name, default):
    asked = []
    monkeypatch.setattr(registry, "dataset", lambda spark, sf: None)
    monkeypatch.setattr(registry.tune, name, lambda ds, models=None: asked.append(models or default) or SimpleNamespace(metrics=None))
    registry.queries()[name](SimpleNamespace(sparkContext=SimpleNamespace(applicationId="test")), name)
    assert set(default) <= set(asked[0]) and len(asked[0]) == len(set(asked[0]))
