"""Queries run at the reference's parameters."""

import inspect

from ledgerlark import catalog
from ledgerlark.operators import anomaly, models

D = "/root/testdata/sf0.001"


def test_monte_carlo_simulates_a_year(spark, monkeypatch):
    asked, made = [], models.monte_carlo
    monkeypatch.setattr(models, "monte_carlo", lambda stats, **k: asked.append(inspect.signature(made).bind(stats, **k)) or stats)
    catalog.QUERIES["f14_monte_carlo"](spark, D)
    asked[0].apply_defaults()
    assert (asked[0].arguments["paths"], asked[0].arguments["days"]) == (10_000, 252)


def test_isolation_forest_grows_200_trees(spark, monkeypatch):
    asked, made = [], anomaly.isolation_forest
    monkeypatch.setattr(anomaly, "isolation_forest", lambda *a, **k: asked.append(inspect.signature(made).bind(*a, **k)) or a[0])
    catalog.QUERIES["f20_isolation_forest"](spark, D)
    asked[0].apply_defaults()
    assert asked[0].arguments["trees"] == 200


def test_training_windows_of_the_reference(spark):
    assert catalog.QUERIES["w32_training_windows_96_24"](spark, D).limit(1).count() == 1
