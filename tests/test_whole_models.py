"""Registered queries grow every round and tree of the source's models; the rows are the tests' own."""

import numpy as np
import pytest

from legflow.operators import model
from legflow.plans import registry


@pytest.fixture
def made(monkeypatch):
    """(kind, trees) of each ensemble as it is fitted."""
    out = []

    def kept(kind, fit):
        def run(*a, **k):
            out.append((kind, len((m := fit(*a, **k)).trees)))
            return m

        return run

    monkeypatch.setattr(model, "boosted", kept("boosted", model.boosted))
    monkeypatch.setattr(model, "forest", kept("forest", model.forest))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    rows = [(k, int(rng.integers(90)), int(rng.integers(9)), n, float(rng.integers(1, 51)), float(rng.integers(90_000, 10_000_000)) / 100, float(rng.integers(11)) / 100,
             float(rng.integers(9)) / 100, "ARN"[rng.integers(3)], "OF"[rng.integers(2)]) for k in range(150) for n in range(1, 2 + k % 4)]
    at = tmp_path_factory.mktemp("own")
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                                "l_tax double, l_returnflag string, l_linestatus string").selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' as l_shipdate") \
        .coalesce(1).write.parquet(f"{at}/lineitem.parquet")
    return str(at)


def built(spark, name, folder):
    return registry.all_queries()[name][0](spark, folder)


def test_stacking_has_all_rounds(spark, folder, made):
    built(spark, "r12_stacking", folder)
    assert made == [("boosted", 500)]


def test_every_named_model_has_all_rounds_and_trees(spark, folder, made):
    assert built(spark, "r14_every_named_model", folder).count() == 7
    assert made == [("boosted", 500), ("boosted", 500), ("forest", 500), ("boosted", 500)]


def test_gradient_boosting_has_all_rounds(spark, folder, made):
    built(spark, "r5_r10_gb_test_metrics", folder)
    assert made == [("boosted", 500)]


def test_regularised_boosting_has_all_rounds(spark, folder, made):
    built(spark, "r5_r10_xgb_test_metrics", folder)
    assert made == [("boosted", 500)]
