"""Results do not depend on partitioning; registry and smoothing contracts."""

import math

import pytest
from pyspark.sql import functions as F

from legflow.operators import clean, derive, encode, model
from legflow.operators.quantiles import wide_quantiles
from legflow.sources import fixtures as fx
from tests.conftest import SF_SMALL


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("n", [1, 3, 17])
def test_repartition_invariance(spark, n):
    legs = fx.legs(spark, SF_SMALL)
    other = legs.repartition(n)
    cols = ["leg_id", "scheduled_rotation_time", "prev_delay_code"]
    base = derive.add_rotation_features(legs.withColumn("delay_code", F.col("delay_code").cast("string")))
    moved = derive.add_rotation_features(other.withColumn("delay_code", F.col("delay_code").cast("string")))
    assert _rows(base, cols) == _rows(moved, cols)
    q1 = _rows(wide_quantiles(legs, ["delay_minutes"], [0.1, 0.5]), ["column", "q", "quantile"])
    q2 = _rows(wide_quantiles(other, ["delay_minutes"], [0.1, 0.5]), ["column", "q", "quantile"])
    assert q1 == q2
    raw = fx.raw_legs(spark, SF_SMALL)
    key = ["flight_number", "origin_airport", "destination_airport", "scheduled_departure_date"]
    d1 = clean.latest_per_key(raw, key, "registered_delay_date")
    d2 = clean.latest_per_key(raw.repartition(n), key, "registered_delay_date")
    assert _rows(d1, ["leg_id", "delay_code"]) == _rows(d2, ["leg_id", "delay_code"])


def test_unknown_model_name_raises(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, label double")
    with pytest.raises(ValueError):
        model.fit_chain(df, "svm", ["a"])


def test_target_mean_smoothing_pulls_to_prior(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 10.0), ("b", 0.0), ("b", 0.0), ("one", 9.0)], "c string, label double")
    m = encode.TargetMeanEncoder(["c"], "label", smoothing=2.0).fit(df)
    got = {r.c0: r.c for r in m.transform(df.withColumn("c0", F.col("c"))).collect()}
    prior, w = 29 / 5, 1 / (1 + math.exp(-(2 - 1) / 2.0))
    assert got["a"] == pytest.approx(prior * (1 - w) + 10 * w) and got["b"] == pytest.approx(prior * (1 - w))
    assert got["one"] == pytest.approx(prior)


def test_dense_key_is_dense_and_ordered(spark):
    df = spark.range(500).withColumn("t", (F.col("id") * 7919) % 500)
    k = clean.with_dense_key(df.repartition(5), ["t", "id"], "rk").orderBy("t", "id").collect()
    assert [r.rk for r in k] == list(range(500))
