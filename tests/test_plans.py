"""Plan shape: pushdown, pruning, partitioning keys of the skew-safe operators."""

from pyspark.sql import functions as F

from legflow.operators import clean, enrich
from legflow.sources import fixtures as fx
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_calendar_filter_reaches_the_scan(spark):
    legs = fx.legs(spark, SF_SMALL)
    p = _plan(clean.in_calendar_period(legs, "scheduled_departure_date", 2024, 1, 17).select("leg_id"))
    assert "PushedFilters: [IsNotNull(scheduled_departure_date), GreaterThanOrEqual(scheduled_departure_date" in p
    assert "ReadSchema: struct<leg_id:bigint,scheduled_departure_date:timestamp_ntz>" in p


def test_nearest_join_shuffles_by_station_day_bucket(spark):
    legs, wx, codes = fx.legs(spark, SF_SMALL), fx.weather_obs(spark, SF_SMALL), fx.airport_codes(spark, SF_SMALL)
    p = _plan(enrich.enrich_both_ends(legs, wx, codes))
    assert "hashpartitioning(__k" in p and "__day" in p and "__bkt" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_latest_record_is_an_aggregation_not_a_window(spark):
    raw = fx.raw_legs(spark, SF_SMALL)
    p = _plan(clean.latest_per_key(raw, ["flight_number", "origin_airport", "destination_airport",
                                         "scheduled_departure_date"], "registered_delay_date"))
    assert "Window" not in p and "partial_max" in p


def test_hot_station_result_matches_even_split(spark):
    """One station holding most observations and legs: same answer at any bucket width."""
    legs = fx.legs(spark, SF_SMALL).withColumn("st", F.lit("S1"))
    wx = fx.weather_obs(spark, SF_SMALL).withColumn("station", F.lit("S1"))
    a = enrich.nearest_observation(legs, wx, "st", "off_block_date", "w_", ["wind_speed"], bucket_minutes=60)
    b = enrich.nearest_observation(legs, wx, "st", "off_block_date", "w_", ["wind_speed"], bucket_minutes=1440)
    cols = ["leg_id", "w_wind_speed"]
    assert a.select(*cols).exceptAll(b.select(*cols)).count() == 0
