"""Q1..Q16: reference semantics that differ from Spark defaults, on literal frames."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from legflow.functions.nulls import half_even_minutes, keep_unless, to_double
from legflow.operators import clean, derive, report


def test_q1_drop_keeps_undefined(spark):
    df = spark.createDataFrame([(1,), (None,), (5,)], "x int")
    kept = df.where(keep_unless(F.col("x") > 2)).collect()
    assert sorted([r.x for r in kept], key=lambda v: (v is None, v)) == [1, None]


def test_q2_half_even_minutes(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0, t0 + dt.timedelta(seconds=s)) for s in (30, 90, 150, 45)]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(half_even_minutes("a", "b")).collect()]
    assert got == [0, 2, 2, 1]


def test_q3_null_key_has_no_predecessor(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, "T1", t0, t0 + dt.timedelta(hours=1), "5"), (2, "T1", t0 + dt.timedelta(hours=3), t0 + dt.timedelta(hours=4), "7"),
            (3, None, t0 + dt.timedelta(hours=5), t0 + dt.timedelta(hours=6), "9")]
    df = spark.createDataFrame(rows, "leg_id long, tail_number string, scheduled_departure_date timestamp_ntz, "
                                     "scheduled_arrival_date timestamp_ntz, delay_code string")
    out = {r.leg_id: r for r in derive.add_rotation_features(df).collect()}
    assert out[1].scheduled_rotation_time == 0.0 and out[1].prev_delay_code == "no_delay"
    assert out[2].scheduled_rotation_time == 120.0 and out[2].prev_delay_code == "5"
    assert out[3].scheduled_rotation_time == 0.0 and out[3].prev_delay_code == "no_delay"
    dropped = derive.add_scheduled_rotation_time(df, drop_null_keys=True)
    assert dropped.count() == 2


def test_q5_distinct_counts_null(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",), ("b",)], "c string")
    prof = report.column_profile(df).collect()[0]
    assert prof.n_distinct == 3 and prof.n_non_null == 3


def test_q6_population_deviation(spark):
    from legflow.operators.encode import StandardScaler

    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    m = StandardScaler(["x"]).fit(df)
    assert m.scale["x"] == pytest.approx(np.std([1, 2, 3, 4]))


def test_q7_linear_quantiles(spark):
    from legflow.operators.quantiles import wide_quantiles

    vals = [1.0, 2.0, 2.0, 7.0, 10.0, 11.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = {r.q: r.quantile for r in wide_quantiles(df, ["x"], [0.25, 0.5, 0.75, 0.9]).collect()}
    for q, v in got.items():
        assert v == pytest.approx(np.quantile(vals, q))


def test_q9_bad_text_is_null(spark):
    df = spark.createDataFrame([("1.5",), ("M",), ("T",), ("NaN",), (None,)], "x string")
    got = [r[0] for r in df.select(to_double("x")).collect()]
    assert got == [1.5, None, None, None, None]
    ts = spark.createDataFrame([("2024-01-01 10:00:00",), ("garbage",)], "x string")
    out = clean.coerce_timestamps(ts, ["x"]).collect()
    assert out[0].x == dt.datetime(2024, 1, 1, 10) and out[1].x is None


def test_q11_weekday_monday_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "flight_date timestamp_ntz")  # a Monday
    rows = {(r.part, r.value): r.n for r in report.time_distribution(df).collect()}
    assert rows[("weekday", 0)] == 1


def test_q12_truncating_int(spark):
    df = spark.createDataFrame([(7.9, "3")], "delay_code double, delay_sub_code string")
    assert derive.rebuild_delay_codes(df).collect()[0].delay_code == "73"


def test_q15_masks_are_key_functions(spark):
    from legflow.operators.impute import inject_nulls

    df = spark.range(2000).withColumn("x", F.lit(1.0))
    a = inject_nulls(df, ["x"], 0.3, "id", seed=1).where("x IS NULL").select("id")
    b = inject_nulls(df.repartition(7), ["x"], 0.3, "id", seed=1).where("x IS NULL").select("id")
    assert sorted(r.id for r in a.collect()) == sorted(r.id for r in b.collect())
    assert 450 < a.count() < 750


def test_q16_segments(spark):
    df = spark.createDataFrame([(359,), (360,), (30,), (179,), (180,)], "actual_block_time int")
    assert clean.duration_segment(df, "NB").count() == 4
    assert clean.duration_segment(df, "wb").count() == 1
    segs = {r.segment for r in report.haul_segment_fleets(df.withColumn("fleet", F.lit("NB"))).collect()}
    assert segs == {"30min-3h", "3-6h", "> 6h"}


def test_t14_compass(spark):
    df = spark.createDataFrame([(0.0,), (11.0,), (11.25,), (348.75,), (359.0,), (None,)], "d double")
    got = [r[0] for r in df.select(derive.compass_point("d")).collect()]
    assert got == ["N", "N", "N", "NNW", "N", None]  # the 0.02 shift keeps exact boundaries in the lower point


def test_c2_rules_in_order(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("A", "A", t, t, t, t, "J"), ("A", "B", t, None, t, t, "K"), ("A", "B", t, t, t + dt.timedelta(hours=1), t, "J")]
    df = spark.createDataFrame(rows, "origin_airport string, destination_airport string, off_block_date timestamp_ntz, "
                                     "take_off_date timestamp_ntz, landing_date timestamp_ntz, on_block_date timestamp_ntz, "
                                     "service_type string")
    rep = {r.rule: r.n_rows for r in clean.malformed_report(df).collect()}
    assert rep == {"same_endpoints": 1, "no_take_off": 1, "landing_after_on_block": 1}
