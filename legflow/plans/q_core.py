"""Checked queries: sources, projections, filters, dedupe, joins, derived attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from legflow.functions.nulls import is_numeric_text
from legflow.operators import clean, derive, enrich
from legflow.plans import build
from legflow.plans.catalog import (
    MALFORMED_SQL, REPAIRED_CTE, enriched_cte, hm, not_true, register, rotation_cols, targets_cte, wellformed_where,
)
from legflow.sources import fixtures as fx


def r6(c):
    return F.round(c, 6)


def repaired(spark, sf):
    return build.repair_legs(fx.raw_legs(spark, sf))


def enriched(spark, sf):
    """Repaired legs, enriched at both ends, numeric weather typed (section 3.1)."""
    return build.build_dataset(fx.raw_legs(spark, sf), fx.weather_obs(spark, sf), fx.airport_codes(spark, sf))


# ------------------------------------------------------------------ flagship

FLAGSHIP_SQL = "WITH " + REPAIRED_CTE + "," + f"""
good AS (SELECT * FROM repaired WHERE {wellformed_where()}),
""" + targets_cte("good", "tg") + "," + enriched_cte("tg", "en") + f""",
rot AS (SELECT *, {rotation_cols()},
               CASE WHEN {hm('scheduled_departure_date', 'off_block_date')} IS NULL THEN NULL
                    ELSE greatest({hm('scheduled_departure_date', 'off_block_date')}, 0) END AS departure_delay
        FROM en)
SELECT origin_airport, CAST(hour(scheduled_departure_date) AS INTEGER) AS dep_hour,
       count(*) AS n_legs,
       round(avg(taxi_out), 6) AS avg_taxi_out,
       round(avg(departure_delay), 6) AS avg_departure_delay,
       round(avg(scheduled_rotation_time), 6) AS avg_rotation,
       count(origin_wind_speed) AS n_with_weather,
       round(avg(origin_wind_speed), 6) AS avg_origin_wind_speed
FROM rot GROUP BY origin_airport, hour(scheduled_departure_date)
"""


@register("flagship_taxi_out_by_origin_hour", FLAGSHIP_SQL)
def flagship(spark, sf):
    """Average taxi-out and delay by origin and hour on repaired, enriched legs."""
    legs = repaired(spark, sf)
    legs = clean.remove_malformed(legs)
    legs = derive.add_targets(legs)
    legs = enrich.enrich_both_ends(legs, fx.weather_obs(spark, sf), fx.airport_codes(spark, sf))
    legs = clean.coerce_numeric(legs, build.weather_numeric_columns(legs))
    legs = derive.add_scheduled_rotation_time(legs).transform(derive.add_departure_delay)
    return (legs.groupBy("origin_airport", F.hour("scheduled_departure_date").alias("dep_hour"))
            .agg(F.count(F.lit(1)).alias("n_legs"),
                 r6(F.avg("taxi_out")).alias("avg_taxi_out"),
                 r6(F.avg("departure_delay")).alias("avg_departure_delay"),
                 r6(F.avg("scheduled_rotation_time")).alias("avg_rotation"),
                 F.count("origin_wind_speed").alias("n_with_weather"),
                 r6(F.avg("origin_wind_speed")).alias("avg_origin_wind_speed")))


# ------------------------------------------------------------------ J: joins

@register("j1_code_lookup", """
WITH codes AS (SELECT iata, min(icao) AS icao FROM airport_codes WHERE iata IS NOT NULL AND icao IS NOT NULL GROUP BY iata)
SELECT l.leg_id, l.origin_airport, coalesce(c.icao, '') AS origin_station
FROM legs l LEFT JOIN codes c ON l.origin_airport = c.iata
""")
def j1(spark, sf):
    x = enrich.code_lookup(fx.legs(spark, sf), fx.airport_codes(spark, sf), "origin_airport", "origin_station")
    return x.select("leg_id", "origin_airport", "origin_station")


_J3_COLS = ["leg_id", "origin_air_temperature", "origin_wind_direction", "origin_wind_speed",
            "origin_visibility", "origin_cloud_coverage_lvl_1", "origin_cloud_height_lvl_1", "origin_wind_gust",
            "destination_air_temperature", "destination_wind_speed", "destination_cloud_coverage_lvl_3",
            "destination_visibility"]


@register("j3_enrich_both_ends", "WITH " + enriched_cte("legs", "en", numeric=False)
          + f"SELECT {', '.join(_J3_COLS)} FROM en")
def j3(spark, sf):
    x = enrich.enrich_both_ends(fx.legs(spark, sf), fx.weather_obs(spark, sf), fx.airport_codes(spark, sf))
    return x.select(*_J3_COLS)


@register("j2_nearest_observation_counts", "WITH " + enriched_cte("legs", "en", numeric=False) + """
SELECT origin_cloud_coverage_lvl_1 AS cover, count(*) AS n_legs,
       count(origin_wind_speed) AS n_matched
FROM en GROUP BY origin_cloud_coverage_lvl_1
""")
def j2(spark, sf):
    x = enrich.code_lookup(fx.legs(spark, sf), fx.airport_codes(spark, sf), "origin_airport", "st")
    x = enrich.nearest_observation(x, fx.weather_obs(spark, sf), "st", "off_block_date", "origin_")
    return x.groupBy(F.col("origin_cloud_coverage_lvl_1").alias("cover")).agg(
        F.count(F.lit(1)).alias("n_legs"), F.count("origin_wind_speed").alias("n_matched"))


@register("j5_membership_split", """
SELECT CASE WHEN leg_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'in' ELSE 'out' END AS side,
       count(*) AS n_rows
FROM legs GROUP BY 1
""")
def j5(spark, sf):
    held = fx.read_table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("leg_id"))
    inside, outside = enrich.split_by_keys(fx.legs(spark, sf), held)
    return (inside.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("side", F.lit("in"))
            .unionByName(outside.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("side", F.lit("out"))))


@register("j6_scatter_update", """
SELECT l.leg_id, CASE WHEN u.leg_id IS NOT NULL THEN u.delay_minutes ELSE l.delay_minutes END AS delay_minutes
FROM legs l LEFT JOIN (SELECT leg_id, CASE WHEN leg_id % 2 = 0 THEN NULL ELSE -1.0 END AS delay_minutes
                       FROM legs WHERE leg_id % 7 = 3) u ON l.leg_id = u.leg_id
""")
def j6(spark, sf):
    legs = fx.legs(spark, sf)
    upd = legs.where("leg_id % 7 = 3").selectExpr(
        "leg_id", "CASE WHEN leg_id % 2 = 0 THEN CAST(NULL AS DOUBLE) ELSE -1.0 END AS delay_minutes")
    return enrich.scatter_update(legs, upd, "leg_id", ["delay_minutes"]).select("leg_id", "delay_minutes")


@register("j7_fill_missing_from", """
SELECT l.leg_id, coalesce(l.delay_minutes, p.pred) AS delay_minutes
FROM legs l LEFT JOIN (SELECT leg_id, CAST(leg_id % 13 AS DOUBLE) AS pred FROM legs WHERE leg_id % 3 <> 0) p
  ON l.leg_id = p.leg_id
""")
def j7(spark, sf):
    legs = fx.legs(spark, sf)
    pred = legs.where("leg_id % 3 <> 0").selectExpr("leg_id", "CAST(leg_id % 13 AS DOUBLE) AS delay_minutes")
    return enrich.fill_missing_from(legs, pred, "leg_id", ["delay_minutes"]).select("leg_id", "delay_minutes")


@register("j4_rejoin_columns", """
SELECT a.leg_id, a.tail_number, b.taxi_out
FROM legs a JOIN (SELECT leg_id, CAST(""" + hm("off_block_date", "take_off_date") + """ AS DOUBLE) AS taxi_out FROM legs) b
  ON a.leg_id = b.leg_id
""")
def j4(spark, sf):
    legs = fx.legs(spark, sf)
    a = legs.select("leg_id", "tail_number")
    b = legs.select("leg_id", derive.minutes("off_block_date", "take_off_date").cast("double").alias("taxi_out"))
    return enrich.rejoin_columns(a, b)


# ------------------------------------------------------------------ D: dedupe

@register("d1_exact_duplicates", "SELECT count(*) AS n_rows FROM (SELECT DISTINCT * FROM raw_legs)")
def d1(spark, sf):
    return clean.drop_exact_duplicates(fx.raw_legs(spark, sf)).agg(F.count(F.lit(1)).alias("n_rows"))


@register("d2_latest_per_flight", "WITH " + REPAIRED_CTE + """
SELECT leg_id, CAST(delay_code AS DOUBLE) AS delay_code, registered_delay_date FROM repaired
""")
def d2(spark, sf):
    return repaired(spark, sf).select("leg_id", F.col("delay_code").cast("double").alias("delay_code"),
                                      "registered_delay_date")


@register("d2_latest_lineitem", """
SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
            ORDER BY l_shipdate DESC NULLS LAST, l_partkey DESC, l_suppkey DESC, l_quantity DESC,
                     l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rn
  FROM lineitem) WHERE rn = 1
""")
def d2_lineitem(spark, sf):
    li = fx.read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return clean.latest_per_key(li, ["l_orderkey", "l_linenumber"], "l_shipdate").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")


@register("d3_distinct_airports", """
SELECT DISTINCT value FROM (SELECT origin_airport AS value FROM legs UNION ALL SELECT destination_airport FROM legs)
""")
def d3(spark, sf):
    return clean.distinct_values(fx.legs(spark, sf), ["origin_airport", "destination_airport"])


@register("d6_top_tails", """
SELECT tail_number, count(*) AS n_legs FROM legs WHERE tail_number IS NOT NULL
GROUP BY tail_number ORDER BY n_legs DESC, tail_number LIMIT 5
""")
def d6(spark, sf):
    counts = fx.legs(spark, sf).where("tail_number IS NOT NULL").groupBy("tail_number").agg(
        F.count(F.lit(1)).alias("n_legs"))
    return clean.top_k(counts, "n_legs", 5, ["tail_number"])


# ------------------------------------------------------------------ P: projections

_WX_NUM = ["air_temperature", "wind_direction", "wind_speed", "visibility", "cloud_height_lvl_1", "wind_gust"]


@register("p6_coerce_numeric", "SELECT feed_seq, " + ", ".join(
    f"CASE WHEN isnan(TRY_CAST({c} AS DOUBLE)) THEN NULL ELSE TRY_CAST({c} AS DOUBLE) END AS {c}" for c in _WX_NUM)
    + " FROM weather_obs")
def p6(spark, sf):
    return clean.coerce_numeric(fx.weather_obs(spark, sf), _WX_NUM).select("feed_seq", *_WX_NUM)


@register("p7_coerce_timestamps", """
SELECT leg_id, TRY_CAST(CASE WHEN leg_id % 13 = 0 THEN 'not a time' ELSE strftime(off_block_date, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS off_block_date
FROM legs
""")
def p7(spark, sf):
    x = fx.legs(spark, sf).selectExpr(
        "leg_id", "CASE WHEN leg_id % 13 = 0 THEN 'not a time' "
        "ELSE date_format(off_block_date, 'yyyy-MM-dd HH:mm:ss') END AS off_block_date")
    return clean.coerce_timestamps(x, ["off_block_date"])


@register("p9_numeric_text_flags", """
SELECT TRY_CAST(visibility AS DOUBLE) IS NOT NULL AS is_number, count(*) AS n_rows FROM weather_obs GROUP BY 1
""")
def p9(spark, sf):
    return fx.weather_obs(spark, sf).groupBy(is_numeric_text("visibility").alias("is_number")).agg(
        F.count(F.lit(1)).alias("n_rows"))


@register("p8_code_text", """
SELECT leg_id, CAST(CAST(TRY_CAST(flight_number AS DOUBLE) AS INTEGER) AS VARCHAR) AS flight_number,
       CAST(hour(scheduled_departure_date) >= 21 OR hour(scheduled_departure_date) <= 3 AS INTEGER) AS is_night
FROM legs
""")
def p8(spark, sf):
    x = derive.add_is_night(fx.legs(spark, sf)).withColumn("flight_number", F.col("flight_number").cast("double"))
    x = clean.number_to_code_text(x, ["flight_number"])
    return clean.flag_to_int(x, ["is_night"]).select("leg_id", "flight_number", "is_night")


@register("p10_target_projection_taxi_out_nb", "WITH " + targets_cte("legs", "tg") + """
SELECT leg_id, CAST(taxi_out AS DOUBLE) AS label, origin_airport FROM tg WHERE actual_block_time < 360
""")
def p10(spark, sf):
    x = derive.add_targets(fx.legs(spark, sf))
    x = clean.prepare_for_target(x, "taxi_out", "nb")
    assert "taxi_in" not in x.columns and "air_time" not in x.columns
    return x.select("leg_id", F.col("label").cast("double").alias("label"), "origin_airport")


_SPARSE_SRC = ["feed_seq", "station", "air_temperature", "wind_gust", "cloud_coverage_lvl_1",
               "cloud_coverage_lvl_2", "cloud_coverage_lvl_3"]


@register("p11_drop_sparse_columns", """
SELECT feed_seq, station, CASE WHEN isnan(TRY_CAST(air_temperature AS DOUBLE)) THEN NULL ELSE TRY_CAST(air_temperature AS DOUBLE) END AS air_temperature,
       CASE WHEN cloud_coverage_lvl_1 IN ('M', '///') THEN NULL ELSE cloud_coverage_lvl_1 END AS cloud_coverage_lvl_1,
       CASE WHEN cloud_coverage_lvl_2 IN ('M', '///') THEN NULL ELSE cloud_coverage_lvl_2 END AS cloud_coverage_lvl_2
FROM weather_obs
""")
def p11(spark, sf):
    x = fx.weather_obs(spark, sf).select(*_SPARSE_SRC)
    x = clean.coerce_numeric(x, ["air_temperature", "wind_gust"])
    x = clean.sentinel_to_null(x, ["cloud_coverage_lvl_1", "cloud_coverage_lvl_2", "cloud_coverage_lvl_3"])
    return clean.drop_sparse_columns(x, 0.7)


@register("p13_dense_key", """
SELECT CAST(row_number() OVER (ORDER BY scheduled_departure_date, leg_id) - 1 AS BIGINT) AS row_key,
       * REPLACE (CAST(delay_code AS VARCHAR) AS delay_code) FROM legs
""")
def p13(spark, sf):
    legs = fx.legs(spark, sf).withColumn("delay_code", F.col("delay_code").cast("string"))
    return clean.with_dense_key(legs, ["scheduled_departure_date", "leg_id"], "row_key")


# ------------------------------------------------------------------ C: filters

@register("c1_keep_delayed", "SELECT count(*) AS n_delayed FROM legs WHERE delay_code IS NOT NULL")
def c1(spark, sf):
    return clean.keep_delayed(fx.legs(spark, sf)).agg(F.count(F.lit(1)).alias("n_delayed"))


@register("c2_malformed_report", "SELECT rule, count(*) AS n_rows FROM (SELECT CASE " + " ".join(
    f"WHEN coalesce(({c}), false) THEN '{n}'" for n, c in MALFORMED_SQL) + " ELSE 'kept' END AS rule FROM legs) GROUP BY rule")
def c2_report(spark, sf):
    return clean.malformed_report(fx.legs(spark, sf))


@register("c2_remove_malformed", f"SELECT leg_id FROM legs WHERE {wellformed_where()}")
def c2_remove(spark, sf):
    return clean.remove_malformed(fx.legs(spark, sf)).select("leg_id")


@register("c3_null_audit", "UNPIVOT (SELECT " + ", ".join(
    f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in
    ["take_off_date", "landing_date", "off_block_date", "on_block_date"]) + " FROM legs) ON COLUMNS(*) INTO NAME column_name VALUE n_null")
def c3(spark, sf):
    return clean.null_audit(fx.legs(spark, sf), ["take_off_date", "landing_date", "off_block_date", "on_block_date"]) \
        .withColumnRenamed("column", "column_name")


@register("c4_service_and_vehicle_filters", f"""
SELECT 'no_vehicles' AS filter, count(*) AS n_rows FROM legs WHERE {not_true("aircraft_model = 'Surface Vehicle'")}
UNION ALL SELECT 'scheduled_only', count(*) FROM legs WHERE service_type = 'J'
""")
def c4(spark, sf):
    legs = fx.legs(spark, sf)
    a = clean.drop_where_equal(legs, "aircraft_model", "Surface Vehicle").agg(F.count(F.lit(1)).alias("n_rows"))
    b = clean.keep_where_equal(legs, "service_type", "J").agg(F.count(F.lit(1)).alias("n_rows"))
    return a.withColumn("filter", F.lit("no_vehicles")).unionByName(b.withColumn("filter", F.lit("scheduled_only")))


@register("c5_weather_outlier_removal", "WITH " + REPAIRED_CTE + "," + enriched_cte("repaired", "en") + f"""
SELECT leg_id FROM en
WHERE {not_true('origin_wind_speed >= 30')} AND {not_true('destination_wind_speed >= 30')}
  AND {not_true('origin_cloud_height_lvl_1 >= 10000 OR origin_cloud_height_lvl_1 = 0')}
  AND {not_true('destination_cloud_height_lvl_1 >= 10000 OR destination_cloud_height_lvl_1 = 0')}
  AND {not_true('destination_visibility >= 100 OR destination_visibility = 0')}
""")
def c5(spark, sf):
    x = clean.rename_columns(enriched(spark, sf), {"origin_cloud_height_lvl_1": "origin_cloud_height",
                                                   "destination_cloud_height_lvl_1": "destination_cloud_height"})
    return clean.weather_outlier_removal(x).select("leg_id")


@register("c6_drop_incomplete", "SELECT count(*) AS n_complete FROM legs WHERE tail_number IS NOT NULL AND fleet IS NOT NULL "
          "AND take_off_date IS NOT NULL AND landing_date IS NOT NULL AND delay_code IS NOT NULL "
          "AND delay_sub_code IS NOT NULL AND delay_minutes IS NOT NULL")
def c6(spark, sf):
    return clean.drop_incomplete(fx.legs(spark, sf)).agg(F.count(F.lit(1)).alias("n_complete"))


@register("c7_duration_segments", "WITH " + targets_cte("legs", "tg") + """
SELECT 'nb' AS segment, count(*) AS n_legs FROM tg WHERE actual_block_time < 360
UNION ALL SELECT 'wb', count(*) FROM tg WHERE actual_block_time >= 360
UNION ALL SELECT 'whole', count(*) FROM tg
""")
def c7(spark, sf):
    t = derive.add_targets(fx.legs(spark, sf))
    parts = [clean.duration_segment(t, s).agg(F.count(F.lit(1)).alias("n_legs")).withColumn("segment", F.lit(s))
             for s in ("nb", "wb", "whole")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("c8_nonzero_labels", "WITH " + targets_cte("legs", "tg") + " SELECT count(*) AS n_rows FROM tg WHERE taxi_in <> 0")
def c8(spark, sf):
    t = derive.add_targets(fx.legs(spark, sf)).withColumnRenamed("taxi_in", "label")
    return clean.nonzero_labels(t).agg(F.count(F.lit(1)).alias("n_rows"))


@register("c9_calendar_period", """
SELECT leg_id FROM legs WHERE scheduled_departure_date >= TIMESTAMP '2024-01-17 00:00:00'
                          AND scheduled_departure_date < TIMESTAMP '2024-01-18 00:00:00'
""")
def c9(spark, sf):
    return clean.in_calendar_period(fx.legs(spark, sf), "scheduled_departure_date", 2024, 1, 17).select("leg_id")


@register("c10_complete_numeric_rows", "SELECT count(*) AS n_rows FROM (SELECT " + ", ".join(
    f"CASE WHEN isnan(TRY_CAST({c} AS DOUBLE)) THEN NULL ELSE TRY_CAST({c} AS DOUBLE) END AS {c}" for c in _WX_NUM)
    + " FROM weather_obs) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _WX_NUM))
def c10(spark, sf):
    x = clean.coerce_numeric(fx.weather_obs(spark, sf), _WX_NUM).select(*_WX_NUM)
    return clean.complete_numeric_rows(x).agg(F.count(F.lit(1)).alias("n_rows"))


@register("c11_sky_cover_sentinels", """
SELECT CASE WHEN cloud_coverage_lvl_1 IN ('M', '///') THEN NULL ELSE cloud_coverage_lvl_1 END AS cover, count(*) AS n_rows
FROM weather_obs GROUP BY 1
""")
def c11(spark, sf):
    x = clean.sentinel_to_null(fx.weather_obs(spark, sf), ["cloud_coverage_lvl_1"])
    return x.groupBy(F.col("cloud_coverage_lvl_1").alias("cover")).agg(F.count(F.lit(1)).alias("n_rows"))


@register("c12_regroup_fleet", """
SELECT CASE WHEN aircraft_type_code IN ('772', '763', '744', '342', '313', '345') THEN 'WB'
            WHEN aircraft_type_code IN ('M83', '738', '752', '737', '757', '734', 'BEH', 'ER4', '100', 'AT4') THEN 'NB'
            WHEN fleet IN ('PGA', 'WI') THEN 'NB' ELSE fleet END AS fleet, count(*) AS n_legs
FROM legs GROUP BY 1
""")
def c12(spark, sf):
    return clean.regroup_fleet(fx.legs(spark, sf)).groupBy("fleet").agg(F.count(F.lit(1)).alias("n_legs"))


# ------------------------------------------------------------------ T: derived attributes

@register("t1_t9_targets", "WITH " + targets_cte("legs", "tg") + f"""
SELECT leg_id, CAST(air_time AS DOUBLE) AS air_time, CAST(taxi_out AS DOUBLE) AS taxi_out,
       CAST(taxi_in AS DOUBLE) AS taxi_in, CAST(actual_block_time AS DOUBLE) AS actual_block_time,
       CAST({hm('scheduled_departure_date', 'scheduled_arrival_date')} AS DOUBLE) AS scheduled_block_time,
       CAST(CASE WHEN {hm('scheduled_departure_date', 'off_block_date')} IS NULL THEN NULL
            ELSE greatest({hm('scheduled_departure_date', 'off_block_date')}, 0) END AS DOUBLE) AS departure_delay,
       CAST(CASE WHEN {hm('scheduled_arrival_date', 'on_block_date')} IS NULL THEN NULL
            ELSE greatest({hm('scheduled_arrival_date', 'on_block_date')}, 0) END AS DOUBLE) AS arrival_delay
FROM tg WHERE {not_true('scheduled_arrival_date <= scheduled_departure_date')}
""")
def t1_t9(spark, sf):
    x = derive.add_targets(fx.legs(spark, sf)).transform(derive.add_scheduled_block_time)
    x = x.transform(derive.add_departure_delay).transform(derive.add_arrival_delay)
    cols = ["air_time", "taxi_out", "taxi_in", "actual_block_time", "scheduled_block_time", "departure_delay",
            "arrival_delay"]
    return x.select("leg_id", *[F.col(c).cast("double").alias(c) for c in cols])


@register("t10_is_night", """
SELECT (hour(scheduled_departure_date) >= 21 OR hour(scheduled_departure_date) <= 3) AS is_night, count(*) AS n_legs
FROM legs GROUP BY 1
""")
def t10(spark, sf):
    return derive.add_is_night(fx.legs(spark, sf)).groupBy("is_night").agg(F.count(F.lit(1)).alias("n_legs"))


@register("t11_t12_date_parts_round_trip", """
SELECT leg_id, CAST(year(scheduled_departure_date) AS INTEGER) AS scheduled_departure_date_year,
       CAST(month(scheduled_departure_date) AS INTEGER) AS scheduled_departure_date_month,
       CAST(day(scheduled_departure_date) AS INTEGER) AS scheduled_departure_date_day,
       CAST(hour(scheduled_departure_date) AS INTEGER) AS scheduled_departure_date_hour,
       CAST(minute(scheduled_departure_date) AS INTEGER) AS scheduled_departure_date_minute,
       CAST(year(scheduled_arrival_date) AS INTEGER) AS day_only_year,
       date_trunc('minute', off_block_date) AS off_block_date
FROM legs
""")
def t11_t12(spark, sf):
    x = fx.legs(spark, sf).select("leg_id", "scheduled_departure_date", "off_block_date",
                                  F.date_trunc("DAY", "scheduled_arrival_date").alias("day_only"))
    parts = derive.decompose_dates(x, ["scheduled_departure_date", "off_block_date", "day_only"])
    assert "day_only_hour" not in parts.columns and "off_block_date_minute" in parts.columns
    back = derive.reconstruct_dates(parts, ["off_block_date"])
    return back.drop("day_only_month", "day_only_day")


@register("t13_remove_decomposed", "SELECT leg_id, tail_number FROM legs")
def t13(spark, sf):
    x = fx.legs(spark, sf).select("leg_id", "tail_number", "off_block_date", "landing_date")
    parts = derive.decompose_dates(x, ["off_block_date", "landing_date"], with_time={"off_block_date": True,
                                                                                      "landing_date": True})
    return derive.remove_decomposed_dates(parts, ["off_block_date", "landing_date"])


_DIRS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]


@register("t14_compass_points", """
SELECT CASE WHEN d IS NULL THEN NULL ELSE list_extract(['""" + "','".join(_DIRS) + """'],
         CAST(((CAST(trunc((d + 11.25) / 22.5 - 0.02) AS INTEGER) % 16) + 16) % 16 + 1 AS INTEGER)) END AS point,
       count(*) AS n_rows
FROM (SELECT CASE WHEN isnan(TRY_CAST(wind_direction AS DOUBLE)) THEN NULL ELSE TRY_CAST(wind_direction AS DOUBLE) END AS d FROM weather_obs)
GROUP BY 1
""")
def t14(spark, sf):
    x = clean.coerce_numeric(fx.weather_obs(spark, sf), ["wind_direction"])
    return x.groupBy(derive.compass_point("wind_direction").alias("point")).agg(F.count(F.lit(1)).alias("n_rows"))


@register("t15_delay_codes", """
SELECT CASE WHEN delay_code IS NULL AND delay_sub_code IS NULL THEN '0'
            WHEN delay_code IS NOT NULL AND delay_sub_code IS NOT NULL THEN
                 CASE WHEN delay_sub_code <> '0' THEN CAST(delay_code AS VARCHAR) || delay_sub_code ELSE CAST(delay_code AS VARCHAR) END
            WHEN delay_code IS NOT NULL THEN CAST(delay_code AS VARCHAR) END AS delay_code,
       count(*) AS n_legs
FROM legs GROUP BY 1
""")
def t15(spark, sf):
    x = derive.rebuild_delay_codes(fx.legs(spark, sf))
    assert "delay_sub_code" not in x.columns
    return x.groupBy("delay_code").agg(F.count(F.lit(1)).alias("n_legs"))


@register("t16_t17_min_max_round_trip", """
SELECT l_orderkey, l_linenumber,
       round((l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()), 6) AS q_norm,
       round(l_extendedprice, 6) AS price_back
FROM lineitem
""")
def t16_t17(spark, sf):
    li = fx.read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    bounds = derive.min_max_bounds(li, ["l_quantity", "l_extendedprice"]).first().asDict()
    n = derive.normalise(li, ["l_quantity", "l_extendedprice"], bounds)
    back = derive.revert_normalisation(n, ["l_extendedprice"], bounds)
    return back.select("l_orderkey", "l_linenumber", r6(F.col("l_quantity")).alias("q_norm"),
                       r6(F.col("l_extendedprice")).alias("price_back"))


@register("t18_errors", """
SELECT l_orderkey, l_linenumber,
       round(abs(l_extendedprice - l_quantity * 1000) / abs(l_extendedprice) * 100, 6) AS pct_error,
       round(abs(l_extendedprice - l_quantity * 1000), 6) AS abs_error
FROM lineitem
""")
def t18(spark, sf):
    li = fx.read_table(spark, sf, "lineitem").withColumn("pred", F.col("l_quantity") * 1000)
    return li.select("l_orderkey", "l_linenumber",
                     r6(derive.percentage_error("l_extendedprice", "pred")).alias("pct_error"),
                     r6(derive.absolute_error("l_extendedprice", "pred")).alias("abs_error"))


@register("t19_string_helpers", """
SELECT origin_airport || '-' || destination_airport AS pair, split_part(aircraft_model, ' ', 2) AS model_no,
       regexp_extract('origin_cloud_height', '^(.*)_[^_]*$', 1) AS stem, count(*) AS n
FROM legs GROUP BY 1, 2, 3
""")
def t19(spark, sf):
    x = fx.legs(spark, sf).select(derive.pair_label("origin_airport", "destination_airport").alias("pair"),
                                  derive.split_part("aircraft_model", " ", 2).alias("model_no"),
                                  derive.name_before_last_underscore(F.lit("origin_cloud_height")).alias("stem"))
    return x.groupBy("pair", "model_no", "stem").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ W: windows

@register("w1_w2_rotation", f"SELECT leg_id, {rotation_cols()} FROM legs")
def w1_w2(spark, sf):
    x = derive.add_scheduled_rotation_time(fx.legs(spark, sf))
    x = derive.add_previous_delay_code(x.withColumn("delay_code", F.col("delay_code").cast("string")))
    return x.select("leg_id", "scheduled_rotation_time", "prev_delay_code")


@register("w1_w2_rotation_daily_buckets", f"SELECT leg_id, {rotation_cols()} FROM legs")
def w1_w2_daily(spark, sf):
    """Same features with day-wide buckets: the carry rows must make it bucket-size independent."""
    legs = fx.legs(spark, sf).withColumn("delay_code", F.col("delay_code").cast("string"))
    x = derive.add_rotation_features(legs, bucket_minutes=24 * 60)
    return x.select("leg_id", "scheduled_rotation_time", "prev_delay_code")


@register("w4_share_within_origin", """
SELECT origin_airport, fleet, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY origin_airport), 6) AS share
FROM legs GROUP BY origin_airport, fleet
""")
def w4(spark, sf):
    c = fx.legs(spark, sf).groupBy("origin_airport", "fleet").agg(F.count(F.lit(1)).alias("n"))
    return derive.share_within(c, "n", ["origin_airport"]).withColumn("share", r6(F.col("share")))
