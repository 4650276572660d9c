"""Queries for sources and sinks (S1..S8) and the remaining column / row operators."""

from __future__ import annotations


from pyspark.sql import functions as F

from legflow.operators import clean, derive, enrich, select
from legflow.plans.catalog import REPAIRED_CTE, enriched_cte, hm, register, wellformed_where
from legflow.plans.q_core import r6
from legflow.plans.q_ml import li_row_id
from legflow.sources import fixtures as fx
from legflow.sources import io
from legflow.session import ensure_checkpoint_dir
from legflow.streaming import resumable

_TAB_COLS = ["leg_id", "tail_number", "origin_airport", "off_block_date", "delay_minutes"]


@register("s1_s5_tab_round_trip", "SELECT leg_id, tail_number, origin_airport, off_block_date, delay_minutes FROM legs")
def s1_s5(spark, sf):
    path = io.scratch_table_path(spark, "tab")
    legs = fx.legs(spark, sf).select(*_TAB_COLS).withColumn(
        "off_block_date", F.date_format("off_block_date", "yyyy-MM-dd HH:mm:ss"))
    io.write_tab(legs, path)
    back = io.read_delimited(spark, path, _TAB_COLS, sep="\t", date_cols=["off_block_date"],
                             types={"leg_id": "bigint", "delay_minutes": "double"})
    return back


@register("s2_s3_folder_merge", """
SELECT origin_airport, count(*) AS n_legs, count(CASE WHEN leg_id % 2 = 0 THEN fleet END) AS n_fleet FROM legs GROUP BY 1
""")
def s2_s3(spark, sf):
    a, b = io.scratch_table_path(spark, "src-a"), io.scratch_table_path(spark, "src-b")
    legs = fx.legs(spark, sf)
    io.write_tab(legs.where("leg_id % 2 = 0").select("leg_id", "origin_airport", "fleet"), a)
    io.write_tab(legs.where("leg_id % 2 = 1").select("leg_id", "origin_airport"), b)
    merged = io.merge_sources(io.read_mixed_folder(spark, [a]), io.read_mixed_folder(spark, [b]))
    return merged.groupBy("origin_airport").agg(F.count(F.lit(1)).alias("n_legs"), F.count("fleet").alias("n_fleet"))


@register("s4_station_feed", """
SELECT station, count(*) AS n_obs, count(TRY_CAST(wind_speed AS DOUBLE)) AS n_wind FROM weather_obs GROUP BY 1
""")
def s4(spark, sf):
    path = io.scratch_table_path(spark, "feed")
    w = fx.weather_obs(spark, sf)
    feed = w.select("station", F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time"),
                    *[F.col(c) if c in w.columns else F.lit("M").alias(c) for c in io.FEED_FIELDS[1:]])
    feed.write.mode("overwrite").option("header", True).csv(path)
    back = io.read_station_feed(spark, path)
    return back.groupBy("station").agg(F.count(F.lit(1)).alias("n_obs"),
                                       F.count(F.col("wind_speed").try_cast("double")).alias("n_wind"))


@register("s6_partitioned_model_sets", f"""
SELECT count(*) AS n_rows, CAST(sum({hm('take_off_date', 'landing_date')}) AS BIGINT) AS sum_label
FROM legs WHERE leg_id % 5 = 0 AND {hm('take_off_date', 'landing_date')} IS NOT NULL
""")
def s6(spark, sf):
    path = io.scratch_table_path(spark, "sets")
    x = fx.legs(spark, sf).select("leg_id", derive.minutes("take_off_date", "landing_date").alias("label")) \
        .where(F.col("label").isNotNull()).withColumn("split", F.when(F.col("leg_id") % 5 == 0, "test")
                                                     .otherwise("train"))
    io.store_model_sets(x, path, "air_time", "whole")
    back = io.load_model_set(spark, path, "air_time", "whole", "test")
    return back.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("label").cast("bigint").alias("sum_label"))


_S8_COLS = ["leg_id", "origin_wind_speed", "origin_cloud_coverage_lvl_1", "destination_air_temperature"]


@register("s8_resumable_enrichment", "WITH " + enriched_cte("legs", "en", numeric=False)
          + f"SELECT {', '.join(_S8_COLS)} FROM en")
def s8(spark, sf):
    out = io.scratch_table_path(spark, "enriched")
    legs, wx, codes = fx.legs(spark, sf), fx.weather_obs(spark, sf), fx.airport_codes(spark, sf)
    resumable.enrich_missing(legs.where("leg_id % 3 = 0"), wx, codes, out)   # an interrupted first run
    resumable.enrich_missing(legs, wx, codes, out)                           # the resumed run
    return spark.read.parquet(out).select(*_S8_COLS)


# ------------------------------------------------------------------ P / D / J / C rows not covered elsewhere

@register("p1_p2_p3_p4_p5_projection", """
SELECT leg_id AS id, 'x' || origin_airport AS x_origin_airport, CAST(NULL AS DOUBLE) AS origin_wind_gust,
       CAST(NULL AS VARCHAR) AS origin_station FROM legs
""")
def p1_p5(spark, sf):
    legs = fx.legs(spark, sf)
    x = clean.drop_columns(legs, [c for c in legs.columns if c not in ("leg_id", "origin_airport")])
    x = clean.rename_columns(x, {"leg_id": "id"})
    x = clean.prefix_columns(x, "x_", ["origin_airport"]).withColumn("x_origin_airport",
                                                                      F.concat(F.lit("x"), "x_origin_airport"))
    x = clean.add_empty_columns(x, {"origin_wind_gust": "double", "origin_station": "string"})
    assert clean.columns_of_kind(x, "numeric") == ["id", "origin_wind_gust"]
    return x


@register("p12_align_one_hot", """
SELECT 'a' AS side, count(*) AS n_rows, sum(fleet_WB) AS wb, sum(fleet_XX) AS xx FROM
  (SELECT CASE WHEN fleet = 'WB' THEN 1.0 ELSE 0.0 END AS fleet_WB, 0.0 AS fleet_XX FROM legs WHERE leg_id % 2 = 0)
UNION ALL SELECT 'b', count(*), 0.0, sum(fleet_XX) FROM (SELECT 1.0 AS fleet_XX FROM legs WHERE leg_id % 2 = 1)
""")
def p12(spark, sf):
    legs = fx.legs(spark, sf)
    a = legs.where("leg_id % 2 = 0").select(F.when(F.col("fleet") == "WB", 1.0).otherwise(0.0).alias("fleet_WB"))
    b = legs.where("leg_id % 2 = 1").select(F.lit(1.0).alias("fleet_XX"))
    a2, b2 = clean.align_columns(a, b)
    return (a2.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("fleet_WB").alias("wb"), F.sum("fleet_XX").alias("xx"))
            .withColumn("side", F.lit("a"))
            .unionByName(b2.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("fleet_WB").alias("wb"),
                                F.sum("fleet_XX").alias("xx")).withColumn("side", F.lit("b"))))


@register("d4_d5_union_and_sort", """
SELECT airport, side, t FROM (
  SELECT origin_airport AS airport, 'origin' AS side, off_block_date AS t FROM legs
  UNION ALL SELECT destination_airport, 'destination', on_block_date FROM legs)
""")
def d4_d5(spark, sf):
    legs = fx.legs(spark, sf)
    u = clean.union_renamed([
        (legs.select("origin_airport", "off_block_date"), {"origin_airport": "airport", "off_block_date": "t"}),
        (legs.select("destination_airport", "on_block_date"), {"destination_airport": "airport", "on_block_date": "t"}),
    ], label_col="side", labels=["origin", "destination"])
    return clean.sort_by(u, "t", ascending=False, tie=["airport", "side"])


@register("j8_align_shares", """
WITH o AS (SELECT origin_airport AS category, count(*) * 1.0 / (SELECT count(*) FROM legs) AS share FROM legs GROUP BY 1),
d AS (SELECT destination_airport AS category, count(*) * 1.0 / (SELECT count(*) FROM legs) AS share FROM legs
      WHERE destination_airport <> 'A3' GROUP BY 1)
SELECT coalesce(o.category, d.category) AS category, round(o.share, 6) AS origin, round(d.share, 6) AS destination
FROM o FULL OUTER JOIN d ON o.category = d.category
""")
def j8(spark, sf):
    legs = fx.legs(spark, sf)
    n = legs.count()
    o = legs.groupBy(F.col("origin_airport").alias("category")).agg((F.count(F.lit(1)) / n).alias("share"))
    d = legs.where("destination_airport <> 'A3'").groupBy(F.col("destination_airport").alias("category")).agg(
        (F.count(F.lit(1)) / n).alias("share"))
    out = enrich.align_shares([("origin", o), ("destination", d)])
    return out.select("category", r6(F.col("origin")).alias("origin"), r6(F.col("destination")).alias("destination"))


@register("c13_residual_outliers", f"""
SELECT origin_airport, CAST({hm('take_off_date', 'landing_date')} AS DOUBLE) AS label,
       CAST({hm('scheduled_departure_date', 'scheduled_arrival_date')} AS DOUBLE) * 0.5 AS prediction,
       CAST({hm('take_off_date', 'landing_date')} AS DOUBLE) - CAST({hm('scheduled_departure_date', 'scheduled_arrival_date')} AS DOUBLE) * 0.5 AS residual
FROM legs
WHERE abs(CAST({hm('take_off_date', 'landing_date')} AS DOUBLE) - CAST({hm('scheduled_departure_date', 'scheduled_arrival_date')} AS DOUBLE) * 0.5) > 100
""")
def c13(spark, sf):
    x = fx.legs(spark, sf).select(
        "origin_airport", derive.minutes("take_off_date", "landing_date").cast("double").alias("label"),
        (derive.minutes("scheduled_departure_date", "scheduled_arrival_date").cast("double") * 0.5).alias("prediction"))
    return clean.residual_outliers(x, "origin_airport", 100)


@register("e15_recursive_elimination_cv")
def e15(spark, sf):
    from legflow.operators import encode, model
    from legflow.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    li = fx.read_table(spark, sf, "lineitem")
    x = li.select(li_row_id().alias("row_id"), "l_quantity",
                  "l_discount", "l_tax", F.col("l_extendedprice").alias("label"))
    feats = ["l_quantity", "l_discount", "l_tax"]
    x = encode.StandardScaler(feats).fit(x).transform(x)
    x = model.stratified_folds(x.withColumn("__lbl", (F.col("label") / 20000).cast("int")), "__lbl", "row_id", k=5)
    x = x.checkpoint()  # reused by every fit of the elimination loop
    best, hist = select.recursive_elimination_cv(x, feats, "label", "fold", 5)
    return spark.createDataFrame([(n, float(f"{s:.4g}"), n == len(best)) for n, s in hist],
                                 "n_features int, mean_mse double, chosen boolean")




# ------------------------------------------------------------------ section 3 lifecycle plans

def _cleaned(spark, sf):
    from legflow.plans import build

    ensure_checkpoint_dir(spark)
    # script boundaries are materialised, as the source writes a file between
    # scripts: the data-dependent steps (sparse-column drops, date parts) each
    # need one pass, and must not recompute the enrichment every time
    built = build.build_dataset(fx.raw_legs(spark, sf), fx.weather_obs(spark, sf),
                                fx.airport_codes(spark, sf)).checkpoint()
    return build.clean_legs(built).checkpoint()


_CLEANED_SQL = "WITH " + REPAIRED_CTE + "," + enriched_cte("repaired", "en") + f""",
c AS (SELECT * FROM en WHERE delay_code IS NOT NULL AND {wellformed_where()}),
d AS (SELECT CASE WHEN aircraft_type_code IN ('772', '763', '744', '342', '313', '345') THEN 'WB'
                  WHEN aircraft_type_code IN ('M83', '738', '752', '737', '757', '734', 'BEH', 'ER4', '100', 'AT4') THEN 'NB'
                  WHEN fleet IN ('PGA', 'WI') THEN 'NB' ELSE fleet END AS fleet,
             CASE WHEN delay_sub_code IS NOT NULL AND delay_sub_code <> '0' THEN CAST(delay_code AS VARCHAR) || delay_sub_code
                  ELSE CAST(delay_code AS VARCHAR) END AS delay_code,
             origin_wind_speed FROM c)
SELECT fleet, delay_code, count(*) AS n_legs, round(avg(origin_wind_speed), 6) AS avg_origin_wind FROM d GROUP BY 1, 2
"""


@register("lifecycle_cleaned_legs", _CLEANED_SQL)
def lifecycle_cleaned(spark, sf):
    """3.1 + 3.2 first script: built, enriched, cleaned legs, summarised per fleet and delay code."""
    x = _cleaned(spark, sf)
    return x.groupBy("fleet", "delay_code").agg(F.count(F.lit(1)).alias("n_legs"),
                                                 r6(F.avg("origin_wind_speed")).alias("avg_origin_wind"))


@register("lifecycle_feature_table")
def lifecycle_features(spark, sf):
    """3.2 second script: the model table; one row per segment with label means."""
    from legflow.plans import build

    x = build.engineer_features(_cleaned(spark, sf))
    return x.groupBy("is_night").agg(F.count(F.lit(1)).alias("n_rows"),
                                     F.round(F.avg("air_time"), 3).alias("avg_air_time"),
                                     F.round(F.avg("scheduled_rotation_time"), 3).alias("avg_rotation"),
                                     F.countDistinct("prev_delay_code").alias("n_prev_codes"))
