"""Checked queries: profiling and report tables (A1..A26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from legflow.operators import clean, derive, report
from legflow.plans.catalog import REPAIRED_CTE, enriched_cte, hm, register
from legflow.plans.q_core import enriched, r6
from legflow.sources import fixtures as fx

_PROFILE_COLS = ["tail_number", "fleet", "delay_code", "service_type", "aircraft_owner_code"]


def _profile_sql(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, count({c}) AS n_non_null,
       count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n_distinct,
       round((count(*) - count({c})) * 100.0 / count(*), 6) AS missing_pct,
       (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM legs
         WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)) AS sample_values
FROM legs"""


@register("a1_column_profile", " UNION ALL ".join(_profile_sql(c) for c in _PROFILE_COLS))
def a1(spark, sf):
    p = report.column_profile(fx.legs(spark, sf).select(*_PROFILE_COLS))
    return p.select(F.col("column").alias("column_name"), "n_non_null", "n_distinct",
                    r6(F.col("missing_pct")).alias("missing_pct"), "sample_values")


_DESC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("a2_numeric_describe", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
       round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM lineitem""" for c in _DESC))
def a2(spark, sf):
    d = report.numeric_describe(fx.read_table(spark, sf, "lineitem"), _DESC)
    return d.select(F.col("column").alias("column_name"), "count",
                    *[r6(F.col(c)).alias(c) for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]])


_MISS = ["tail_number", "fleet", "take_off_date", "landing_date", "delay_code", "delay_sub_code", "delay_minutes",
         "origin_airport"]


@register("a3_missing_percentages", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 6) AS missing_pct FROM legs"
    for c in _MISS) + ") WHERE missing_pct > 0")
def a3(spark, sf):
    m = report.missing_percentages(fx.legs(spark, sf).select(*_MISS))
    return m.select(F.col("column").alias("column_name"), r6(F.col("missing_pct")).alias("missing_pct"))


@register("a4_top_value_shares", """
SELECT aircraft_owner_code AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM legs), 6) AS pct
FROM legs WHERE aircraft_owner_code IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 5
""")
def a4(spark, sf):
    return report.top_value_shares(fx.legs(spark, sf), "aircraft_owner_code").withColumn("pct", r6(F.col("pct")))


@register("a5_rare_category_binning", """
WITH c AS (SELECT CAST(delay_code AS VARCHAR) AS code, count(*) AS n FROM legs WHERE delay_code IS NOT NULL GROUP BY 1),
t AS (SELECT sum(n) AS tot FROM c)
SELECT CASE WHEN l.code IS NULL THEN NULL WHEN c.n * 100.0 >= t.tot * 1.0 THEN l.code ELSE 'other' END AS delay_code,
       count(*) AS n_legs
FROM (SELECT CAST(delay_code AS VARCHAR) AS code FROM legs) l LEFT JOIN c ON l.code = c.code, t
GROUP BY 1
""")
def a5(spark, sf):
    legs = fx.legs(spark, sf).withColumn("delay_code", F.col("delay_code").cast("string"))
    b = report.RareCategoryBinner("delay_code", 1.0).fit(legs)
    return b.transform(legs).groupBy("delay_code").agg(F.count(F.lit(1)).alias("n_legs"))


@register("a6_delayed_counts", """
SELECT count(*) FILTER (WHERE delay_code IS NOT NULL) AS delayed, count(*) FILTER (WHERE delay_code IS NULL) AS not_delayed
FROM legs""")
def a6(spark, sf):
    return report.delayed_counts(fx.legs(spark, sf))


@register("a7_time_distribution", """
SELECT 'year' AS part, CAST(year(flight_date) AS INTEGER) AS value, count(*) AS n FROM legs GROUP BY 2
UNION ALL SELECT 'month', CAST(month(flight_date) AS INTEGER), count(*) FROM legs GROUP BY 2
UNION ALL SELECT 'weekday', CAST(isodow(flight_date) - 1 AS INTEGER), count(*) FROM legs GROUP BY 2
""")
def a7(spark, sf):
    return report.time_distribution(fx.legs(spark, sf))


@register("a8_delay_by_hour", """
SELECT CAST(hour(scheduled_departure_date) AS INTEGER) AS hour, count(delay_minutes) AS n_delays,
       round(avg(delay_minutes), 6) AS mean_delay
FROM legs WHERE delay_minutes IS NOT NULL GROUP BY 1
""")
def a8(spark, sf):
    return report.delay_by_hour(fx.legs(spark, sf)).withColumn("mean_delay", r6(F.col("mean_delay")))


@register("a9_delay_weekday_month", "SELECT CAST(isodow(flight_date) - 1 AS INTEGER) AS weekday, " + ", ".join(
    f'count(*) FILTER (WHERE month(flight_date) = {m}) AS "{m}"' for m in range(1, 13))
    + " FROM legs WHERE delay_code IS NOT NULL GROUP BY 1")
def a9(spark, sf):
    return report.delay_weekday_month(fx.legs(spark, sf))


@register("a10_delay_code_proportions", """
WITH per AS (SELECT origin_airport, count(*) AS rows_, count(delay_code) AS delays FROM legs GROUP BY 1),
top_o AS (SELECT * FROM per ORDER BY delays DESC, origin_airport LIMIT 7),
prop AS (SELECT l.origin_airport, CAST(l.delay_code AS VARCHAR) AS code, count(*) * 1.0 / t.rows_ AS proportion
         FROM legs l JOIN top_o t ON l.origin_airport = t.origin_airport WHERE l.delay_code IS NOT NULL
         GROUP BY l.origin_airport, CAST(l.delay_code AS VARCHAR), t.rows_),
top_c AS (SELECT code FROM prop GROUP BY code ORDER BY round(sum(proportion), 9) DESC, code LIMIT 5)
SELECT origin_airport, code, round(proportion, 6) AS proportion FROM prop WHERE code IN (SELECT code FROM top_c)
""")
def a10(spark, sf):
    return report.delay_code_proportions(fx.legs(spark, sf)).withColumn("proportion", r6(F.col("proportion")))


@register("a11_top_models_with_fleet", """
WITH base AS (SELECT * FROM legs WHERE fleet IS NOT NULL),
top AS (SELECT aircraft_model, count(*) AS n FROM base GROUP BY 1 ORDER BY n DESC, aircraft_model LIMIT 10),
first_ AS (SELECT aircraft_model, fleet FROM (SELECT aircraft_model, fleet, row_number() OVER (PARTITION BY aircraft_model ORDER BY leg_id) AS rn FROM legs) WHERE rn = 1)
SELECT t.aircraft_model, t.n, round(t.n * 100.0 / (SELECT count(*) FROM base), 6) AS pct, f.fleet
FROM top t JOIN first_ f ON t.aircraft_model = f.aircraft_model
""")
def a11(spark, sf):
    r = report.top_groups_with_first_attr(fx.legs(spark, sf), "aircraft_model", "fleet", 10, require_attr=True)
    return r.withColumn("pct", r6(F.col("pct")))


@register("a11_top_tails_with_fleet", """
WITH top AS (SELECT tail_number, count(*) AS n FROM legs WHERE tail_number IS NOT NULL GROUP BY 1
             ORDER BY n DESC, tail_number LIMIT 100),
first_ AS (SELECT tail_number, fleet FROM (SELECT tail_number, fleet, row_number() OVER (PARTITION BY tail_number ORDER BY leg_id) AS rn FROM legs) WHERE rn = 1)
SELECT t.tail_number, t.n, round(t.n * 100.0 / (SELECT count(*) FROM legs), 6) AS pct, f.fleet
FROM top t JOIN first_ f ON t.tail_number = f.tail_number
""")
def a11_tails(spark, sf):
    r = report.top_groups_with_first_attr(fx.legs(spark, sf), "tail_number", "fleet", 100)
    return r.withColumn("pct", r6(F.col("pct")))


@register("a12_haul_segment_fleets", f"""
WITH b AS (SELECT fleet, {hm('off_block_date', 'on_block_date')} AS abt FROM legs),
s AS (SELECT CASE WHEN abt >= 30 AND abt < 180 THEN '30min-3h' WHEN abt >= 180 AND abt < 360 THEN '3-6h'
                  WHEN abt >= 360 THEN '> 6h' END AS segment, fleet FROM b),
c AS (SELECT segment, fleet, count(*) AS n FROM s WHERE segment IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY segment) AS tot,
             row_number() OVER (PARTITION BY segment ORDER BY n DESC, fleet ASC NULLS LAST) AS rn FROM c)
SELECT segment, fleet, round(n * 100.0 / tot, 6) AS pct FROM r WHERE rn = 1
""")
def a12(spark, sf):
    x = fx.legs(spark, sf).withColumn("actual_block_time", derive.minutes("off_block_date", "on_block_date"))
    return report.haul_segment_fleets(x).withColumn("pct", r6(F.col("pct")))


@register("a13_frequent_pairs", """
SELECT origin_airport || '-' || destination_airport AS pair, count(*) AS n,
       round(count(*) * 100.0 / (SELECT count(*) FROM legs), 6) AS pct
FROM legs GROUP BY origin_airport, destination_airport ORDER BY n DESC, origin_airport, destination_airport LIMIT 16
""")
def a13(spark, sf):
    return report.frequent_pairs(fx.legs(spark, sf)).withColumn("pct", r6(F.col("pct")))


@register("a14_top_endpoints", """
(SELECT origin_airport AS airport, count(*) AS n, 'origin' AS side FROM legs GROUP BY 1 ORDER BY n DESC, airport LIMIT 8)
UNION ALL
(SELECT destination_airport, count(*), 'destination' FROM legs GROUP BY 1 ORDER BY count(*) DESC, destination_airport LIMIT 8)
""")
def a14(spark, sf):
    return report.top_endpoints(fx.legs(spark, sf))


@register("a15_sky_cover_shares", """
WITH w AS (SELECT CASE WHEN cloud_coverage_lvl_1 IN ('M', '///') THEN NULL ELSE cloud_coverage_lvl_1 END AS lvl1,
                  CASE WHEN cloud_coverage_lvl_2 IN ('M', '///') THEN NULL ELSE cloud_coverage_lvl_2 END AS lvl2,
                  CASE WHEN cloud_coverage_lvl_3 IN ('M', '///') THEN NULL ELSE cloud_coverage_lvl_3 END AS lvl3
           FROM weather_obs),
l AS (SELECT 'lvl1' AS level, lvl1 AS category FROM w UNION ALL SELECT 'lvl2', lvl2 FROM w
      UNION ALL SELECT 'lvl3', lvl3 FROM w)
SELECT level, category, round(count(*) * 1.0 / (SELECT count(*) FROM weather_obs), 6) AS share
FROM l WHERE category IS NOT NULL GROUP BY 1, 2
""")
def a15(spark, sf):
    cov = ["cloud_coverage_lvl_1", "cloud_coverage_lvl_2", "cloud_coverage_lvl_3"]
    w = clean.sentinel_to_null(fx.weather_obs(spark, sf), cov)
    return report.level_shares(w, cov, ["lvl1", "lvl2", "lvl3"]).withColumn("share", r6(F.col("share")))


_EDGES_SQL = """
e AS (SELECT DISTINCT least(origin_airport, destination_airport) AS u, greatest(origin_airport, destination_airport) AS v
      FROM legs WHERE origin_airport IS NOT NULL AND destination_airport IS NOT NULL)"""


@register("a16_graph_size", "WITH " + _EDGES_SQL + """
SELECT 'nodes' AS metric, count(*) AS n FROM (SELECT u FROM e UNION SELECT v FROM e)
UNION ALL SELECT 'edges', count(*) FROM e
""")
def a16(spark, sf):
    return report.graph_size(fx.legs(spark, sf))


@register("a17_node_degrees", "WITH " + _EDGES_SQL + """
SELECT node, count(*) AS degree FROM (SELECT u AS node FROM e UNION ALL SELECT v FROM e) GROUP BY node
""")
def a17(spark, sf):
    return report.node_degrees(fx.legs(spark, sf))


@register("a18_connected_components", """
WITH RECURSIVE """ + _EDGES_SQL.strip() + """,
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach(start, node) AS (SELECT DISTINCT u, u FROM b UNION SELECT r.start, b.v FROM reach r JOIN b ON b.u = r.node)
SELECT start AS node, min(node) AS component FROM reach GROUP BY start
""")
def a18(spark, sf):
    return report.connected_components(fx.legs(spark, sf))


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("a19_pearson_matrix", " UNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS corr FROM lineitem" for x in _CORR for y in _CORR))
def a19(spark, sf):
    return report.correlation_long(fx.read_table(spark, sf, "lineitem"), _CORR).withColumn("corr", r6(F.col("corr")))


_SPEAR = ["air_time", "taxi_out", "taxi_in", "actual_block_time", "delay_minutes"]


@register("a20_spearman_matrix", "WITH " + """
tg AS (SELECT leg_id, """ + ", ".join(f"CAST({hm(a, b)} AS DOUBLE) AS {n}" for n, a, b in [
    ("air_time", "take_off_date", "landing_date"), ("taxi_out", "off_block_date", "take_off_date"),
    ("taxi_in", "landing_date", "on_block_date"), ("actual_block_time", "off_block_date", "on_block_date")])
    + """, delay_minutes FROM legs),
c AS (SELECT * FROM tg WHERE """ + " AND ".join(f"{c} IS NOT NULL" for c in _SPEAR) + """),
r AS (SELECT leg_id, """ + ", ".join(
    f"(rank() OVER (ORDER BY {c}) + rank() OVER (ORDER BY {c}) + count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}"
    for c in _SPEAR) + """ FROM c)
""" + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS corr FROM r"
                         for x in _SPEAR for y in _SPEAR))
def a20(spark, sf):
    legs = fx.legs(spark, sf)
    x = legs.select("leg_id", *[derive.minutes(a, b).cast("double").alias(n) for n, a, b in [
        ("air_time", "take_off_date", "landing_date"), ("taxi_out", "off_block_date", "take_off_date"),
        ("taxi_in", "landing_date", "on_block_date"), ("actual_block_time", "off_block_date", "on_block_date")]],
        "delay_minutes").dropna(subset=_SPEAR)
    return report.spearman_long(x, _SPEAR, "leg_id").withColumn("corr", r6(F.col("corr")))


@register("a21_delay_source_comparison", f"""
WITH d AS (SELECT delay_minutes, CASE WHEN {hm('scheduled_departure_date', 'off_block_date')} IS NULL THEN NULL
                 ELSE greatest({hm('scheduled_departure_date', 'off_block_date')}, 0) END AS dep FROM legs)
SELECT 'dataset' AS series, round(avg(delay_minutes), 6) AS mean, max(delay_minutes) AS max, min(delay_minutes) AS min FROM d
UNION ALL SELECT 'calculated', round(avg(dep), 6), CAST(max(dep) AS DOUBLE), CAST(min(dep) AS DOUBLE) FROM d
""")
def a21(spark, sf):
    return report.delay_source_comparison(fx.legs(spark, sf)).withColumn("mean", r6(F.col("mean")))


@register("a22_day_schedule_series", """
SELECT 'departure' AS "end", scheduled_departure_date AS scheduled, off_block_date AS actual FROM legs
WHERE scheduled_departure_date >= TIMESTAMP '2024-01-09' AND scheduled_departure_date < TIMESTAMP '2024-01-10'
UNION ALL
SELECT 'arrival', scheduled_arrival_date, on_block_date FROM legs
WHERE scheduled_arrival_date >= TIMESTAMP '2024-01-09' AND scheduled_arrival_date < TIMESTAMP '2024-01-10'
""")
def a22(spark, sf):
    return report.day_schedule_series(fx.legs(spark, sf), 2024, 1, 9)


@register("a23_paired_histogram", "WITH " + REPAIRED_CTE + "," + enriched_cte("repaired", "en") + """,
l AS (SELECT 'origin_air_temperature' AS series, origin_air_temperature AS v FROM en
      UNION ALL SELECT 'destination_air_temperature', destination_air_temperature FROM en),
l2 AS (SELECT * FROM l WHERE v IS NOT NULL),
r AS (SELECT min(v) AS lo, max(v) AS hi FROM l2)
SELECT series, CAST(least(floor((v - lo) / ((hi - lo) / 20.0)), 19) AS INTEGER) AS bin, count(*) AS n
FROM l2, r GROUP BY 1, 2
""")
def a23(spark, sf):
    h = report.paired_histogram(enriched(spark, sf), "origin_air_temperature", "destination_air_temperature", 20)
    return h.select("series", "bin", "n")


@register("a24_airport_cloud_timeline", "WITH " + REPAIRED_CTE + "," + enriched_cte("repaired", "en") + """
SELECT off_block_date AS date, CASE WHEN origin_cloud_coverage_lvl_1 IN ('M', '///') THEN NULL ELSE origin_cloud_coverage_lvl_1 END AS coverage,
       origin_cloud_height_lvl_1 AS height FROM en
WHERE origin_airport = 'A1' AND off_block_date >= TIMESTAMP '2024-01-01' AND off_block_date < TIMESTAMP '2024-02-01'
UNION ALL
SELECT on_block_date, CASE WHEN destination_cloud_coverage_lvl_1 IN ('M', '///') THEN NULL ELSE destination_cloud_coverage_lvl_1 END,
       destination_cloud_height_lvl_1 FROM en
WHERE destination_airport = 'A1' AND on_block_date >= TIMESTAMP '2024-01-01' AND on_block_date < TIMESTAMP '2024-02-01'
""")
def a24(spark, sf):
    from legflow.plans.build import LEVEL_ONE_RENAMES, SKY_COVER

    e = clean.sentinel_to_null(enriched(spark, sf), SKY_COVER)
    e = clean.rename_columns(e, LEVEL_ONE_RENAMES)
    return report.airport_cloud_timeline(e, "A1", 2024, 1)


@register("a25_skewed_columns", """
WITH l AS (SELECT 'value' AS column_name, value AS v FROM events UNION ALL SELECT 'user_id', user_id FROM events
           UNION ALL SELECT 'event_id', event_id FROM events),
m AS (SELECT column_name, avg(v) AS mu, min(v) AS mn FROM l GROUP BY 1),
s AS (SELECT l.column_name, avg(power(v - mu, 3)) / power(avg(power(v - mu, 2)), 1.5) AS skew, any_value(mn) AS mn
      FROM l JOIN m USING (column_name) GROUP BY 1)
SELECT column_name, round(skew, 6) AS skew FROM s WHERE mn > 0 AND abs(skew) > 0.5
""")
def a25(spark, sf):
    ev = fx.read_table(spark, sf, "events")
    s = report.skewed_columns(ev, ["value", "user_id", "event_id"], 0.5)
    return s.select(F.col("column").alias("column_name"), r6(F.col("skew")).alias("skew"))


_CLS_EXPRS = ["l_returnflag AS label", "CASE l_linestatus WHEN 'F' THEN 'R' ELSE 'N' END AS prediction"]
_CLS = ", ".join(_CLS_EXPRS)


@register("a26_confusion_matrix", f"SELECT label, prediction, count(*) AS n FROM (SELECT {_CLS} FROM lineitem) GROUP BY 1, 2")
def a26(spark, sf):
    return report.confusion_matrix(fx.read_table(spark, sf, "lineitem").selectExpr(*_CLS_EXPRS))


@register("a26_classification_report", f"""
WITH p AS (SELECT {_CLS} FROM lineitem),
cls AS (SELECT label AS cls FROM p UNION SELECT prediction FROM p),
s AS (SELECT c.cls, (SELECT count(*) FROM p WHERE label = c.cls AND prediction = c.cls) AS tp,
             (SELECT count(*) FROM p WHERE label = c.cls) AS support,
             (SELECT count(*) FROM p WHERE prediction = c.cls) AS predicted FROM cls c),
m AS (SELECT cls, coalesce(tp * 1.0 / nullif(predicted, 0), 0.0) AS precision,
             coalesce(tp * 1.0 / nullif(support, 0), 0.0) AS recall, support FROM s),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM m),
allr AS (SELECT cls, precision, recall, f1, support FROM f
         UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
         UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                          sum(f1 * support) / sum(support), sum(support) FROM f)
SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM allr
""")
def a26_report(spark, sf):
    r = report.classification_report(fx.read_table(spark, sf, "lineitem").selectExpr(*_CLS_EXPRS))
    return r.select("cls", *[r6(F.col(c)).alias(c) for c in ["precision", "recall", "f1"]],
                    F.col("support").cast("long").alias("support"))


@register("a24_timeline_bounds", "WITH " + REPAIRED_CTE + "," + enriched_cte("repaired", "en") + """,
t AS (SELECT off_block_date AS date, origin_cloud_height_lvl_1 AS height FROM en
      WHERE origin_airport = 'A1' AND off_block_date >= TIMESTAMP '2024-01-01' AND off_block_date < TIMESTAMP '2024-02-01'
      UNION ALL
      SELECT on_block_date, destination_cloud_height_lvl_1 FROM en
      WHERE destination_airport = 'A1' AND on_block_date >= TIMESTAMP '2024-01-01' AND on_block_date < TIMESTAMP '2024-02-01')
SELECT min(date) - INTERVAL 1 HOUR AS x_min, max(date) + INTERVAL 1 HOUR AS x_max, max(height) + 500 AS y_max FROM t
""")
def a24_bounds(spark, sf):
    from legflow.plans.build import LEVEL_ONE_RENAMES

    e = clean.rename_columns(enriched(spark, sf), LEVEL_ONE_RENAMES)
    return report.timeline_bounds(report.airport_cloud_timeline(e, "A1", 2024, 1))


@register("a21_sampled_delay_comparison", f"""
WITH d AS (SELECT delay_minutes, CASE WHEN {hm('scheduled_departure_date', 'off_block_date')} IS NULL THEN NULL
                 ELSE greatest({hm('scheduled_departure_date', 'off_block_date')}, 0) END AS dep FROM legs
           WHERE (CAST((CAST(leg_id AS BIGINT) * 2654435761 + 5 * 40503) % 4294967296 AS DOUBLE) / 4294967296.0) < 0.1)
SELECT 'dataset' AS series, round(avg(delay_minutes), 6) AS mean, max(delay_minutes) AS max, min(delay_minutes) AS min FROM d
UNION ALL SELECT 'calculated', round(avg(dep), 6), CAST(max(dep) AS DOUBLE), CAST(min(dep) AS DOUBLE) FROM d
""")
def a21_sampled(spark, sf):
    """A21 with the chart's 10 % sample, drawn as a function of the row key."""
    from legflow.functions.nulls import uniform

    legs = fx.legs(spark, sf).where(uniform("leg_id", 5) < 0.1)
    return report.delay_source_comparison(legs).withColumn("mean", r6(F.col("mean")))
