"""Registry of checked queries: a Spark builder and its DuckDB twin per survey row.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
supplied tables (or stand-ins derived from them by Spark).  Each SQL text is
DuckDB SQL over the same tables; ``with_fixtures`` prefixes the stand-in
views.  Floating results are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from legflow.plans.build import WEATHER_NUMERIC
from legflow.sources.fixtures import with_fixtures

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, with_fixtures(sql) if sql is not None else None)
        return fn
    return deco


# ----------------------------------------------------------------- SQL fragments (DuckDB)

def hm(a: str, b: str) -> str:
    """Half-even whole minutes from a to b."""
    return f"CAST(round_even(date_diff('microsecond', {a}, {b}) / 60000000.0, 0) AS INTEGER)"


LEG_TS = ["flight_date", "scheduled_departure_date", "scheduled_arrival_date", "off_block_date",
          "take_off_date", "landing_date", "on_block_date", "registered_delay_date"]

# raw_legs -> exact dedupe -> latest per flight key -> no surface vehicles -> typed dates
REPAIRED_CTE = """
repaired__d AS (SELECT DISTINCT * FROM raw_legs),
repaired__l AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (
      PARTITION BY flight_number, origin_airport, destination_airport, scheduled_departure_date
      ORDER BY registered_delay_date DESC NULLS LAST, leg_id DESC, flight_date DESC NULLS LAST,
               tail_number DESC NULLS LAST, delay_code DESC NULLS LAST) AS rn
    FROM repaired__d) WHERE rn = 1),
repaired AS (
  SELECT * REPLACE (CAST(flight_date AS TIMESTAMP) AS flight_date)
  FROM repaired__l WHERE coalesce(aircraft_model = 'Surface Vehicle', false) = false)
"""

WEATHER_PAYLOAD = ["air_temperature", "wind_direction", "wind_speed", "visibility", "wind_gust",
                   "cloud_coverage_lvl_1", "cloud_coverage_lvl_2", "cloud_coverage_lvl_3", "cloud_height_lvl_1"]


def enriched_cte(src: str, name: str, numeric: bool = True) -> str:
    """J3 (+P6) over the legs CTE ``src``: nearest observation in the same day at each end."""
    def val(end, p):
        ref = f"{end}.{p}"
        if numeric and p in WEATHER_NUMERIC:
            return f"CASE WHEN isnan(TRY_CAST({ref} AS DOUBLE)) THEN NULL ELSE TRY_CAST({ref} AS DOUBLE) END"
        return ref
    cols = ", ".join([f"{val('o', p)} AS origin_{p}" for p in WEATHER_PAYLOAD]
                     + [f"{val('d', p)} AS destination_{p}" for p in WEATHER_PAYLOAD])
    payload = ", ".join(f"w.{p}" for p in WEATHER_PAYLOAD)
    return f"""
{name}__codes AS (SELECT iata, min(icao) AS icao FROM airport_codes
                  WHERE iata IS NOT NULL AND icao IS NOT NULL GROUP BY iata),
{name}__st AS (SELECT x.*, coalesce(co.icao, '') AS {name}__o, coalesce(cd.icao, '') AS {name}__d
               FROM {src} x LEFT JOIN {name}__codes co ON x.origin_airport = co.iata
                            LEFT JOIN {name}__codes cd ON x.destination_airport = cd.iata),
{name}__om AS (SELECT x.leg_id, {payload}, row_number() OVER (PARTITION BY x.leg_id
                  ORDER BY abs(date_diff('microsecond', x.off_block_date, w.time)), w.feed_seq) AS rn
               FROM {name}__st x JOIN weather_obs w
                 ON w.station = x.{name}__o AND CAST(w.time AS DATE) = CAST(x.off_block_date AS DATE)),
{name}__dm AS (SELECT x.leg_id, {payload}, row_number() OVER (PARTITION BY x.leg_id
                  ORDER BY abs(date_diff('microsecond', x.on_block_date, w.time)), w.feed_seq) AS rn
               FROM {name}__st x JOIN weather_obs w
                 ON w.station = x.{name}__d AND CAST(w.time AS DATE) = CAST(x.on_block_date AS DATE)),
{name} AS (SELECT x.* EXCLUDE ({name}__o, {name}__d), {cols}
           FROM {name}__st x
           LEFT JOIN {name}__om o ON o.leg_id = x.leg_id AND o.rn = 1
           LEFT JOIN {name}__dm d ON d.leg_id = x.leg_id AND d.rn = 1)
"""


def not_true(cond: str) -> str:
    """Q1 keep predicate."""
    return f"coalesce(({cond}), false) = false"


def targets_cte(src: str, name: str) -> str:
    """T9 over ``src``: the four duration labels with their row drops, in order."""
    return f"""
{name} AS (
  SELECT *, {hm('take_off_date', 'landing_date')} AS air_time,
            {hm('off_block_date', 'take_off_date')} AS taxi_out,
            {hm('landing_date', 'on_block_date')} AS taxi_in,
            {hm('off_block_date', 'on_block_date')} AS actual_block_time
  FROM {src}
  WHERE {not_true('landing_date <= take_off_date')} AND {not_true('take_off_date < off_block_date')}
    AND {not_true('on_block_date < landing_date')} AND {not_true('on_block_date <= off_block_date')})
"""


MALFORMED_SQL = [
    ("same_endpoints", "origin_airport = destination_airport"),
    ("no_take_off", "take_off_date IS NULL"),
    ("no_landing", "landing_date IS NULL"),
    ("training_service", "service_type = 'K'"),
    ("off_block_after_take_off", "off_block_date > take_off_date"),
    ("take_off_not_before_landing", "take_off_date >= landing_date"),
    ("landing_after_on_block", "landing_date > on_block_date"),
]


def wellformed_where() -> str:
    return " AND ".join(not_true(c) for _, c in MALFORMED_SQL)


def rotation_cols(src_alias: str = "") -> str:
    """W1 + W2 columns (NULL tail: no predecessor)."""
    w = "OVER (PARTITION BY tail_number ORDER BY scheduled_departure_date, leg_id)"
    return (f"CASE WHEN tail_number IS NULL THEN 0.0 ELSE coalesce(CAST({hm(f'lag(scheduled_arrival_date) {w}', 'scheduled_departure_date')} AS DOUBLE), 0.0) END AS scheduled_rotation_time, "
            f"CASE WHEN tail_number IS NULL THEN 'no_delay' ELSE coalesce(CAST(lag(delay_code) {w} AS VARCHAR), 'no_delay') END AS prev_delay_code")
