"""Stand-in inputs derived arithmetically from the supplied test tables.

The supplied tables hold no movement legs, so legs, station observations
and airport codes are computed from keys of ``orders``, ``events`` and
``nation``.  Each column is declared once as a SQL expression; Spark runs
it with ``selectExpr`` and the DuckDB oracle renders the same text as a
CTE, so both engines see the same input.  ``{TS}`` is the timestamp-without
-zone type name of the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Stage b: base departure and block minutes per order key.
_LEGS_B = [
    ("k", "o_orderkey"),
    ("c", "o_custkey"),
    ("dep", "CAST('2024-01-01 00:00:00' AS {TS}) + INTERVAL '1' MINUTE * (o_orderkey * 37 % 43200)"),
    ("blk", "45 + (o_orderkey * 13) % 555"),
]

# Stage a: off-block time with half-minute offsets (tests half-even rounding).
_LEGS_A = [
    ("offb", "dep + INTERVAL '1' MINUTE * ((k * 17) % 61 - 10) + INTERVAL '1' SECOND * ((k % 4) * 15)"),
]

_LEGS = [
    ("leg_id", "k"),
    ("flight_date", "CAST(dep AS DATE)"),
    ("flight_number", "CAST(100 + k % 900 AS STRING)"),
    ("tail_number", "CASE WHEN k % 211 = 0 THEN NULL ELSE 'T' || CAST(c % 40 AS STRING) END"),
    ("aircraft_type_code", "CASE k % 8 WHEN 0 THEN '738' WHEN 1 THEN '763' WHEN 2 THEN 'AT4' WHEN 3 THEN '320' "
                           "WHEN 4 THEN 'M83' WHEN 5 THEN '342' WHEN 6 THEN '100' ELSE '319' END"),
    ("aircraft_model", "CASE WHEN k % 71 = 0 THEN 'Surface Vehicle' ELSE 'MODEL ' || CAST(c % 12 AS STRING) END"),
    ("fleet", "CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 'PGA' WHEN 2 THEN 'WI' WHEN 4 THEN 'WB' ELSE 'NB' END"),
    ("origin_airport", "'A' || CAST(k % 25 AS STRING)"),
    ("destination_airport", "'A' || CAST(CAST(floor(k / 25) AS BIGINT) % 25 AS STRING)"),
    ("scheduled_departure_date", "dep"),
    ("scheduled_arrival_date", "dep + INTERVAL '1' MINUTE * blk"),
    ("off_block_date", "offb"),
    ("take_off_date", "CASE WHEN k % 97 = 0 THEN NULL WHEN k % 103 = 0 THEN offb - INTERVAL '1' MINUTE "
                      "ELSE offb + INTERVAL '1' SECOND * (300 + 60 * ((k * 11) % 21) + 30 * (k % 3)) END"),
    ("landing_date", "CASE WHEN k % 89 = 0 THEN NULL WHEN k % 101 = 0 THEN offb + INTERVAL '1' MINUTE "
                     "ELSE offb + INTERVAL '1' MINUTE * (blk - 13 + (k * 19) % 31) END"),
    ("on_block_date", "offb + INTERVAL '1' MINUTE * (blk - 13 + (k * 19) % 31 + "
                      "CASE WHEN k % 83 = 0 THEN -3 ELSE 2 + k % 14 END)"),
    ("service_type", "CASE WHEN k % 50 = 7 THEN 'K' WHEN k % 20 = 1 THEN 'P' ELSE 'J' END"),
    ("aircraft_owner_code", "CASE WHEN k % 250 = 3 THEN 'RARE' ELSE 'OWN' || CAST(c % 5 AS STRING) END"),
    ("registered_delay_date", "offb + INTERVAL '1' HOUR * (k % 5)"),
    ("delay_code", "CASE WHEN k % 5 = 0 THEN NULL WHEN k % 300 = 1 THEN 99 ELSE k % 41 END"),
    ("delay_sub_code", "CASE WHEN k % 7 = 0 THEN NULL WHEN k % 3 = 0 THEN '0' "
                       "ELSE substr('ABCDE', CAST(k % 5 + 1 AS INT), 1) END"),
    ("delay_minutes", "CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(greatest((k * 17) % 61 - 10, 0) AS DOUBLE) END"),
]

LEG_COLUMNS = [name for name, _ in _LEGS]

_WEATHER = [
    ("feed_seq", "event_id"),
    ("station", "'S' || CAST(user_id % 25 AS STRING)"),
    ("time", "ts"),
    ("air_temperature", "CASE WHEN event_type = 'error' THEN 'M' ELSE CAST(event_id % 45 - 10 AS STRING) END"),
    ("wind_direction", "CASE WHEN event_id % 13 = 0 THEN 'M' ELSE CAST(event_id * 7 % 360 AS STRING) END"),
    ("wind_speed", "CAST(event_id % 40 AS STRING)"),
    ("visibility", "CASE WHEN event_id % 17 = 0 THEN 'T' ELSE CAST(event_id % 110 AS STRING) END"),
    ("cloud_height_lvl_1", "CAST(event_id % 120 * 100 AS STRING)"),
    ("cloud_coverage_lvl_1", "CASE event_id % 6 WHEN 0 THEN 'FEW' WHEN 1 THEN 'SCT' WHEN 2 THEN 'BKN' "
                             "WHEN 3 THEN 'OVC' WHEN 4 THEN 'M' ELSE '///' END"),
    ("cloud_coverage_lvl_2", "CASE event_id % 4 WHEN 0 THEN 'SCT' WHEN 1 THEN 'BKN' ELSE 'M' END"),
    ("cloud_coverage_lvl_3", "CASE WHEN event_id % 20 = 0 THEN 'OVC' ELSE 'M' END"),
    ("wind_gust", "CASE WHEN event_id % 10 = 0 THEN CAST(event_id % 60 AS STRING) ELSE 'M' END"),
]

WEATHER_COLUMNS = [name for name, _ in _WEATHER]

_AIRPORT_CODES = [
    ("iata", "'A' || CAST(n_nationkey AS STRING)"),
    ("icao", "CASE WHEN n_nationkey % 12 = 7 THEN NULL ELSE 'S' || CAST(n_nationkey AS STRING) END"),
]

SPARK_TS = "TIMESTAMP_NTZ"
DUCK_TS = "TIMESTAMP"


def _exprs(pairs, ts):
    return [f"{e.format(TS=ts)} AS {n}" for n, e in pairs]


def _passthrough(pairs):
    return [n for n, _ in pairs]


# ---------------------------------------------------------------- Spark side

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_MATERIALISED: dict[tuple[str, str, str], str] = {}


def _materialised(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A stand-in table is derived once per session and written as parquet under
    the shared checkpoint folder, spread over the cluster's cores.  Queries
    then read it like any input table; without this, Catalyst inlines the
    generating expressions into every filter and projection of every consumer
    and evaluates them in the single read task of the small source file."""
    from legflow.session import checkpoint_path

    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    path = _MATERIALISED.get(key)
    if path is None:
        tag = "".join(ch if ch.isalnum() else "_" for ch in sf_dir.strip("/"))[-40:]
        app = "".join(ch if ch.isalnum() else "_" for ch in key[0])
        path = checkpoint_path(spark, f"standin-{app}-{tag}-{name}")
        build().repartition(spark.sparkContext.defaultParallelism).write.mode("overwrite").parquet(path)
        _MATERIALISED[key] = path
    return spark.read.parquet(path)


def derive_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 as a lazy plan over ``orders``."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    b = orders.selectExpr(*_exprs(_LEGS_B, SPARK_TS))
    a = b.selectExpr(*_passthrough(_LEGS_B), *_exprs(_LEGS_A, SPARK_TS))
    return a.selectExpr(*_exprs(_LEGS, SPARK_TS))


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: one leg per order."""
    return _materialised(spark, sf_dir, "legs", lambda: derive_legs(spark, sf_dir))


def raw_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: legs plus exact duplicates plus later re-registrations."""
    base = legs(spark, sf_dir)
    dups = base.where("leg_id % 10 = 0")
    later = base.where("leg_id % 9 = 0").selectExpr(*[
        "CASE WHEN leg_id % 18 = 0 THEN CAST(NULL AS TIMESTAMP_NTZ) "
        "ELSE registered_delay_date + INTERVAL '1' DAY END AS registered_delay_date"
        if c == "registered_delay_date" else ("77 AS delay_code" if c == "delay_code" else c)
        for c in LEG_COLUMNS
    ])
    return base.unionByName(dups).unionByName(later)


def weather_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw (text-valued) station observations in feed order."""
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return _materialised(spark, sf_dir, "weather_obs", lambda: events.selectExpr(*_exprs(_WEATHER, SPARK_TS)))


def airport_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IATA to ICAO code table, some codes unknown."""
    return read_table(spark, sf_dir, "nation").selectExpr(*_exprs(_AIRPORT_CODES, SPARK_TS))


# --------------------------------------------------------------- DuckDB side

def _select(pairs, src, ts, passthrough=None):
    cols = (passthrough or []) + _exprs(pairs, ts)
    return "SELECT " + ",\n       ".join(cols) + f"\n  FROM {src}"


LEGS_SQL = (
    "legs__b AS (" + _select(_LEGS_B, "orders", DUCK_TS) + "),\n"
    "legs__a AS (" + _select(_LEGS_A, "legs__b", DUCK_TS, _passthrough(_LEGS_B)) + "),\n"
    "legs AS (" + _select(_LEGS, "legs__a", DUCK_TS) + ")"
)

RAW_LEGS_SQL = (
    "raw_legs AS (SELECT * FROM legs UNION ALL SELECT * FROM legs WHERE leg_id % 10 = 0 UNION ALL SELECT "
    + ", ".join(
        "CASE WHEN leg_id % 18 = 0 THEN CAST(NULL AS TIMESTAMP) ELSE registered_delay_date + INTERVAL '1' DAY END "
        "AS registered_delay_date" if c == "registered_delay_date" else ("77 AS delay_code" if c == "delay_code" else c)
        for c in LEG_COLUMNS)
    + " FROM legs WHERE leg_id % 9 = 0)"
)

WEATHER_SQL = "weather_obs AS (" + _select(_WEATHER, "events", DUCK_TS) + ")"
AIRPORT_SQL = "airport_codes AS (" + _select(_AIRPORT_CODES, "nation", DUCK_TS) + ")"


def with_fixtures(body: str) -> str:
    """Prefix a DuckDB query with the stand-in views it may use.

    ``body`` is a SELECT, or a query opening with its own ``WITH`` list,
    which is appended after the stand-in views.
    """
    views = ",\n".join([LEGS_SQL, RAW_LEGS_SQL, WEATHER_SQL, AIRPORT_SQL])
    text = body.strip()
    if text[:14].upper() == "WITH RECURSIVE":
        return "WITH RECURSIVE " + views + ",\n" + text[14:].lstrip()
    head = "WITH " + views
    if text[:4].upper() == "WITH":
        return head + ",\n" + text[4:].lstrip()
    return head + "\n" + text
