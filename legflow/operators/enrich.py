"""Joins: code lookup, nearest-in-time enrichment, key-aligned rejoin and updates.

Survey rows J1..J8.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legflow.operators.sequence import nearest_in_time

# Observation fields carried to each leg end, in feed order.
WEATHER_FIELDS = [
    "air_temperature", "wind_direction", "wind_speed", "visibility", "wind_gust",
    "cloud_coverage_lvl_1", "cloud_coverage_lvl_2", "cloud_coverage_lvl_3", "cloud_height_lvl_1",
    "cloud_height_lvl_2", "cloud_height_lvl_3", "ice_accretion_1h", "ice_accretion_3h",
    "ice_accretion_6h", "peak_wind_gust", "peak_wind_direction",
]

# Bytes a side may have, by the optimizer's statistics, and still get a broadcast hint.
BROADCAST_MAX_BYTES = 32 << 20


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df``; no job runs.  Scans count their files, and
    filters, projections and aggregations at most their input."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint only behind a checked size in bytes; otherwise a plain side, which
    adaptive execution may still broadcast once its shuffled size is known."""
    return F.broadcast(df) if plan_bytes(df) <= max_bytes else df


#: File bytes of legs and observations that a partition stands for; sorted rows are some 25 times as large.
PART_BYTES, MOST_PARTS = 4 << 20, 4096


def parts_for(*frames: DataFrame) -> int | None:
    """Partitions for sorts of the rows of ``frames``, by the optimizer's estimate; None where the session's number is enough."""
    n = -(-sum(plan_bytes(f) for f in frames) // PART_BYTES)
    return min(n, MOST_PARTS) if n > int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def code_lookup(df: DataFrame, codes: DataFrame, col: str, out: str, code_from: str = "iata",
                code_to: str = "icao", missing: str = "") -> DataFrame:
    """``out`` = translation of ``col`` through ``codes``.

    Code rows with any NULL are ignored; one translation per code (the
    smallest, so reruns agree); unknown or NULL codes give ``missing``.
    """
    table = code_table(codes, code_from, code_to)
    joined = df.join(table, df[col] == table[code_from], "left")
    return joined.withColumn(out, F.coalesce(F.col("__to"), F.lit(missing))).drop(code_from, "__to")


def code_table(codes: DataFrame, code_from: str = "iata", code_to: str = "icao") -> DataFrame:
    """The J1 lookup table (complete rows, one translation per code), broadcast
    when its size is within the checked bound.  Passing the result as ``codes``
    again reuses it without a second size check."""
    if "__to" in codes.columns:
        return codes
    table = (codes.select(code_from, code_to).dropna("any")
             .groupBy(code_from).agg(F.min(code_to).alias("__to")))
    return broadcast_if_small(table)


def observation_payload(weather: DataFrame, fields: Sequence[str] = WEATHER_FIELDS) -> list[str]:
    return [f for f in fields if f in weather.columns]


def nearest_observation(legs: DataFrame, weather: DataFrame, station_col: str, time_col: str, prefix: str,
                        payload: Sequence[str] | None = None, bucket_minutes: int = 60, parts: int | None = None) -> DataFrame:
    """The observation nearest to ``time_col`` within its calendar day at ``station_col``."""
    payload = list(payload) if payload is not None else observation_payload(weather)
    return nearest_in_time(legs, weather, station_col, time_col, "station", "time", "feed_seq", payload,
                           prefix=prefix, bucket_minutes=bucket_minutes, parts=parts)


def enrich_both_ends(legs: DataFrame, weather: DataFrame, codes: DataFrame,
                     payload: Sequence[str] | None = None, bucket_minutes: int = 60,
                     key: str | None = "leg_id") -> DataFrame:
    """Origin weather at off-block time, destination weather at on-block time.

    With a unique ``key`` the two nearest-time passes run on narrow rows (key,
    station, time) and both results join back to the legs on the key, so the
    wide leg rows cross the network once (a co-partitioned pair of sort-merge
    joins) instead of once per leg end.  Without a key the legs are carried
    through both passes.  The partitions follow the size of the tables, so
    what a task sorts does not grow with them."""
    parts = parts_for(legs, weather)
    payload = list(payload) if payload is not None else observation_payload(weather)
    if key is None or key not in legs.columns:
        x = code_lookup(legs, codes, "origin_airport", "__origin_station")
        x = code_lookup(x, codes, "destination_airport", "__destination_station")
        x = nearest_observation(x, weather, "__origin_station", "off_block_date", "origin_", payload, bucket_minutes, parts)
        x = nearest_observation(x, weather, "__destination_station", "on_block_date", "destination_", payload,
                                bucket_minutes, parts)
        return x.drop("__origin_station", "__destination_station")
    narrow = legs.select(key, "origin_airport", "destination_airport", "off_block_date", "on_block_date")
    table = code_table(codes)
    narrow = code_lookup(narrow, table, "origin_airport", "__origin_station")
    narrow = code_lookup(narrow, table, "destination_airport", "__destination_station")
    o = nearest_observation(narrow.select(key, "__origin_station", "off_block_date"), weather, "__origin_station",
                            "off_block_date", "origin_", payload, bucket_minutes, parts)
    d = nearest_observation(narrow.select(key, "__destination_station", "on_block_date"), weather,
                            "__destination_station", "on_block_date", "destination_", payload, bucket_minutes, parts)
    o = o.drop("__origin_station", "off_block_date")
    d = d.drop("__destination_station", "on_block_date")
    if parts:
        legs, o, d = (x.repartition(parts, key) for x in (legs, o, d))
    return legs.join(o, key, "left").join(d, key, "left")


def rejoin_columns(left: DataFrame, right: DataFrame, key: str = "leg_id") -> DataFrame:
    """Column-wise concatenation of two key-aligned frames."""
    return left.join(right.select(key, *[c for c in right.columns if c != key and c not in left.columns]), key)


def split_by_keys(df: DataFrame, keys: DataFrame, key: str = "leg_id") -> tuple[DataFrame, DataFrame]:
    """(rows whose key is in ``keys``, rows whose key is not)."""
    k = keys.select(key).distinct()
    return df.join(k, key, "left_semi"), df.join(k, key, "left_anti")


def scatter_update(df: DataFrame, updates: DataFrame, key: str = "leg_id",
                   cols: Sequence[str] | None = None) -> DataFrame:
    """Rows present in ``updates`` take its values for ``cols`` (whole cell, NULL included)."""
    cols = list(cols) if cols is not None else [c for c in updates.columns if c != key]
    u = updates.select(key, *[F.col(c).alias(f"__u_{c}") for c in cols]).withColumn("__hit", F.lit(True))
    j = df.join(u, key, "left")
    return j.withColumns({c: F.when(F.col("__hit"), F.col(f"__u_{c}")).otherwise(F.col(c)) for c in cols}) \
        .select(df.columns)


def fill_missing_from(df: DataFrame, other: DataFrame, key: str = "leg_id",
                      cols: Sequence[str] | None = None) -> DataFrame:
    """Only the missing cells of ``df`` take ``other``'s values."""
    cols = list(cols) if cols is not None else [c for c in other.columns if c != key and c in df.columns]
    o = other.select(key, *[F.col(c).alias(f"__o_{c}") for c in cols])
    j = df.join(o, key, "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"__o_{c}")) for c in cols}).select(df.columns)


def align_shares(series: Sequence[tuple[str, DataFrame]], category: str = "category",
                 value: str = "share") -> DataFrame:
    """Several (category, value) frames, full-outer aligned on category,
    one column per labelled series (absent = NULL)."""
    long = None
    for label, s in series:
        part = s.select(F.col(category), F.lit(label).alias("__series"), F.col(value))
        long = part if long is None else long.unionByName(part)
    labels = [label for label, _ in series]
    return long.groupBy(category).pivot("__series", labels).agg(F.first(value))
