"""Dataset build and cleaning plans (survey section 3.1 and 3.2), one lazy plan each.

``build_dataset``: raw legs -> drop irrelevant -> exact dedupe -> latest record
per flight -> drop surface vehicles -> type -> enrich both ends -> numeric weather.
``clean_legs``: the cleaning script; ``engineer_features``: the feature script.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legflow.operators import clean, derive, enrich

# Observation fields that are numeric text.
WEATHER_NUMERIC = [
    "air_temperature", "wind_direction", "wind_speed", "visibility", "wind_gust",
    "cloud_height_lvl_1", "cloud_height_lvl_2", "cloud_height_lvl_3", "ice_accretion_1h",
    "ice_accretion_3h", "ice_accretion_6h", "peak_wind_gust", "peak_wind_direction",
]
# Business key of one flight leg (latest delay record wins).
FLIGHT_KEY = ["flight_number", "origin_airport", "destination_airport", "scheduled_departure_date"]
# Columns dropped once features exist (feature script).
POST_FEATURE_DROPS = ["flight_date", "aircraft_owner_code", "aircraft_type_code", "delay_minutes",
                      "service_type", "registered_delay_date", "off_block_date", "take_off_date",
                      "landing_date", "on_block_date", "delay_code"]
SKY_COVER = [f"{end}_cloud_coverage_lvl_{i}" for end in ("origin", "destination") for i in (1, 2, 3)]
LEVEL_ONE_RENAMES = {
    "origin_cloud_coverage_lvl_1": "origin_cloud_coverage",
    "origin_cloud_height_lvl_1": "origin_cloud_height",
    "destination_cloud_coverage_lvl_1": "destination_cloud_coverage",
    "destination_cloud_height_lvl_1": "destination_cloud_height",
}


def weather_numeric_columns(df: DataFrame) -> list[str]:
    return [f"{end}_{c}" for end in ("origin", "destination") for c in WEATHER_NUMERIC
            if f"{end}_{c}" in df.columns]


def repair_legs(raw: DataFrame, exact_dedupe_first: bool = False) -> DataFrame:
    """P1 -> D1 -> D2 -> C4 (surface vehicles) -> P7 on working-name legs.

    D2 keeps one whole row per flight key (the greatest by time, then by the
    row itself), so exact duplicates collapse inside the same aggregation and
    the separate D1 shuffle is skipped unless asked for; the result is the same."""
    x = clean.drop_columns(raw, clean.RAW_IRRELEVANT_COLUMNS)
    if exact_dedupe_first:
        x = clean.drop_exact_duplicates(x)
    x = clean.latest_per_key(x, FLIGHT_KEY, "registered_delay_date")
    x = clean.drop_where_equal(x, "aircraft_model", "Surface Vehicle")
    return clean.coerce_timestamps(x, [c for c in clean.LEG_DATE_COLUMNS if c in x.columns])


def build_dataset(raw: DataFrame, weather: DataFrame, codes: DataFrame, bucket_minutes: int = 60) -> DataFrame:
    """Section 3.1 as one plan: repaired legs enriched at both ends, numeric weather typed."""
    x = repair_legs(raw)
    x = enrich.enrich_both_ends(x, weather, codes, bucket_minutes=bucket_minutes)
    return clean.coerce_numeric(x, weather_numeric_columns(x))


def clean_legs(df: DataFrame, sparse_threshold: float = 0.7) -> DataFrame:
    """Section 3.2, first script: sparse columns, delayed legs, fleets,
    malformed rules, delay codes, sky-cover sentinels, sparse again, renames."""
    x = clean.drop_sparse_columns(df, sparse_threshold)
    x = clean.keep_delayed(x)
    x = clean.regroup_fleet(x)
    x = clean.remove_malformed(x)
    x = derive.rebuild_delay_codes(x)
    x = clean.sentinel_to_null(x, [c for c in SKY_COVER if c in x.columns])
    x = clean.drop_sparse_columns(x, sparse_threshold)
    return clean.rename_columns(x, LEVEL_ONE_RENAMES)


def engineer_features(df: DataFrame, with_time: dict[str, bool] | None = None) -> DataFrame:
    """Section 3.2, second script.  Lags run before the service filter."""
    x = clean.weather_outlier_removal(df)
    x = derive.bin_wind_directions(x)
    x = derive.add_targets(x)
    x = derive.add_scheduled_block_time(x)
    x = derive.add_is_night(x)
    x = derive.add_rotation_features(x)
    x = clean.keep_where_equal(x, "service_type", "J")
    x = clean.drop_columns(x, POST_FEATURE_DROPS)
    x = derive.decompose_dates(x, clean.columns_of_kind(x, "datetime"), with_time=with_time)
    x = x.withColumn("flight_number", F.col("flight_number").cast("double").cast("int").cast("string"))
    x = clean.flag_to_int(x, ["is_night"])
    return clean.drop_incomplete(x)
