"""Derived attributes: durations, delays, calendar parts, codes and sequence features.

Survey rows T1..T19 and W1..W4 (T20 lives with the estimators).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legflow.functions.nulls import col_, half_even_minutes, keep_unless
from legflow.operators.sequence import previous_values

# 16 compass points, clockwise from north.
COMPASS_POINTS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE",
                  "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]
# The leg timestamps decomposed for modelling.
MODEL_DATE_COLUMNS = ["scheduled_departure_date", "off_block_date", "take_off_date",
                      "landing_date", "on_block_date", "scheduled_arrival_date"]
DATE_PARTS = ["year", "month", "day", "hour", "minute"]


# ------------------------------------------------------------------ durations

def minutes(start, end) -> Column:
    """Half-even rounded minutes from ``start`` to ``end``."""
    return half_even_minutes(start, end)


def _clamped_delay(start: str, end: str) -> Column:
    m = minutes(start, end)
    return F.when(m.isNotNull(), F.greatest(m, F.lit(0)))


def add_departure_delay(df: DataFrame) -> DataFrame:
    """Off-block minus scheduled departure, negatives to 0 (NULL stays NULL)."""
    return df.withColumn("departure_delay", _clamped_delay("scheduled_departure_date", "off_block_date"))


def add_arrival_delay(df: DataFrame) -> DataFrame:
    """On-block minus scheduled arrival, negatives to 0."""
    return df.withColumn("arrival_delay", _clamped_delay("scheduled_arrival_date", "on_block_date"))


def _duration(df: DataFrame, name: str, start: str, end: str, drop_when: Column) -> DataFrame:
    return df.where(keep_unless(drop_when)).withColumn(name, minutes(start, end))


def add_air_time(df: DataFrame) -> DataFrame:
    """T4: landing - take-off; rows with landing <= take-off dropped."""
    return _duration(df, "air_time", "take_off_date", "landing_date",
                     F.col("landing_date") <= F.col("take_off_date"))


def add_taxi_out(df: DataFrame) -> DataFrame:
    """T5: take-off - off-block; rows with take-off < off-block dropped."""
    return _duration(df, "taxi_out", "off_block_date", "take_off_date",
                     F.col("take_off_date") < F.col("off_block_date"))


def add_taxi_in(df: DataFrame) -> DataFrame:
    """On-block - landing; rows with on-block < landing dropped."""
    return _duration(df, "taxi_in", "landing_date", "on_block_date",
                     F.col("on_block_date") < F.col("landing_date"))


def add_actual_block_time(df: DataFrame) -> DataFrame:
    """On-block - off-block; rows with on-block <= off-block dropped."""
    return _duration(df, "actual_block_time", "off_block_date", "on_block_date",
                     F.col("on_block_date") <= F.col("off_block_date"))


def add_scheduled_block_time(df: DataFrame) -> DataFrame:
    """Scheduled arrival - departure; rows with arrival <= departure dropped."""
    return _duration(df, "scheduled_block_time", "scheduled_departure_date", "scheduled_arrival_date",
                     F.col("scheduled_arrival_date") <= F.col("scheduled_departure_date"))


def add_targets(df: DataFrame) -> DataFrame:
    """Air time, taxi-out, taxi-in, actual block time, in that order."""
    return df.transform(add_air_time).transform(add_taxi_out).transform(add_taxi_in) \
        .transform(add_actual_block_time)


def add_is_night(df: DataFrame, col: str = "scheduled_departure_date") -> DataFrame:
    """Scheduled hour >= 21 or <= 3."""
    h = F.hour(col)
    return df.withColumn("is_night", (h >= 21) | (h <= 3))


# ------------------------------------------------------------------ calendar parts

def has_time_of_day(df: DataFrame, cols: Sequence[str]) -> dict[str, bool]:
    """Per column: does any value carry a time of day (or is missing)?  One aggregation."""
    row = df.agg(*[F.bool_or(F.coalesce(F.col(c) != F.date_trunc("DAY", F.col(c)), F.lit(True))).alias(c)
                   for c in cols]).first()
    return {c: bool(row[c]) for c in cols}


def decompose_dates(df: DataFrame, cols: Sequence[str] = MODEL_DATE_COLUMNS,
                    with_time: dict[str, bool] | None = None) -> DataFrame:
    """Year / month / day (+ hour / minute unless every value is midnight),
    source column dropped.  ``with_time`` skips the scan when known."""
    cols = [c for c in cols if c in df.columns]
    with_time = with_time if with_time is not None else has_time_of_day(df, cols)
    parts = {}
    for c in cols:
        parts[f"{c}_year"] = F.year(c)
        parts[f"{c}_month"] = F.month(c)
        parts[f"{c}_day"] = F.dayofmonth(c)
        if with_time[c]:
            parts[f"{c}_hour"] = F.hour(c)
            parts[f"{c}_minute"] = F.minute(c)
    return df.withColumns(parts).drop(*cols)


def _decomposed(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for c in df.columns:
        if "_" in c:
            name, part = c.rsplit("_", 1)
            if name in cols and part in DATE_PARTS:
                found.setdefault(name, []).append(c)
    return found


def reconstruct_dates(df: DataFrame, cols: Sequence[str] = MODEL_DATE_COLUMNS) -> DataFrame:
    """Rebuild timestamps from their parts (absent hour / minute = 0)."""
    found = _decomposed(df, cols)
    out = df
    for name, parts in found.items():
        def p(part):
            c = f"{name}_{part}"
            return F.col(c).cast("int") if c in parts else F.lit(0)
        out = out.withColumn(name, F.make_timestamp_ntz(p("year"), p("month"), p("day"), p("hour"), p("minute"),
                                                         F.lit(0))).drop(*parts)
    return out


def remove_decomposed_dates(df: DataFrame, cols: Sequence[str] = MODEL_DATE_COLUMNS) -> DataFrame:
    """T13."""
    found = _decomposed(df, cols)
    return df.drop(*[c for parts in found.values() for c in parts])


# ------------------------------------------------------------------ codes

def compass_point(degrees) -> Column:
    """Degrees to one of 16 points; NULL stays NULL."""
    d = col_(degrees).cast("double")
    idx = F.pmod(((d + F.lit(11.25)) / F.lit(22.5) - F.lit(0.02)).cast("int"), F.lit(16))
    return F.when(d.isNotNull(), F.element_at(F.array(*[F.lit(x) for x in COMPASS_POINTS]), idx + 1))


def bin_wind_directions(df: DataFrame, cols: Sequence[str] = ("origin_wind_direction",
                                                                "destination_wind_direction")) -> DataFrame:
    return df.withColumns({c: compass_point(c) for c in cols if c in df.columns})


def rebuild_delay_codes(df: DataFrame, code: str = "delay_code", sub: str = "delay_sub_code") -> DataFrame:
    """Both missing -> '0'; both present -> code + sub-code (just code when
    the sub-code is '0'); only code -> code as text; only sub-code -> NULL.
    The sub-code column is dropped."""
    c = F.col(code)
    code_txt = c.cast("double").cast("int").cast("string")
    s = F.col(sub).cast("string")
    out = (F.when(c.isNull() & s.isNull(), F.lit("0"))
           .when(c.isNotNull() & s.isNotNull(), F.when(s != "0", F.concat(code_txt, s)).otherwise(code_txt))
           .when(c.isNotNull(), code_txt))
    return df.withColumn(code, out).drop(sub)


# ------------------------------------------------------------------ arithmetic

def min_max_bounds(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Bounds for T16/T17: one row, ``<c>__min`` and ``<c>__max``."""
    return df.agg(*[e for c in cols for e in (F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max"))])


def _bounds_row(df: DataFrame, cols: Sequence[str], bounds) -> dict:
    """Fitted bounds as a small dict (2 numbers per column), computed once."""
    if bounds is None:
        bounds = min_max_bounds(df, cols)
    return bounds.first().asDict() if isinstance(bounds, DataFrame) else dict(bounds)


def normalise(df: DataFrame, cols: Sequence[str], bounds=None) -> DataFrame:
    """(x - min) / (max - min); a constant column gives NULL (0/0)."""
    b = _bounds_row(df, cols, bounds)
    return df.withColumns({c: F.try_divide(F.col(c) - F.lit(b[f"{c}__min"]),
                                           F.lit(b[f"{c}__max"]) - F.lit(b[f"{c}__min"])) for c in cols})


def revert_normalisation(df: DataFrame, cols: Sequence[str], bounds) -> DataFrame:
    """X * (max - min) + min, with the bounds of T16."""
    b = _bounds_row(df, cols, bounds)
    return df.withColumns({c: F.col(c) * (F.lit(b[f"{c}__max"]) - F.lit(b[f"{c}__min"])) + F.lit(b[f"{c}__min"])
                           for c in cols})


def percentage_error(label="label", prediction="prediction") -> Column:
    """|pred - true| / |true| * 100 (NULL when true is 0)."""
    return F.try_divide(F.abs(col_(prediction) - col_(label)), F.abs(col_(label))) * F.lit(100.0)


def absolute_error(label="label", prediction="prediction") -> Column:
    return F.abs(col_(label) - col_(prediction))


def pair_label(a, b, sep: str = "-") -> Column:
    """T19: 'A-B'."""
    return F.concat_ws(sep, col_(a), col_(b))


def split_part(c, sep: str, index: int) -> Column:
    """1-based part of a split (NULL when absent)."""
    return F.element_at(F.split(col_(c), F.lit(sep)), F.lit(index)) if index > 0 else None


def name_before_last_underscore(c) -> Column:
    """T19: 'a_b_c' -> 'a_b'."""
    return F.regexp_extract(col_(c), r"^(.*)_[^_]*$", 1)


def name_after_last_underscore(c) -> Column:
    return F.regexp_extract(col_(c), r"_([^_]*)$", 1)


# ------------------------------------------------------------------ windows

def add_scheduled_rotation_time(df: DataFrame, key: str = "tail_number", tie: str = "leg_id",
                                drop_null_keys: bool = False, bucket_minutes: int = 7 * 24 * 60) -> DataFrame:
    """Minutes from the vehicle's previous scheduled arrival to this
    scheduled departure, half-even; 0 when there is no previous leg."""
    x = previous_values(df, [key], ["scheduled_departure_date", tie], ["scheduled_arrival_date"],
                        ["__prev_arr"], bucket_minutes=bucket_minutes, drop_null_keys=drop_null_keys)
    rot = F.coalesce(minutes("__prev_arr", "scheduled_departure_date").cast("double"), F.lit(0.0))
    return x.withColumn("scheduled_rotation_time", rot).drop("__prev_arr")


def add_previous_delay_code(df: DataFrame, key: str = "tail_number", tie: str = "leg_id",
                            code: str = "delay_code", drop_null_keys: bool = False,
                            bucket_minutes: int = 7 * 24 * 60) -> DataFrame:
    """The vehicle's previous leg's delay code; none (or NULL) -> 'no_delay'."""
    x = previous_values(df, [key], ["scheduled_departure_date", tie], [code], ["__prev_code"],
                        bucket_minutes=bucket_minutes, drop_null_keys=drop_null_keys)
    return x.withColumn("prev_delay_code", F.coalesce(F.col("__prev_code").cast("string"), F.lit("no_delay"))) \
        .drop("__prev_code")


def add_rotation_features(df: DataFrame, key: str = "tail_number", tie: str = "leg_id",
                          code: str = "delay_code", bucket_minutes: int = 7 * 24 * 60) -> DataFrame:
    """W1 + W2 in one pass (one shuffle instead of two)."""
    x = previous_values(df, [key], ["scheduled_departure_date", tie], ["scheduled_arrival_date", code],
                        ["__prev_arr", "__prev_code"], bucket_minutes=bucket_minutes)
    rot = F.coalesce(minutes("__prev_arr", "scheduled_departure_date").cast("double"), F.lit(0.0))
    return (x.withColumn("scheduled_rotation_time", rot)
            .withColumn("prev_delay_code", F.coalesce(F.col("__prev_code").cast("string"), F.lit("no_delay")))
            .drop("__prev_arr", "__prev_code"))


def running_total(df: DataFrame, value: str, order: str, name: str) -> DataFrame:
    """Cumulative sum in ``order`` (for small frames such as per-component variance)."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def share_within(df: DataFrame, count_col: str, group: Sequence[str], name: str = "share") -> DataFrame:
    """Count / group total."""
    w = Window.partitionBy(*group)
    return df.withColumn(name, F.col(count_col) / F.sum(count_col).over(w))
