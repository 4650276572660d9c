"""Projection, type repair, row filters, de-duplication and ordering.

Survey rows P1..P13, C1..C13, D1..D6.  Every function takes a DataFrame
and returns one; all of them are lazy and chain with ``df.transform``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from legflow.functions.nulls import keep_unless, to_double, to_timestamp_ntz
from legflow.session import ensure_checkpoint_dir

# ------------------------------------------------------------------ fixed values
# Fixed values that must equal the reference's for the same results.
# Columns the builder drops from the raw leg export (upper-case raw names).
RAW_IRRELEVANT_COLUMNS = [
    "Unnamed: 0", "CARR_CD", "EET", "TAXI_TIME_OUT", "TAXI_TIME_IN",
    "EST_OFFBLK_DATE", "EST_AIRB_DATE", "EST_LNDNG_DATE", "EST_ONBLK_DATE", "BUS_SEATS",
    "BUS_SALE_SEATS", "ECON_SEATS", "ECON_SALE_SEATS", "FLEG_STAT", "DLY_REMARKS",
    "DLY_DESCRIPTION",
]
# Raw to working names of the leg export.
RAW_RENAMES = {
    "FLT_DATE": "flight_date", "FLT_NBR": "flight_number", "AIRC_REG": "tail_number",
    "ACTYP_CD": "aircraft_type_code", "DESCR": "aircraft_model", "FMLY_CD": "fleet",
    "FROM_AIRP_CD": "origin_airport", "TO_AIRP_CD": "destination_airport",
    "SCHD_DEP_DATE": "scheduled_departure_date", "SCHD_ARR_DATE": "scheduled_arrival_date",
    "ACTL_OFFBLK_DATE": "off_block_date", "ACTL_AIRB_DATE": "take_off_date",
    "ACTL_LNDNG_DATE": "landing_date", "ACTL_ONBLK_DATE": "on_block_date",
    "SRVCE_TYP": "service_type", "AIRC_OWNR_CD": "aircraft_owner_code",
    "DLY_REGISTERED_DATE_TIME": "registered_delay_date", "DLY_MINS": "delay_minutes",
    "DLY_CD": "delay_code", "DLY_SUB_CD": "delay_sub_code",
}
# Leg timestamp columns (working names).
LEG_DATE_COLUMNS = [
    "flight_date", "scheduled_departure_date", "scheduled_arrival_date", "off_block_date",
    "take_off_date", "landing_date", "on_block_date", "registered_delay_date",
]
# Fleet regrouping: narrow-body family codes and type-code overrides.
NB_FAMILY_ALIASES = ["PGA", "WI"]
NB_TYPE_CODES = ["M83", "738", "752", "737", "757", "734", "BEH", "ER4", "100", "AT4"]
WB_TYPE_CODES = ["772", "763", "744", "342", "313", "345"]
# Sky-cover sentinels meaning "missing".
SKY_COVER_SENTINELS = ["M", "///"]
# Columns removed per label before modelling (only pre-departure facts stay).
TARGET_DROPS = {
    "taxi_in": ["origin_cloud_height", "origin_cloud_coverage", "origin_wind_direction",
                "origin_wind_speed", "origin_air_temperature", "origin_visibility",
                "actual_block_time", "air_time", "taxi_out"],
    "taxi_out": ["destination_cloud_height", "destination_cloud_coverage",
                 "destination_wind_direction", "destination_wind_speed",
                 "destination_air_temperature", "destination_visibility",
                 "actual_block_time", "air_time", "taxi_in"],
    "air_time": ["taxi_in", "taxi_out", "actual_block_time"],
    "actual_block_time": ["taxi_in", "taxi_out", "air_time"],
}
TARGETS = list(TARGET_DROPS)
# Duration segments in minutes: narrow-body haul < 360, wide-body >= 360.
WIDE_BODY_MINUTES = 360


# ------------------------------------------------------------------ P: columns

def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """P1."""
    return df.drop(*[c for c in cols if c in df.columns])


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename present columns; absent ones are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def prefix_columns(df: DataFrame, prefix: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Prefix ``cols`` (default all) and keep the others."""
    chosen = set(cols if cols is not None else df.columns)
    return df.select([F.col(c).alias(prefix + c) if c in chosen else F.col(c) for c in df.columns])


def add_empty_columns(df: DataFrame, columns: Mapping[str, str | T.DataType]) -> DataFrame:
    """Typed all-NULL columns for a later enrichment."""
    return df.withColumns({n: F.lit(None).cast(t) for n, t in columns.items()})


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    """P5: names of 'numeric', 'categorical' (string), 'datetime' or 'boolean' columns."""
    tests = {
        "numeric": lambda t: isinstance(t, T.NumericType),
        "categorical": lambda t: isinstance(t, T.StringType),
        "datetime": lambda t: isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)),
        "boolean": lambda t: isinstance(t, T.BooleanType),
    }
    test = tests[kind]
    return [f.name for f in df.schema.fields if test(f.dataType)]


def select_kind(df: DataFrame, kind: str) -> DataFrame:
    return df.select(columns_of_kind(df, kind))


def coerce_numeric(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Text or number to double; bad values and NaN to NULL."""
    return df.withColumns({c: to_double(c) for c in cols})


def coerce_timestamps(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """To timestamp without zone; bad values to NULL."""
    return df.withColumns({c: to_timestamp_ntz(c) for c in cols})


def number_to_code_text(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Number -> integer (truncating) -> string code."""
    return df.withColumns({c: F.col(c).cast("int").cast("string") for c in cols})


def flag_to_int(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Boolean flag -> 0/1."""
    return df.withColumns({c: F.col(c).cast("int") for c in cols})


def prepare_for_target(df: DataFrame, target: str, fleet_type: str = "whole",
                       drop_nulls: bool = False, label_col: str = "label") -> DataFrame:
    """P10 (+C7): keep what is known before the ``target`` is observed.

    Segment filter first (on actual block time), then drop the columns not
    known for that target, then rename the target to ``label_col``.
    ``drop_nulls`` gives the second form, which removes incomplete rows first.
    """
    if target not in TARGET_DROPS:
        raise ValueError(f"unknown target {target!r}; expected one of {TARGETS}")
    if drop_nulls:
        df = df.dropna("any")
    df = duration_segment(df, fleet_type)
    return drop_columns(df, TARGET_DROPS[target]).withColumnRenamed(target, label_col)


def drop_sparse_columns(df: DataFrame, threshold: float) -> DataFrame:
    """Keep columns whose missing ratio is strictly below ``threshold``.

    One aggregation computes every ratio; the projection is then static.
    """
    ratios = missing_ratios(df).first().asDict()
    return df.select([c for c in df.columns if ratios[c] < threshold])


def missing_ratios(df: DataFrame) -> DataFrame:
    """One row: per column, share of NULL (and NaN for floating columns)."""
    return df.agg(*[F.avg(is_missing(df, c).cast("double")).alias(c) for c in df.columns])


def is_missing(df: DataFrame, c: str) -> Column:
    dtype = df.schema[c].dataType
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.col(c).isNull() | F.isnan(F.col(c))
    return F.col(c).isNull()


def align_columns(a: DataFrame, b: DataFrame, fill: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Add to each side the indicator columns only the other side has, as ``fill``."""
    only_b = [c for c in b.columns if c not in a.columns]
    only_a = [c for c in a.columns if c not in b.columns]
    a2 = a.withColumns({c: F.lit(fill).cast("double") for c in only_b})
    b2 = b.withColumns({c: F.lit(fill).cast("double") for c in only_a})
    return a2, b2.select(a2.columns)


def with_dense_key(df: DataFrame, order_cols: Sequence[str], name: str = "row_key") -> DataFrame:
    """Dense 0-based key following a total order of ``order_cols``.

    A range-partitioned sort gives the order; each partition's offset comes
    from a per-partition count (as many rows as partitions), so no single
    task ever sees all rows.  The ranged rows are written once before they are
    counted: range bounds are sampled, and partitions may be coalesced, so two
    evaluations of the same exchange need not agree on partition numbers.
    ``order_cols`` must be unique for a stable key.
    """
    ensure_checkpoint_dir(df.sparkSession)
    sorted_df = df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
    tagged = sorted_df.withColumn("__pid", F.spark_partition_id()).withColumn(
        "__pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).checkpoint()
    sizes = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.withColumn(
        "__off", F.coalesce(F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)),
                            F.lit(0)))
    out = tagged.join(F.broadcast(offsets.select("__pid", "__off")), "__pid")
    return out.withColumn(name, F.col("__off") + F.col("__pos")).drop("__pid", "__pos", "__off")


# ------------------------------------------------------------------ C: rows

def keep_delayed(df: DataFrame, code_col: str = "delay_code") -> DataFrame:
    """Only legs with a delay code."""
    return df.where(F.col(code_col).isNotNull())


# C2 rules, in the order they are audited.  Bounds are strict or not exactly as
# the reference writes them.
MALFORMED_RULES: list[tuple[str, str]] = [
    ("same_endpoints", "origin_airport = destination_airport"),
    ("no_take_off", "take_off_date IS NULL"),
    ("no_landing", "landing_date IS NULL"),
    ("training_service", "service_type = 'K'"),
    ("off_block_after_take_off", "off_block_date > take_off_date"),
    ("take_off_not_before_landing", "take_off_date >= landing_date"),
    ("landing_after_on_block", "landing_date > on_block_date"),
]


def first_failed_rule(rules: Sequence[tuple[str, str]] = MALFORMED_RULES) -> Column:
    """Name of the first rule a row breaks, NULL when it breaks none (NULL condition = not broken)."""
    expr = None
    for name, cond in reversed(rules):
        hit = F.coalesce(F.expr(cond), F.lit(False))
        expr = F.when(hit, F.lit(name)) if expr is None else F.when(hit, F.lit(name)).otherwise(expr)
    return expr


def remove_malformed(df: DataFrame, rules: Sequence[tuple[str, str]] = MALFORMED_RULES) -> DataFrame:
    """Drop rows that break any rule; rules applied in order."""
    cond = F.lit(True)
    for _, rule in rules:
        cond = cond & keep_unless(F.expr(rule))
    return df.where(cond)


def malformed_report(df: DataFrame, rules: Sequence[tuple[str, str]] = MALFORMED_RULES) -> DataFrame:
    """C2 audit: rows removed by each rule when the rules run in order, plus rows kept."""
    tagged = df.select(F.coalesce(first_failed_rule(rules), F.lit("kept")).alias("rule"))
    return tagged.groupBy("rule").agg(F.count(F.lit(1)).alias("n_rows"))


def null_audit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Number of NULL values per column, long form (column, n_null)."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "column", "n_null")


def drop_where_equal(df: DataFrame, col: str, value) -> DataFrame:
    """C4: drop rows equal to ``value``; NULL kept (Q1)."""
    return df.where(keep_unless(F.col(col) == F.lit(value)))


def keep_where_equal(df: DataFrame, col: str, value) -> DataFrame:
    """C4: drop rows not equal to ``value``; NULL dropped too."""
    return df.where(F.col(col) == F.lit(value))


def weather_outlier_removal(df: DataFrame, max_wind: float = 30, max_cloud_height: float = 10000,
                            max_visibility: float = 100) -> DataFrame:
    """Drop implausible weather; a NULL reading never drops a row."""
    bad = []
    for end in ("origin", "destination"):
        bad.append(F.col(f"{end}_wind_speed") >= max_wind)
        h = F.col(f"{end}_cloud_height")
        bad.append((h >= max_cloud_height) | (h == 0))
    v = F.col("destination_visibility")
    bad.append((v >= max_visibility) | (v == 0))
    cond = F.lit(True)
    for b in bad:
        cond = cond & keep_unless(b)
    return df.where(cond)


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """C6."""
    return df.dropna("any", subset=subset)


def duration_segment(df: DataFrame, fleet_type: str = "whole", col: str = "actual_block_time") -> DataFrame:
    """C7: 'whole', 'nb' (< 360 min) or 'wb' (>= 360 min); either case accepted."""
    kind = fleet_type.lower()
    if kind == "whole":
        return df
    if kind == "nb":
        return df.where(F.col(col) < WIDE_BODY_MINUTES)
    if kind == "wb":
        return df.where(F.col(col) >= WIDE_BODY_MINUTES)
    raise ValueError(f"unknown fleet type {fleet_type!r}")


def nonzero_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """C8."""
    return df.where(F.col(label) != 0)


def in_calendar_period(df: DataFrame, col: str, year: int, month: int | None = None,
                       day: int | None = None) -> DataFrame:
    """Rows of one year / month / day, written as a half-open range so
    parquet statistics and partition values prune the scan."""
    import datetime as _dt

    if month is None:
        lo, hi = _dt.datetime(year, 1, 1), _dt.datetime(year + 1, 1, 1)
    elif day is None:
        lo = _dt.datetime(year, month, 1)
        hi = _dt.datetime(year + (month == 12), month % 12 + 1, 1)
    else:
        lo = _dt.datetime(year, month, day)
        hi = lo + _dt.timedelta(days=1)
    c = F.col(col)
    dtype = df.schema[col].dataType
    cast_to = "timestamp_ntz" if isinstance(dtype, T.TimestampNTZType) else (
        "date" if isinstance(dtype, T.DateType) else "timestamp")
    lo_l = F.lit(lo.isoformat(sep=" ")).cast(cast_to)
    hi_l = F.lit(hi.isoformat(sep=" ")).cast(cast_to)
    return df.where((c >= lo_l) & (c < hi_l))


def complete_numeric_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows whose numeric columns are all present and not NaN."""
    cols = list(cols) if cols is not None else columns_of_kind(df, "numeric")
    cond = F.lit(True)
    for c in cols:
        cond = cond & ~is_missing(df, c)
    return df.where(cond)


def sentinel_to_null(df: DataFrame, cols: Sequence[str], sentinels: Sequence[str] = SKY_COVER_SENTINELS) -> DataFrame:
    """C11."""
    return df.withColumns({c: F.when(~F.col(c).isin(*sentinels) | F.col(c).isNull(), F.col(c)) for c in cols})


def regroup_fleet(df: DataFrame, fleet_col: str = "fleet", type_col: str = "aircraft_type_code",
                  nb_aliases: Sequence[str] = NB_FAMILY_ALIASES, nb_codes: Sequence[str] = NB_TYPE_CODES,
                  wb_codes: Sequence[str] = WB_TYPE_CODES) -> DataFrame:
    """Alias families to 'NB', then type codes override the fleet."""
    fleet = F.when(F.col(fleet_col).isin(*nb_aliases), F.lit("NB")).otherwise(F.col(fleet_col))
    fleet = (F.when(F.col(type_col).isin(*wb_codes), F.lit("WB"))
             .when(F.col(type_col).isin(*nb_codes), F.lit("NB"))
             .otherwise(fleet))
    return df.withColumn(fleet_col, fleet)


def residual_outliers(df: DataFrame, attr: str, bound: float = 100, label: str = "label",
                      prediction: str = "prediction") -> DataFrame:
    """Rows whose absolute residual exceeds ``bound``, with one attribute."""
    res = F.col(label) - F.col(prediction)
    return df.where(F.abs(res) > bound).select(attr, F.col(label), F.col(prediction), res.alias("residual"))


# ------------------------------------------------------------------ D: dedupe, order

def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """D1 (hash aggregate with map-side combine)."""
    return df.dropDuplicates()


def latest_per_key(df: DataFrame, keys: Sequence[str], time_col: str) -> DataFrame:
    """One row per business key, the one with the latest ``time_col``;
    a NULL time loses; remaining ties go to the greatest full row.

    Written as an aggregation (``max`` of a struct led by the time) rather
    than a window: partial aggregation collapses a hot key on the map side,
    so no task ever holds all rows of one key.
    """
    others = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(F.col(time_col).alias("__t"), *[F.col(c) for c in others])).alias("__best")
    return (df.groupBy(*keys).agg(best)
            .select(*keys, *[F.col(f"__best.{c}").alias(c) for c in others])
            .select(df.columns))


def distinct_values(df: DataFrame, cols: Sequence[str], name: str = "value") -> DataFrame:
    """D3: distinct values found in any of ``cols``."""
    parts = [df.select(F.col(c).alias(name)) for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def union_renamed(frames: Sequence[tuple[DataFrame, Mapping[str, str]]], label_col: str | None = None,
                  labels: Sequence[str] | None = None) -> DataFrame:
    """Rename each frame to a shared vocabulary, then union by name."""
    out = None
    for i, (f, mapping) in enumerate(frames):
        g = rename_columns(f, mapping)
        if label_col:
            g = g.withColumn(label_col, F.lit(labels[i]))
        out = g if out is None else out.unionByName(g, allowMissingColumns=True)
    return out


def sort_by(df: DataFrame, col: str, ascending: bool = True, tie: Sequence[str] = ()) -> DataFrame:
    """D5."""
    first = F.col(col).asc_nulls_last() if ascending else F.col(col).desc_nulls_last()
    return df.orderBy(first, *[F.col(t) for t in tie])


def top_k(df: DataFrame, col: str, k: int, tie: Sequence[str]) -> DataFrame:
    """K largest by ``col``; ``tie`` makes the cut deterministic."""
    return df.orderBy(F.col(col).desc_nulls_last(), *[F.col(t) for t in tie]).limit(k)
