"""Scoring requests and evaluation tables (R19..R27)."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legflow.functions.nulls import uniform
from legflow.operators.derive import absolute_error, percentage_error
from legflow.operators.report import PERC_ERROR_EDGES

# The 32 predictors of a scoring request, in model order, and
# which of them must be real numbers or integers.
REQUEST_FIELDS = [
    "flight_number", "tail_number", "aircraft_model", "fleet", "origin_airport", "destination_airport",
    "origin_air_temperature", "origin_wind_direction", "origin_wind_speed", "origin_visibility",
    "origin_cloud_coverage", "origin_cloud_height", "destination_air_temperature", "destination_wind_direction",
    "destination_wind_speed", "destination_visibility", "destination_cloud_coverage", "destination_cloud_height",
    "scheduled_block_time", "is_night", "scheduled_rotation_time", "prev_delay_code",
    "scheduled_departure_date_year", "scheduled_departure_date_month", "scheduled_departure_date_day",
    "scheduled_departure_date_hour", "scheduled_departure_date_minute", "scheduled_arrival_date_year",
    "scheduled_arrival_date_month", "scheduled_arrival_date_day", "scheduled_arrival_date_hour",
    "scheduled_arrival_date_minute",
]
REQUEST_FLOATS = [
    "origin_air_temperature", "origin_wind_speed", "origin_visibility", "origin_cloud_height",
    "destination_air_temperature", "destination_wind_speed", "destination_visibility", "destination_cloud_height",
    "scheduled_rotation_time",
]
REQUEST_INTS = [
    "flight_number", "scheduled_block_time", "is_night", "scheduled_departure_date_year",
    "scheduled_departure_date_month", "scheduled_departure_date_day", "scheduled_departure_date_hour",
    "scheduled_departure_date_minute", "scheduled_arrival_date_year", "scheduled_arrival_date_month",
    "scheduled_arrival_date_day", "scheduled_arrival_date_hour", "scheduled_arrival_date_minute",
]


def validate_requests(df: DataFrame, key: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """(valid requests projected to model order and types, rejected with the
    first failing field and reason).  Text values are checked with ``try_cast``."""
    missing = [f for f in REQUEST_FIELDS if f not in df.columns]
    if missing:
        raise ValueError(f"request table lacks fields {missing}")
    reason = F.lit(None).cast("string")
    for f in reversed(REQUEST_INTS):
        txt = F.col(f).cast("string")
        as_d = txt.try_cast("double")
        bad = F.col(f).isNull() | as_d.isNull() | (as_d != F.floor(as_d))
        reason = F.when(bad, F.lit(f"{f}: not an integer")).otherwise(reason)
    for f in reversed(REQUEST_FLOATS):
        bad = F.col(f).isNull() | F.col(f).cast("string").try_cast("double").isNull()
        reason = F.when(bad, F.lit(f"{f}: not a number")).otherwise(reason)
    tagged = df.withColumn("__reason", reason)
    typed = []
    for f in REQUEST_FIELDS:
        if f in REQUEST_FLOATS:
            typed.append(F.col(f).cast("string").try_cast("double").alias(f))
        elif f in REQUEST_INTS:
            typed.append(F.col(f).cast("string").try_cast("double").cast("long").alias(f))
        else:
            typed.append(F.col(f).cast("string").alias(f))
    valid = tagged.where(F.col("__reason").isNull()).select(key, *typed)
    rejected = tagged.where(F.col("__reason").isNotNull()).select(key, F.col("__reason").alias("reason"))
    return valid, rejected


def test_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """MAE, RMSE, MAPE %, R2 % on rows with a non-zero label."""
    p = pred.where(F.col(label) != 0)
    err = F.col(label) - F.col(prediction)
    r = p.agg(F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
              (F.avg(F.abs(err) / F.abs(F.col(label))) * 100).alias("mape"),
              F.sum(err * err).alias("__sse"), (F.var_pop(label) * F.count(F.lit(1))).alias("__sst"))
    return r.select("mae", "rmse", "mape", ((1 - F.try_divide(F.col("__sse"), F.col("__sst"))) * 100).alias("r2"))


def abs_error_distribution(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Mean, population deviation, min, exact median, max of |error|, rounded to 2."""
    from legflow.operators.quantiles import quantiles

    e = pred.select(F.lit("abs_error").alias("g"), absolute_error(label, prediction).cast("double").alias("v"))
    med = quantiles(e, "g", "v", [0.5]).select("g", F.col("quantile").alias("median"))
    base = e.groupBy("g").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"),
                              F.max("v").alias("max"))
    out = base.join(med, "g")
    return out.select(*[F.bround(F.col(c), 2).alias(c) for c in ("mean", "std", "min", "median", "max")])


def percentage_error_bins(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                          edges: Sequence[int] = PERC_ERROR_EDGES) -> DataFrame:
    """Rows by percentage error in (0,2], (2,4] .. (18,20], (20,50], (50,100], > 100;
    per non-empty bin its share of all rows and MAE; an empty bin widens the
    next label (its lower bound is the last non-empty upper bound).  Zero error
    falls in no bin."""
    pe = percentage_error(label, prediction)
    b = F.lit(None).cast("int")
    for e in reversed(edges):
        b = F.when(pe <= e, F.lit(e)).otherwise(b)
    b = F.when(pe > edges[-1], F.lit(10 ** 9)).otherwise(b)
    x = pred.select(F.when(pe > 0, b).alias("__hi"), absolute_error(label, prediction).alias("__ae"))
    n = pred.count()
    g = x.where(F.col("__hi").isNotNull()).groupBy("__hi").agg(F.count(F.lit(1)).alias("n"),
                                                               F.avg("__ae").alias("mae"))
    w = Window.orderBy("__hi")  # at most len(edges) + 1 rows
    lo = F.coalesce(F.lag("__hi").over(w), F.lit(0))
    label_ = F.when(F.col("__hi") == 10 ** 9, F.concat(F.lit("> "), F.lit(str(edges[-1])))).otherwise(
        F.concat(lo.cast("string"), F.lit("-"), F.col("__hi").cast("string")))
    return g.select(label_.alias("bin"), F.col("__hi").alias("upper"), (F.col("n") * 100.0 / F.lit(n)).alias("pct"),
                    "mae", "n")


def residuals(pred: DataFrame, label: str = "label", prediction: str = "prediction", keep: Sequence[str] = ()):
    """R23."""
    return pred.select(*keep, prediction, (F.col(label) - F.col(prediction)).alias("residual"))


def feature_importances(spark, model, names: Sequence[str]) -> DataFrame:
    """Tree importances rounded to 3, only > 0, descending."""
    imp = model.featureImportances.toArray()
    rows = [(n, float(round(v, 3))) for n, v in zip(names, imp) if round(v, 3) > 0]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def bijections(n: int, count: int, seed: int = 0) -> list[tuple[int, int]]:
    """(a, b) of ``count`` maps place -> (a place + b) mod n that are one to one: a has no factor in common with n."""
    out = []
    for i in range(count):
        a = (0x9E3779B1 * (2 * (seed + i) + 1) + 0x85EBCA6B) % max(n, 1)
        while math.gcd(a, max(n, 1)) != 1:
            a += 1
        out.append((a, (0xC2B2AE35 * (seed + i + 1)) % max(n, 1)))
    return out


def permuted_columns(df: DataFrame, columns: Sequence[str], key: str, seed: int = 0, arithmetic: bool = False) -> DataFrame:
    """``df`` with ``__permuted_<column>``: for each column the values dealt anew, all in one exchange.

    Rows are numbered once, in a hash order of their key.  A column's donor at
    a place is an arithmetic bijection of it, so every row sends its value
    straight to the place that takes it.  Rows that share a key are ordered by
    their values, so the result does not depend on partitioning.
    """
    from legflow.operators.clean import with_dense_key
    from legflow.session import written

    u = uniform(key, seed) if arithmetic else F.xxhash64(key, F.lit(seed))
    rows = df.withColumn("__u", u)
    placed = written(with_dense_key(rows, ["__u", key, *[c for c in columns if c != key]], "__place").drop("__u"), "placed")
    n = placed.count()
    maps = bijections(n, len(columns), seed)
    # place p takes the value of place (a p + b) mod n, so place q gives its value to (q - b) / a mod n
    gives = []
    for i, (c, (a, b)) in enumerate(zip(columns, maps)):
        back = pow(a, -1, n) if n > 1 else 0
        to = F.expr(f"cast(pmod((cast(__place as decimal(19, 0)) - {b}) * cast({back} as decimal(18, 0)), cast({max(n, 1)} as decimal(18, 0))) as bigint)")
        gives.append(F.struct(to.alias("place"), F.lit(i).alias("i"), F.col(c).cast("double").alias("v")))
    given = placed.select(F.explode(F.array(*gives)).alias("g")).select("g.*").groupBy("place").agg(
        *[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"__permuted_{c}") for i, c in enumerate(columns)])
    return placed.join(given, placed["__place"] == given["place"]).drop("__place", "place")


def permuted(df: DataFrame, column: str, key: str, seed: int = 0) -> DataFrame:
    """``df`` with the values of ``column`` dealt anew."""
    kind = df.schema[column].dataType
    out = permuted_columns(df, [column], key, seed)
    return out.withColumn(column, F.col(f"__permuted_{column}").cast(kind)).select(df.columns)


def permutation_importance(pred_fn, df: DataFrame, features: Sequence[str], key: str, label: str = "label",
                           seed: int = 0, rounded: bool = True) -> DataFrame:
    """Drop in R2 when one feature column is permuted (one round, seeded),
    normalised by the sum, rounded to 3, only > 0, descending (``rounded`` False:
    the drops themselves).  Rows are numbered and dealt once for all features; the model then scores them as a map."""
    from legflow.session import written

    x = written(permuted_columns(df, features, key, seed), "permuted")

    def errors(d, name):
        return pred_fn(d).agg(F.sum((F.col(label) - F.col("prediction")) ** 2).alias("sse"),
                              (F.var_pop(label) * F.count(F.lit(1))).alias("sst")).select(F.lit(name).alias("feature"), "sse", "sst")

    # one job: the rows as they are, and once for each feature with its values dealt anew
    parts = [errors(x, None)] + [errors(x.withColumn(f, F.col(f"__permuted_{f}")), f) for f in features]
    got = {r["feature"]: (1 - r["sse"] / r["sst"] if r["sst"] else 0.0) for r in functools.reduce(DataFrame.unionByName, parts).collect()}
    drops = [(f, got[None] - got[f]) for f in features]
    if not rounded:
        return df.sparkSession.createDataFrame([(f, float(d)) for f, d in drops], "feature string, importance double")
    total = sum(d for _, d in drops) or 1.0
    rows = [(f, float(round(d / total, 3))) for f, d in drops if round(d / total, 3) > 0]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def share_below(pred: DataFrame, bounds: Sequence[float] = (5.0, 2.6), label: str = "label",
                prediction: str = "prediction") -> DataFrame:
    """Share of rows whose absolute error is below each bound."""
    ae = absolute_error(label, prediction)
    return pred.agg(*[F.avg(F.when(ae < b, 1.0).otherwise(0.0)).alias(f"below_{str(b).replace('.', '_')}")
                      for b in bounds])


def actual_vs_predicted(pred: DataFrame, label: str = "label", prediction: str = "prediction"):
    """The scatter table and its diagonal bounds (min and max of actual)."""
    table = pred.select(F.col(label).alias("actual"), F.col(prediction).alias("predicted"))
    bounds = pred.agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
    return table, bounds
