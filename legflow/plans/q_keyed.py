"""Row-level twins of queries that return only counts: which rows are kept, masked or dealt where."""

from __future__ import annotations

from pyspark.sql import functions as F

from legflow.functions.nulls import uniform_sql
from legflow.operators import clean, derive, impute, model
from legflow.plans.catalog import register, targets_cte
from legflow.plans.q_core import _WX_NUM
from legflow.plans.q_ml import _IMP, _IMP_SQL, _TRUTH_SQL, _bench, _imp_frame, _mask_sql
from legflow.sources import fixtures as fx

_MASKED = ["fleet", "tail_number", "take_off_date"]
_TARGETS = "WITH " + targets_cte("legs", "tg")
_BENCH_SQL = _TARGETS + "," + _IMP_SQL + "," + _TRUTH_SQL


@register("d1_distinct_rows", """
SELECT leg_id, flight_number, origin_airport, destination_airport, tail_number, registered_delay_date,
       CAST(delay_code AS DOUBLE) AS delay_code, delay_sub_code, count(*) AS n_rows
FROM (SELECT DISTINCT * FROM raw_legs) GROUP BY ALL
""")
def d1_rows(spark, sf):
    keys = ["leg_id", "flight_number", "origin_airport", "destination_airport", "tail_number", "registered_delay_date", "delay_code",
            "delay_sub_code"]
    rows = clean.drop_exact_duplicates(fx.raw_legs(spark, sf)).withColumn("delay_code", F.col("delay_code").cast("double"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


@register("c1_delayed_legs", "SELECT leg_id, delay_code FROM legs WHERE delay_code IS NOT NULL")
def c1_legs(spark, sf):
    return clean.keep_delayed(fx.legs(spark, sf)).select("leg_id", "delay_code")


@register("c6_complete_legs", "SELECT leg_id, tail_number, fleet, delay_minutes FROM legs WHERE tail_number IS NOT NULL AND fleet IS NOT NULL "
          "AND take_off_date IS NOT NULL AND landing_date IS NOT NULL AND delay_code IS NOT NULL "
          "AND delay_sub_code IS NOT NULL AND delay_minutes IS NOT NULL")
def c6_legs(spark, sf):
    return clean.drop_incomplete(fx.legs(spark, sf)).select("leg_id", "tail_number", "fleet", "delay_minutes")


@register("c8_nonzero_label_rows", _TARGETS + " SELECT leg_id, taxi_in AS label FROM tg WHERE taxi_in <> 0")
def c8_rows(spark, sf):
    t = derive.add_targets(fx.legs(spark, sf)).withColumnRenamed("taxi_in", "label")
    return clean.nonzero_labels(t).select("leg_id", "label")


@register("c10_complete_numeric_observations", "SELECT * FROM (SELECT feed_seq, " + ", ".join(
    f"CASE WHEN isnan(TRY_CAST({c} AS DOUBLE)) THEN NULL ELSE TRY_CAST({c} AS DOUBLE) END AS {c}" for c in _WX_NUM)
    + " FROM weather_obs) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _WX_NUM))
def c10_rows(spark, sf):
    return clean.complete_numeric_rows(clean.coerce_numeric(fx.weather_obs(spark, sf), _WX_NUM).select("feed_seq", *_WX_NUM))


@register("m1_injected_cells", _TARGETS + "," + _IMP_SQL + " SELECT leg_id, " + ", ".join(
    f"{_mask_sql(c, i + 1, 0, 0.3)} AS {c}" for i, c in enumerate(_IMP)) + " FROM tg0")
def m1_cells(spark, sf):
    return impute.inject_nulls(_imp_frame(spark, sf), _IMP, 0.3, "leg_id", seed=0, arithmetic=True)


@register("m2_benchmark_rows", _BENCH_SQL + " SELECT t.leg_id, " + ", ".join(
    f"t.{c} AS {c}, i.{c} AS {c}_given" for c in _IMP) + " FROM truth t JOIN inc i USING (leg_id)")
def m2_rows(spark, sf):
    inc, truth, _ = _bench(spark, sf)
    given = inc.select("leg_id", *[F.col(c).alias(f"{c}_given") for c in _IMP])
    return truth.select("leg_id", *_IMP).join(given, "leg_id")


@register("m3_mask_rows", "SELECT leg_id, " + ", ".join(f"{c} IS NULL AS {c}__missing" for c in _MASKED) + " FROM legs")
def m3_rows(spark, sf):
    return impute.missing_mask(fx.legs(spark, sf), _MASKED, "leg_id")


@register("m14_rows_left", _BENCH_SQL + " SELECT leg_id, " + ", ".join(_IMP) + " FROM inc WHERE "
          + " AND ".join(f"{c} IS NOT NULL" for c in _IMP))
def m14_rows(spark, sf):
    """The rows that stay, by the truth side (their cells were not masked, so both sides agree)."""
    inc, truth, _ = _bench(spark, sf)
    _, kept = impute.drop_unfilled(inc, truth, "leg_id")
    return kept.select("leg_id", *_IMP)


def _parts(train, validation, test):
    named = [p.select("o_orderkey", F.lit(n).alias("part")) for p, n in ((train, "train"), (validation, "validation"), (test, "test"))]
    return named[0].unionByName(named[1]).unionByName(named[2])


@register("r2_three_way_assignment", f"""
SELECT o_orderkey, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.36 THEN 'validation' ELSE 'train' END AS part
FROM (SELECT o_orderkey, {uniform_sql('o_orderkey', 0)} AS u FROM orders)
""")
def r2_assignment(spark, sf):
    return _parts(*model.train_val_test_split(fx.read_table(spark, sf, "orders"), "o_orderkey", arithmetic=True))


@register("r3_imputed_assignment", f"""
WITH t AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY {uniform_sql('o_orderkey', 1)}, o_orderkey
           LIMIT (SELECT CAST(ceil(count(*) * 0.3) AS BIGINT) FROM orders))
SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM t) THEN 'test'
                        WHEN {uniform_sql('o_orderkey', 2)} < 0.2 THEN 'validation' ELSE 'train' END AS part
FROM orders
""")
def r3_assignment(spark, sf):
    o = fx.read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return _parts(*model.imputed_split(o, o.where("o_orderstatus = 'F'"), "o_orderkey", arithmetic=True))
