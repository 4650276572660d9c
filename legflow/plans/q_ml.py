"""Queries for encoders, imputation, splitting, modelling and evaluation.

SQL-checkable rows carry a DuckDB twin; iterative / MLlib rows return small
rounded tables and get the rows-only check.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from legflow.functions.nulls import uniform, uniform_sql
from legflow.operators import derive, encode, evaluate, impute, model, select
from legflow.plans.catalog import hm, register, targets_cte
from legflow.plans.q_core import r6
from legflow.sources import fixtures as fx


LINEITEM_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def li_row_id():
    """Row key of ``lineitem``: (order, line) is not unique in the supplied data, so
    the key hashes the whole row; rows that share it are identical."""
    return F.xxhash64(*[F.col(c) for c in LINEITEM_COLUMNS])


def _orders_split(spark, sf):
    o = fx.read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return o.withColumn("is_train", uniform("o_orderkey", 3) < 0.8)


# ------------------------------------------------------------------ E: encoders and scalers

@register("e1_leave_one_out_encoding", f"""
WITH o AS (SELECT o_orderkey, o_orderpriority, o_totalprice, {uniform_sql('o_orderkey', 3)} < 0.8 AS is_train FROM orders),
lv AS (SELECT o_orderpriority, sum(o_totalprice) AS s, count(o_totalprice) AS n FROM o WHERE is_train GROUP BY 1),
pr AS (SELECT avg(o_totalprice) AS prior FROM o WHERE is_train)
SELECT o.o_orderkey, o.is_train,
       round(coalesce(CASE WHEN o.is_train THEN CASE WHEN lv.n > 1 THEN (lv.s - o.o_totalprice) / (lv.n - 1) END
                           ELSE lv.s / lv.n END, pr.prior), 6) AS priority_enc
FROM o LEFT JOIN lv ON o.o_orderpriority = lv.o_orderpriority, pr
""")
def e1(spark, sf):
    o = _orders_split(spark, sf)
    train, test = o.where("is_train"), o.where("NOT is_train")
    m, tr = encode.LeaveOneOutEncoder(["o_orderpriority"], "o_totalprice", "_enc").fit_transform(train)
    te = m.transform(test)
    return tr.unionByName(te).select("o_orderkey", "is_train", r6(F.col("o_orderpriority_enc")).alias("priority_enc"))


@register("e2_target_mean_encoding", """
WITH lv AS (SELECT c_mktsegment, avg(c_acctbal) AS m FROM customer GROUP BY 1)
SELECT c.c_custkey, round(lv.m, 6) AS segment_enc FROM customer c JOIN lv ON c.c_mktsegment = lv.c_mktsegment
""")
def e2(spark, sf):
    c = fx.read_table(spark, sf, "customer")
    m = encode.TargetMeanEncoder(["c_mktsegment"], "c_acctbal", smoothing=0.0).fit(c)
    return m.transform(c).select("c_custkey", r6(F.col("c_mktsegment")).alias("segment_enc"))


@register("e3_ordinal_round_trip", """
WITH lv AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) AS code FROM (SELECT DISTINCT p_brand FROM part))
SELECT p.p_partkey, CAST(lv.code AS DOUBLE) AS code, p.p_brand AS decoded FROM part p JOIN lv ON p.p_brand = lv.p_brand
""")
def e3(spark, sf):
    p = fx.read_table(spark, sf, "part").select("p_partkey", "p_brand")
    m = encode.OrdinalEncoder(["p_brand"]).fit(p)
    coded = m.transform(p).withColumnRenamed("p_brand", "code")
    noisy = coded.withColumn("p_brand", F.col("code") + 0.3)
    return m.inverse_transform(noisy).select("p_partkey", "code", F.col("p_brand").alias("decoded"))


_FLEETS = ["NB", "PGA", "WB", "WI"]


@register("e4_one_hot_with_nulls", "SELECT leg_id, " + ", ".join(
    f"CASE WHEN fleet IS NULL THEN NULL WHEN fleet = '{v}' THEN 1.0 ELSE 0.0 END AS fleet_{v}" for v in _FLEETS)
    + " FROM legs")
def e4(spark, sf):
    legs = fx.legs(spark, sf).select("leg_id", "fleet")
    return encode.OneHotEncoder(["fleet"]).fit(legs).transform(legs)


@register("e5_e6_argmax_decode", """
SELECT leg_id, fleet FROM legs
""")
def e5_e6(spark, sf):
    legs = fx.legs(spark, sf).select("leg_id", "fleet")
    m = encode.OneHotEncoder(["fleet"]).fit(legs)
    soft = m.transform(legs).withColumns({f"fleet_{v}": F.col(f"fleet_{v}") * 0.7 + 0.1 for v in _FLEETS})
    return m.decode(m.most_likely(soft))


_SC = ["l_quantity", "l_extendedprice", "l_discount"]


@register("e7_standard_scaler", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in _SC) + " FROM lineitem")
def e7(spark, sf):
    li = fx.read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_SC)
    out = encode.StandardScaler(_SC).fit(li).transform(li)
    return out.select("l_orderkey", "l_linenumber", *[r6(F.col(c)).alias(c) for c in _SC])


@register("e8_min_max_scaler", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}" for c in _SC)
    + " FROM lineitem")
def e8(spark, sf):
    li = fx.read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_SC)
    out = encode.MinMaxScaler(_SC).fit(li).transform(li)
    return out.select("l_orderkey", "l_linenumber", *[r6(F.col(c)).alias(c) for c in _SC])


@register("e9_robust_scaler", "WITH q AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.5) AS {c}_m, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_i" for c in _SC)
    + " FROM lineitem) SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c} - q.{c}_m) / CASE WHEN q.{c}_i = 0 THEN 1 ELSE q.{c}_i END, 6) AS {c}" for c in _SC)
    + " FROM lineitem, q")
def e9(spark, sf):
    li = fx.read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_SC)
    out = encode.RobustScaler(_SC).fit(li).transform(li)
    return out.select("l_orderkey", "l_linenumber", *[r6(F.col(c)).alias(c) for c in _SC])


@register("e10_e11_pca_explained_variance")
def e10(spark, sf):
    li = fx.read_table(spark, sf, "lineitem").select(*_SC, "l_tax")
    m = encode.CenteredPCA(_SC + ["l_tax"], 3, whiten=True).fit(
        encode.StandardScaler(_SC + ["l_tax"]).fit(li).transform(li))
    ev = m.explained_variance(spark)
    return ev.select("component", F.round("ratio", 4).alias("ratio"), F.round("cumulative", 4).alias("cumulative"))


_CHI = ["l_quantity", "l_discount", "l_tax"]


@register("e12_chi2_scores", """
WITH l AS (SELECT l_returnflag AS c, 'l_quantity' AS feature, l_quantity AS v FROM lineitem
           UNION ALL SELECT l_returnflag, 'l_discount', l_discount FROM lineitem
           UNION ALL SELECT l_returnflag, 'l_tax', l_tax FROM lineitem),
obs AS (SELECT feature, c, sum(v) AS obs FROM l GROUP BY 1, 2),
cls AS (SELECT l_returnflag AS c, count(*) * 1.0 / (SELECT count(*) FROM lineitem) AS p FROM lineitem GROUP BY 1),
tot AS (SELECT feature, sum(v) AS t FROM l GROUP BY 1)
SELECT obs.feature, round(sum((obs - p * t) * (obs - p * t) / (p * t)), 6) AS chi2
FROM obs JOIN cls USING (c) JOIN tot USING (feature) GROUP BY 1
""")
def e12(spark, sf):
    li = fx.read_table(spark, sf, "lineitem")
    return select.chi2_scores(li, _CHI, "l_returnflag").withColumn("chi2", r6(F.col("chi2")))


def _lineitem_xy(spark, sf):
    li = fx.read_table(spark, sf, "lineitem")
    return li.select(li_row_id().alias("row_id"),
                     "l_quantity", "l_discount", "l_tax",
                     (F.col("l_returnflag") == "R").cast("double").alias("flag_r"),
                     (F.col("l_linestatus") == "F").cast("double").alias("status_f"),
                     F.col("l_extendedprice").alias("label"))


@register("e16_rbf_features")
def e16(spark, sf):
    x = _lineitem_xy(spark, sf)
    out, _ = select.rbf_features(x, ["l_quantity", "l_discount"], 4, gamma=0.001, seed=1)
    return out.agg(*[F.round(F.avg(f"rbf{j}"), 4).alias(f"mean_rbf{j}") for j in range(1, 5)])


@register("t20_box_cox")
def t20(spark, sf):
    ev = fx.read_table(spark, sf, "events").select("value")
    m = encode.BoxCox(["value"]).fit(ev)
    out = m.transform(ev)
    return out.agg(F.round(F.skewness("value"), 3).alias("skew_after")).withColumn(
        "lambda", F.lit(m.lambdas["value"]))


# ------------------------------------------------------------------ M: missing data

_IMP = ["delay_minutes", "taxi_out", "taxi_in"]


def _imp_frame(spark, sf):
    legs = derive.add_targets(fx.legs(spark, sf))
    return legs.select("leg_id", F.col("delay_minutes"), F.col("taxi_out").cast("double").alias("taxi_out"),
                       F.col("taxi_in").cast("double").alias("taxi_in"))


_IMP_SQL = "tg0 AS (SELECT leg_id, delay_minutes, CAST(taxi_out AS DOUBLE) AS taxi_out, CAST(taxi_in AS DOUBLE) AS taxi_in FROM tg)"


def _mask_sql(c, i, seed, rate=0.5):
    mults = impute.MASK_MULTIPLIERS
    return f"CASE WHEN {uniform_sql('leg_id', seed + 101 * i, mults[i % len(mults)])} >= {rate} THEN {c} END"


@register("m1_inject_nulls", "WITH " + targets_cte("legs", "tg") + "," + _IMP_SQL + " SELECT " + ", ".join(
    f"count(*) FILTER (WHERE ({_mask_sql(c, i + 1, 0, 0.3)}) IS NULL) AS {c}_nulls" for i, c in enumerate(_IMP))
    + " FROM tg0")
def m1(spark, sf):
    x = impute.inject_nulls(_imp_frame(spark, sf), _IMP, 0.3, "leg_id", seed=0, arithmetic=True)
    return x.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in _IMP])


_TRUTH_SQL = ("truth AS (SELECT * FROM tg0 WHERE delay_minutes IS NOT NULL AND taxi_out IS NOT NULL AND taxi_in IS NOT NULL"
              f" AND {uniform_sql('leg_id', 0, impute.MASK_MULTIPLIERS[0])} < 0.5),"
              " inc AS (SELECT leg_id, " + ", ".join(
                  f"{_mask_sql(c, i + 1, 7)} AS {c}" for i, c in enumerate(_IMP)) + " FROM truth)")


def _bench(spark, sf):
    return impute.imputation_benchmark(_imp_frame(spark, sf), "leg_id", arithmetic=True)


@register("m2_imputation_benchmark", "WITH " + targets_cte("legs", "tg") + "," + _IMP_SQL + "," + _TRUTH_SQL
          + " SELECT (SELECT count(*) FROM truth) AS n_truth, " + ", ".join(
              f"(SELECT count(*) FROM inc WHERE {c} IS NULL) AS {c}_masked" for c in _IMP))
def m2(spark, sf):
    inc, truth, _ = _bench(spark, sf)
    n = truth.count()
    return inc.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_masked") for c in _IMP]).withColumn(
        "n_truth", F.lit(n).cast("long"))


_FILL_SQL = (", means AS (SELECT " + ", ".join(f"avg({c}) AS {c}" for c in _IMP) + " FROM inc),"
             " pred AS (SELECT leg_id, " + ", ".join(f"coalesce(inc.{c}, means.{c}) AS {c}" for c in _IMP)
             + " FROM inc, means),"
             " cells AS (" + " UNION ALL ".join(
                 f"SELECT '{c}' AS column_name, t.{c} AS t, p.{c} AS p, i.{c} IS NULL AS masked FROM truth t "
                 f"JOIN pred p USING (leg_id) JOIN inc i USING (leg_id)" for c in _IMP) + ")")


@register("m3_m4_m7_masked_scores_mean_fill", "WITH " + targets_cte("legs", "tg") + "," + _IMP_SQL + "," + _TRUTH_SQL
          + _FILL_SQL + """
SELECT round(avg((t - p) * (t - p)), 6) AS mse, round(avg(abs(t - p)), 6) AS mae,
       round(avg(abs(t - p) / nullif(abs(t), 0)) * 100, 6) AS mape, count(*) AS n_cells
FROM cells WHERE masked""")
def m4(spark, sf):
    inc, truth, _ = _bench(spark, sf)
    pred = impute.MeanFill(_IMP).fit(inc).transform(inc)
    s = impute.masked_scores(truth, pred, inc, _IMP, "leg_id")
    return s.select(r6(F.col("mse")).alias("mse"), r6(F.col("mae")).alias("mae"), r6(F.col("mape")).alias("mape"),
                    "n_cells")


@register("m6_per_column_scores", "WITH " + targets_cte("legs", "tg") + "," + _IMP_SQL + "," + _TRUTH_SQL
          + _FILL_SQL + """
SELECT column_name, round(avg((t - p) * (t - p)), 6) AS mse, round(avg(abs(t - p)), 6) AS mae, count(*) AS n_cells
FROM cells WHERE masked GROUP BY 1""")
def m6(spark, sf):
    inc, truth, _ = _bench(spark, sf)
    pred = impute.MeanFill(_IMP).fit(inc).transform(inc)
    s = impute.masked_scores(truth, pred, inc, _IMP, "leg_id", per_column=True)
    return s.select(F.col("column").alias("column_name"), r6(F.col("mse")).alias("mse"),
                    r6(F.col("mae")).alias("mae"), "n_cells")


_CAT = ["fleet", "aircraft_type_code"]


@register("m5_m8_masked_accuracy_mode_fill", """
WITH truth AS (SELECT leg_id, fleet, aircraft_type_code FROM legs WHERE fleet IS NOT NULL),
inc AS (SELECT leg_id, """ + ", ".join(f"{_mask_sql(c, i + 1, 11, 0.4)} AS {c}" for i, c in enumerate(_CAT)) + """ FROM truth),
modes AS (SELECT """ + ", ".join(
    f"(SELECT {c} FROM inc WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1) AS {c}" for c in _CAT)
    + """),
cells AS (""" + " UNION ALL ".join(
    f"SELECT t.{c} AS t, coalesce(i.{c}, modes.{c}) AS p, i.{c} IS NULL AS masked FROM truth t JOIN inc i USING (leg_id), modes"
    for c in _CAT) + """)
SELECT round(avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n_cells FROM cells WHERE masked
""")
def m5(spark, sf):
    truth = fx.legs(spark, sf).select("leg_id", "fleet", "aircraft_type_code").where("fleet IS NOT NULL")
    inc = impute.inject_nulls(truth, _CAT, 0.4, "leg_id", seed=11, arithmetic=True)
    pred = impute.ModeFill(_CAT).fit(inc).transform(inc)
    s = impute.masked_accuracy(truth, pred, inc, _CAT, "leg_id")
    return s.select(r6(F.col("accuracy")).alias("accuracy"), "n_cells")


@register("m9_mean_baseline_mae", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(avg(abs({c} - (SELECT avg({c}) FROM lineitem))), 6) AS mae FROM lineitem"
    for c in _SC))
def m9(spark, sf):
    li = fx.read_table(spark, sf, "lineitem")
    return impute.mean_baseline_mae(li, _SC).select(F.col("column").alias("column_name"), r6(F.col("mae")).alias("mae"))


@register("m14_drop_unfilled", "WITH " + targets_cte("legs", "tg") + "," + _IMP_SQL + "," + _TRUTH_SQL + """
SELECT count(*) AS n_rows FROM inc WHERE delay_minutes IS NOT NULL AND taxi_out IS NOT NULL AND taxi_in IS NOT NULL""")
def m14(spark, sf):
    inc, truth, _ = _bench(spark, sf)
    pred, t2 = impute.drop_unfilled(inc, truth, "leg_id")
    return t2.agg(F.count(F.lit(1)).alias("n_rows"))


@register("m10_iterative_imputer")
def m10(spark, sf):
    li = fx.read_table(spark, sf, "lineitem").select(
        li_row_id().alias("rid"), "l_quantity", "l_extendedprice",
        "l_discount")
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    inc = impute.inject_nulls(li, cols, 0.2, "rid", seed=5)
    pred = impute.IterativeImputer(cols, "rid").fit_transform(inc)
    s = impute.masked_scores(li, pred, inc, cols, "rid", per_column=True)
    base = impute.masked_scores(li, impute.MeanFill(cols).fit(inc).transform(inc), inc, cols, "rid", per_column=True)
    return s.select("column", F.round("mae", 2).alias("mae")).join(
        base.select("column", F.round("mae", 2).alias("mean_fill_mae")), "column")


@register("m11_m12_reconstruct_imputer")
def m11(spark, sf):
    li = fx.read_table(spark, sf, "lineitem").select(
        li_row_id().alias("rid"), "l_quantity", "l_extendedprice",
        "l_discount", "l_tax")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    inc = impute.inject_nulls(li, cols, 0.2, "rid", seed=9)
    imp = impute.ReconstructImputer(cols, "rid", k=2, blend=0.5).fit(inc)
    s = impute.masked_scores(li, imp.transform(inc), inc, cols, "rid", per_column=True)
    return s.select("column", F.round("mae", 2).alias("mae"), "n_cells")


def _embeddings(spark, sf):
    e = fx.read_table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"),
                    "label", (uniform("vec_id", 17) < 0.8).alias("is_train"))


_KNN_SQL = f"""
WITH e AS (SELECT vec_id, label, embedding, {uniform_sql('vec_id', 17)} < 0.8 AS is_train FROM embeddings),
u AS (SELECT e.vec_id, e.label, e.is_train, i, CAST(e.embedding[i] AS DOUBLE) AS x
      FROM e, range(1, 65) r(i)),
d AS (SELECT q.vec_id AS query_id, t.vec_id AS nid, any_value(t.label) AS nlabel, sum((q.x - t.x) * (q.x - t.x)) AS d2
      FROM u q JOIN u t ON q.i = t.i AND NOT q.is_train AND t.is_train GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, nid) AS rk FROM d)
"""


@register("m15_knn_vote", _KNN_SQL + """,
v AS (SELECT query_id, nlabel, count(*) AS n FROM r WHERE rk <= 4 GROUP BY 1, 2),
b AS (SELECT query_id, nlabel AS prediction, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, nlabel) AS o FROM v)
SELECT query_id, prediction FROM b WHERE o = 1
""")
def m15(spark, sf):
    e = _embeddings(spark, sf)
    nb = impute.nearest_neighbours(e.where("is_train"), e.where("NOT is_train"), 9)
    return impute.knn_vote(nb, 4)


@register("m16_knn_error_rates", _KNN_SQL + """,
ks AS (SELECT range AS k FROM range(1, 10)),
v AS (SELECT k, query_id, nlabel, count(*) AS n FROM r, ks WHERE rk <= k GROUP BY 1, 2, 3),
b AS (SELECT k, query_id, nlabel AS prediction, row_number() OVER (PARTITION BY k, query_id ORDER BY n DESC, nlabel) AS o FROM v)
SELECT CAST(b.k AS INTEGER) AS k, round(avg(CASE WHEN b.prediction <> e.label THEN 1.0 ELSE 0.0 END), 6) AS error_rate
FROM b JOIN embeddings e ON e.vec_id = b.query_id WHERE o = 1 GROUP BY 1
""")
def m16(spark, sf):
    e = _embeddings(spark, sf)
    nb = impute.nearest_neighbours(e.where("is_train"), e.where("NOT is_train"), 9)
    rates = impute.knn_error_rates(nb, e.where("NOT is_train"))
    return rates.select("k", r6(F.col("error_rate")).alias("error_rate"))


# ------------------------------------------------------------------ R: splits, models, evaluation

@register("r1_r2_splits", f"""
SELECT CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.36 THEN 'validation' ELSE 'train' END AS part, count(*) AS n_rows
FROM (SELECT {uniform_sql('o_orderkey', 0)} AS u FROM orders) GROUP BY 1
""")
def r1_r2(spark, sf):
    o = fx.read_table(spark, sf, "orders")
    tr, va, te = model.train_val_test_split(o, "o_orderkey", arithmetic=True)
    parts = [p.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("part", F.lit(n))
             for p, n in ((tr, "train"), (va, "validation"), (te, "test"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("r3_imputed_split", f"""
WITH o AS (SELECT o_orderkey, o_orderstatus FROM orders),
k AS (SELECT o_orderkey FROM o WHERE o_orderstatus = 'F'),
t AS (SELECT o_orderkey FROM k ORDER BY {uniform_sql('o_orderkey', 1)}, o_orderkey
      LIMIT (SELECT CAST(ceil(count(*) * 0.3) AS BIGINT) FROM o))
SELECT CASE WHEN o_orderkey IN (SELECT o_orderkey FROM t) THEN 'test'
            WHEN {uniform_sql('o_orderkey', 2)} < 0.2 THEN 'validation' ELSE 'train' END AS part, count(*) AS n_rows
FROM o GROUP BY 1
""")
def r3(spark, sf):
    o = fx.read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    tr, va, te = model.imputed_split(o, o.where("o_orderstatus = 'F'"), "o_orderkey", arithmetic=True)
    parts = [p.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("part", F.lit(n))
             for p, n in ((tr, "train"), (va, "validation"), (te, "test"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("r4_stratified_folds", f"""
SELECT fold, label, count(*) AS n_rows FROM (
  SELECT o_orderpriority AS label,
         CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY {uniform_sql('o_orderkey', 101)}, o_orderkey) - 1) % 5 AS INTEGER) AS fold
  FROM orders) GROUP BY 1, 2
""")
def r4(spark, sf):
    o = fx.read_table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("label"))
    f = model.stratified_folds(o, "label", "o_orderkey", arithmetic=True)
    return f.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n_rows"))


def _pred_legs_sql():
    return "WITH " + targets_cte("legs", "tg") + f""",
p AS (SELECT leg_id, CAST(air_time AS DOUBLE) AS label,
             CAST({hm('scheduled_departure_date', 'scheduled_arrival_date')} AS DOUBLE) * 0.9 AS prediction
      FROM tg WHERE air_time IS NOT NULL)
"""


def _pred_legs(spark, sf):
    t = derive.add_targets(fx.legs(spark, sf)).where(F.col("air_time").isNotNull())
    return t.select("leg_id", F.col("air_time").cast("double").alias("label"),
                    (derive.minutes("scheduled_departure_date", "scheduled_arrival_date").cast("double") * 0.9)
                    .alias("prediction"))


@register("r20_test_metrics", _pred_legs_sql() + """
SELECT round(avg(abs(label - prediction)), 6) AS mae, round(sqrt(avg((label - prediction) * (label - prediction))), 6) AS rmse,
       round(avg(abs(label - prediction) / abs(label)) * 100, 6) AS mape,
       round((1 - sum((label - prediction) * (label - prediction)) / (var_pop(label) * count(*))) * 100, 6) AS r2
FROM p WHERE label <> 0
""")
def r20(spark, sf):
    m = evaluate.test_metrics(_pred_legs(spark, sf))
    return m.select(*[r6(F.col(c)).alias(c) for c in m.columns])


@register("r21_abs_error_distribution", _pred_legs_sql() + """
SELECT round_even(avg(abs(label - prediction)), 2) AS mean, round_even(stddev_pop(abs(label - prediction)), 2) AS std,
       round_even(min(abs(label - prediction)), 2) AS min, round_even(quantile_cont(abs(label - prediction), 0.5), 2) AS median,
       round_even(max(abs(label - prediction)), 2) AS max FROM p
""")
def r21(spark, sf):
    return evaluate.abs_error_distribution(_pred_legs(spark, sf))


@register("r22_percentage_error_bins", _pred_legs_sql() + """,
e AS (SELECT abs(prediction - label) / abs(label) * 100 AS pe, abs(label - prediction) AS ae FROM p),
b AS (SELECT CASE WHEN pe <= 0 OR pe IS NULL THEN NULL WHEN pe <= 2 THEN 2 WHEN pe <= 4 THEN 4 WHEN pe <= 6 THEN 6 WHEN pe <= 8 THEN 8
                  WHEN pe <= 10 THEN 10 WHEN pe <= 12 THEN 12 WHEN pe <= 14 THEN 14 WHEN pe <= 16 THEN 16
                  WHEN pe <= 18 THEN 18 WHEN pe <= 20 THEN 20 WHEN pe <= 50 THEN 50 WHEN pe <= 100 THEN 100
                  ELSE 1000000000 END AS hi, ae FROM e),
g AS (SELECT hi, count(*) AS n, avg(ae) AS mae FROM b WHERE hi IS NOT NULL GROUP BY 1)
SELECT CASE WHEN hi = 1000000000 THEN '> 100'
            ELSE CAST(coalesce(lag(hi) OVER (ORDER BY hi), 0) AS VARCHAR) || '-' || CAST(hi AS VARCHAR) END AS bin,
       hi AS upper, round(n * 100.0 / (SELECT count(*) FROM p), 6) AS pct, round(mae, 6) AS mae, n FROM g
""")
def r22(spark, sf):
    b = evaluate.percentage_error_bins(_pred_legs(spark, sf))
    return b.select("bin", "upper", r6(F.col("pct")).alias("pct"), r6(F.col("mae")).alias("mae"), "n")


@register("r23_residuals", _pred_legs_sql() + "SELECT leg_id, prediction, label - prediction AS residual FROM p")
def r23(spark, sf):
    return evaluate.residuals(_pred_legs(spark, sf), keep=["leg_id"])


@register("r26_share_below_bounds", _pred_legs_sql() + """
SELECT round(avg(CASE WHEN abs(label - prediction) < 5.0 THEN 1.0 ELSE 0.0 END), 6) AS below_5_0,
       round(avg(CASE WHEN abs(label - prediction) < 2.6 THEN 1.0 ELSE 0.0 END), 6) AS below_2_6 FROM p
""")
def r26(spark, sf):
    s = evaluate.share_below(_pred_legs(spark, sf))
    return s.select(*[r6(F.col(c)).alias(c) for c in s.columns])


@register("r27_actual_vs_predicted_bounds", _pred_legs_sql() + "SELECT min(label) AS lo, max(label) AS hi FROM p")
def r27(spark, sf):
    _, bounds = evaluate.actual_vs_predicted(_pred_legs(spark, sf))
    return bounds


_REQ_EXPR = {
    "flight_number": "CASE WHEN leg_id % 17 = 0 THEN 'x12' ELSE flight_number END",
    "tail_number": "tail_number", "aircraft_model": "aircraft_model", "fleet": "fleet",
    "origin_airport": "origin_airport", "destination_airport": "destination_airport",
    "origin_air_temperature": "CASE WHEN leg_id % 23 = 0 THEN 'warm' ELSE CAST(leg_id % 40 AS STRING) END",
    "origin_wind_direction": "'N'", "origin_wind_speed": "CAST(leg_id % 30 AS STRING)",
    "origin_visibility": "'6.21'", "origin_cloud_coverage": "'SCT'", "origin_cloud_height": "'900.0'",
    "destination_air_temperature": "'13.0'", "destination_wind_direction": "'NW'",
    "destination_wind_speed": "'7.0'", "destination_visibility": "'6.21'", "destination_cloud_coverage": "'SCT'",
    "destination_cloud_height": "'1800.0'",
    "scheduled_block_time": "CASE WHEN leg_id % 29 = 0 THEN '335.5' ELSE CAST(leg_id % 500 AS STRING) END",
    "is_night": "'1'", "scheduled_rotation_time": "'155.0'", "prev_delay_code": "'1'",
    "scheduled_departure_date_year": "'2016'", "scheduled_departure_date_month": "'4'",
    "scheduled_departure_date_day": "'27'", "scheduled_departure_date_hour": "'2'",
    "scheduled_departure_date_minute": "'20'", "scheduled_arrival_date_year": "'2016'",
    "scheduled_arrival_date_month": "'4'", "scheduled_arrival_date_day": "'27'",
    "scheduled_arrival_date_hour": "'7'", "scheduled_arrival_date_minute": "'55'",
}


@register("r19_request_validation", """
WITH r AS (SELECT leg_id AS request_id,
  CASE WHEN leg_id % 23 = 0 THEN 'origin_air_temperature: not a number'
       WHEN leg_id % 17 = 0 THEN 'flight_number: not an integer'
       WHEN leg_id % 29 = 0 THEN 'scheduled_block_time: not an integer' END AS reason FROM legs)
SELECT coalesce(reason, 'valid') AS outcome, count(*) AS n FROM r GROUP BY 1
""")
def r19(spark, sf):
    req = fx.legs(spark, sf).selectExpr("leg_id AS request_id", *[f"{e} AS {k}" for k, e in _REQ_EXPR.items()])
    valid, rejected = evaluate.validate_requests(req)
    return (valid.agg(F.count(F.lit(1)).alias("n")).withColumn("outcome", F.lit("valid"))
            .unionByName(rejected.groupBy(F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))))


# ------------------------------------------------------------------ R: MLlib models (rows-only)

_FEATS = ["l_quantity", "l_discount", "l_tax", "flag_r", "status_f"]


#: Boosting rounds, and trees of forests, of the registered queries: all that the source's models have.
TREES = 500


def _model_metrics(spark, sf, name, **kw):
    x = _lineitem_xy(spark, sf)
    train, test = model.train_test_split(x, "row_id")
    chain = model.fit_chain(train, name, _FEATS, rounds=TREES, key="row_id", **kw)
    m = evaluate.test_metrics(chain.transform(test))
    return m.select(*[F.round(F.col(c), 2).alias(c) for c in m.columns]).withColumn("model", F.lit(name))


for _name in ("ridge", "lasso", "elastic", "gb", "xgb", "rf"):
    register(f"r5_r10_{_name}_test_metrics")(lambda spark, sf, _n=_name: _model_metrics(spark, sf, _n))


@register("r11_chain_with_pca_and_encoder")
def r11(spark, sf):
    li = fx.read_table(spark, sf, "lineitem")
    x = li.select(li_row_id().alias("row_id"), "l_quantity", "l_discount",
                  "l_tax", "l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("label"))
    train, test = model.train_test_split(x, "row_id")
    chain = model.fit_chain(train, "ridge", ["l_quantity", "l_discount", "l_tax"],
                            categorical=["l_returnflag", "l_linestatus"], scaler="robust", pca_k=4)
    m = evaluate.test_metrics(chain.transform(test))
    return m.select(*[F.round(F.col(c), 2).alias(c) for c in m.columns])


@register("r12_stacking")
def r12(spark, sf):
    return _model_metrics(spark, sf, "stacking")


@register("r18_r24_batch_scoring_importance")
def r18(spark, sf):
    x = _lineitem_xy(spark, sf)
    train, test = model.train_test_split(x, "row_id")
    chain = model.fit_chain(train, "rf", _FEATS, scaler=None, rounds=TREES, key="row_id")
    scored = chain.transform(test)
    imp = evaluate.feature_importances(spark, chain.model.stages[-1], chain.assembler_cols)
    return imp.withColumn("n_scored", F.lit(scored.count()))


@register("r25_permutation_importance")
def r25(spark, sf):
    x = _lineitem_xy(spark, sf)
    train, test = model.train_test_split(x, "row_id")
    chain = model.fit_chain(train, "ridge", _FEATS)
    return evaluate.permutation_importance(chain.transform, test, _FEATS, "row_id").select(
        "feature", F.round("importance", 2).alias("importance"))


@register("m13_whole_table_imputation")
def m13(spark, sf):
    """Encode, scale, impute, unscale, round, decode and rejoin; scored on the masked cells."""
    from legflow.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    legs = derive.add_targets(fx.legs(spark, sf)).select(
        "leg_id", "origin_airport", "delay_minutes", F.col("taxi_out").cast("double").alias("taxi_out"),
        F.col("taxi_in").cast("double").alias("taxi_in"), "fleet", "aircraft_type_code")
    truth = legs.dropna()
    inc = impute.inject_nulls(truth, _IMP + _CAT, 0.2, "leg_id", seed=21)
    out = impute.impute_table(inc, "leg_id", _IMP, _CAT, method="iterative")
    num = impute.masked_scores(truth, out, inc, _IMP, "leg_id", per_column=True).select(
        "column", F.round("mae", 2).alias("score"))
    cat = impute.masked_accuracy(truth, out, inc, _CAT, "leg_id", per_column=True).select(
        "column", F.round("accuracy", 2).alias("score"))
    return num.unionByName(cat)


@register("m3_missing_mask", "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE {c} IS NULL) AS {c}__missing" for c in ["fleet", "tail_number", "take_off_date"])
    + " FROM legs")
def m3(spark, sf):
    m = impute.missing_mask(fx.legs(spark, sf), ["fleet", "tail_number", "take_off_date"], "leg_id")
    return m.agg(*[F.count_if(F.col(f"{c}__missing")).alias(f"{c}__missing")
                   for c in ["fleet", "tail_number", "take_off_date"]])


@register("s7_model_save_and_reload")
def s7(spark, sf):
    """A fitted chain saved to the shared folder, reloaded, and scored again."""
    from legflow.sources import io

    li = fx.read_table(spark, sf, "lineitem")
    x = li.select(li_row_id().alias("row_id"), "l_quantity",
                  "l_discount", "l_tax", "l_returnflag", F.col("l_extendedprice").alias("label"))
    train, test = model.train_test_split(x, "row_id")
    chain = model.fit_chain(train, "ridge", ["l_quantity", "l_discount", "l_tax"], categorical=["l_returnflag"],
                            scaler="standard", pca_k=2)
    path = io.scratch_table_path(spark, "chain")
    chain.save(path)
    again = io.load_chain(path)
    cols = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]
    both = again.transform(chain.transform(test.withColumns({f"raw_{c}": F.col(c) for c in cols})).select(
        "row_id", *[F.col(f"raw_{c}").alias(c) for c in cols], "label", F.col("prediction").alias("first")))
    # rows that share an id are identical: every one of them is held against every other
    per = both.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("first") - F.col("prediction"))).alias("gap"))
    return per.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("n_scored"), F.round(F.max("gap"), 9).alias("max_abs_diff"))
