"""Checked forms of rows whose full form has no SQL twin: closed forms and relational parts."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from legflow.functions.nulls import uniform_sql
from legflow.operators import derive, encode, evaluate, model, report, select
from legflow.plans.catalog import register
from legflow.plans.q_core import r6
from legflow.plans.q_ml import li_row_id
from legflow.sources import fixtures as fx


def _orders(spark, sf, *cols):
    return fx.read_table(spark, sf, "orders").select("o_orderkey", *cols)


# ------------------------------------------------------------------ encoders with rare levels

_SPLIT = f"o AS (SELECT o_orderkey, o_custkey, o_totalprice AS y, {uniform_sql('o_orderkey', 3)} < 0.5 AS is_train FROM orders)"


def _split(spark, sf):
    from legflow.functions.nulls import uniform

    return _orders(spark, sf, "o_custkey", "o_totalprice").withColumn("is_train", uniform("o_orderkey", 3) < 0.5)


@register("e1_leave_one_out_rare_levels", f"""
WITH {_SPLIT},
lv AS (SELECT o_custkey, sum(y) AS s, count(y) AS n FROM o WHERE is_train GROUP BY 1), pr AS (SELECT avg(y) AS prior FROM o WHERE is_train)
SELECT o.o_orderkey, round(coalesce(CASE WHEN lv.n > 1 THEN CASE WHEN o.is_train THEN (lv.s - o.y) / (lv.n - 1) ELSE lv.s / lv.n END END,
                                    pr.prior), 6) AS code
FROM o LEFT JOIN lv ON o.o_custkey = lv.o_custkey, pr
""")
def e1_rare(spark, sf):
    """Levels seen once or never in training get the global mean, in training and in scoring."""
    o = _split(spark, sf)
    m, train = encode.LeaveOneOutEncoder(["o_custkey"], "o_totalprice", "_enc").fit_transform(o.where("is_train"))
    return train.unionByName(m.transform(o.where("NOT is_train"))).select("o_orderkey", F.round("o_custkey_enc", 6).alias("code"))


@register("e2_target_mean_smoothed", f"""
WITH {_SPLIT},
lv AS (SELECT o_custkey, avg(y) AS m, count(y) AS n FROM o WHERE is_train GROUP BY 1), pr AS (SELECT avg(y) AS prior FROM o WHERE is_train)
SELECT o.o_orderkey, round(coalesce(CASE WHEN lv.n > 1 THEN pr.prior * (1 - 1 / (1 + exp(-(lv.n - 1) / 1.5))) + lv.m / (1 + exp(-(lv.n - 1) / 1.5))
                                         END, pr.prior), 6) AS code
FROM o LEFT JOIN lv ON o.o_custkey = lv.o_custkey, pr
""")
def e2_smoothed(spark, sf):
    o = _split(spark, sf)
    m = encode.TargetMeanEncoder(["o_custkey"], "o_totalprice", smoothing=1.5).fit(o.where("is_train"))
    return m.transform(o).select("o_orderkey", F.round("o_custkey", 6).alias("code"))


@register("t20_box_cox_transform", """
SELECT event_id, round((power(value + 1, 0.25) - 1) / 0.25, 6) AS v FROM events WHERE value >= 0
""")
def t20_transform(spark, sf):
    e = fx.read_table(spark, sf, "events").where("value >= 0").select("event_id", F.col("value").alias("v"))
    return encode.BoxCoxModel({"v": 0.25}).transform(e).select("event_id", r6(F.col("v")).alias("v"))


@register("e10_e11_two_column_pca", """
WITH z AS (SELECT (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS a,
                  (l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER () AS b FROM lineitem),
r AS (SELECT corr(a, b) AS r FROM z)
SELECT round((1 + max(abs(r))) / 2, 6) AS ratio_1, round((1 - max(abs(r))) / 2, 6) AS ratio_2,
       round(avg(abs(a + sign(r) * b)) / sqrt(2), 6) AS mean_abs_1, round(avg(abs(a - sign(r) * b)) / sqrt(2), 6) AS mean_abs_2 FROM z, r
""")
def e10_two(spark, sf):
    """Two standardised columns: the components are their sum and difference, whatever their sign."""
    li = fx.read_table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    cols = ["l_quantity", "l_extendedprice"]
    z = encode.StandardScaler(cols).fit(li).transform(li)
    m = encode.CenteredPCA(cols, 2).fit(z)
    return m.transform(z).agg(r6(F.lit(float(m.ratios[0]))).alias("ratio_1"), r6(F.lit(float(m.ratios[1]))).alias("ratio_2"),
                              r6(F.avg(F.abs("pc1"))).alias("mean_abs_1"), r6(F.avg(F.abs("pc2"))).alias("mean_abs_2"))


# ------------------------------------------------------------------ splits and folds, row by row

@register("r1_train_test_assignment", f"""
SELECT o_orderkey, CASE WHEN {uniform_sql('o_orderkey', 4)} < 0.2 THEN 'test' ELSE 'train' END AS part FROM orders
""")
def r1(spark, sf):
    train, test = model.train_test_split(_orders(spark, sf), "o_orderkey", seed=4, arithmetic=True)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


_LABEL = "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END"


@register("r4_fold_assignment", f"""
SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY {_LABEL} ORDER BY {uniform_sql('o_orderkey', 101)}, o_orderkey) - 1) % 5 AS INTEGER) AS fold
FROM orders
""")
def r4_rows(spark, sf):
    """Rows without a label are a stratum of their own."""
    o = _orders(spark, sf, F.expr(_LABEL).alias("label"))
    return model.stratified_folds(o, "label", "o_orderkey", arithmetic=True).select("o_orderkey", "fold")


# ------------------------------------------------------------------ graph of large diameter, running totals

@register("a18_components_of_long_paths", """
SELECT p_partkey AS node, min(p_partkey) OVER (PARTITION BY p_partkey // 700) AS component FROM part
""")
def a18_paths(spark, sf):
    """Paths of up to 700 parts, linked key to next key."""
    p = fx.read_table(spark, sf, "part").select("p_partkey")
    follows = F.when((F.col("p_partkey") + 1) % 700 == 0, F.col("p_partkey")).otherwise(F.col("p_partkey") + 1)
    known = p.withColumnRenamed("p_partkey", "b")
    e = p.select(F.col("p_partkey").alias("a"), follows.alias("next")).join(known, F.col("next") == F.col("b"), "left")
    e = e.select("a", F.coalesce("b", "a").alias("b"))
    return report.connected_components(e, "a", "b")


@register("w3_running_total", """
SELECT day, n, CAST(sum(n) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total
FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)
""")
def w3(spark, sf):
    days = _orders(spark, sf, "o_orderdate").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return derive.running_total(days, "n", "day", "total")


_LOO = ", ".join(f"""(sum(o_totalprice) OVER (PARTITION BY {c}) - o_totalprice) / (count(*) OVER (PARTITION BY {c}) - 1) AS {c}"""
                 for c in ("o_orderpriority", "o_orderstatus"))
_COLS = ["o_totalprice", "o_custkey", "o_orderpriority", "o_orderstatus"]
_SIDES = {"numeric": (["o_custkey"], ["o_custkey"]), "categorical": (["o_orderpriority", "o_orderstatus", "o_totalprice"],) * 2,
          "mixed": (["o_custkey", "o_totalprice"], ["o_orderpriority", "o_orderstatus", "o_totalprice"])}


@register("a20_encoded_and_mixed_matrices", f"""
WITH e AS (SELECT o_orderkey, o_totalprice, o_custkey, {_LOO} FROM orders),
r AS (SELECT {", ".join(f"(rank() OVER (ORDER BY {c}) + rank() OVER (ORDER BY {c}) + count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _COLS)} FROM e)
""" + " UNION ALL ".join(f"SELECT '{m}' AS matrix, '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 5) AS corr FROM r"
                         for m, (xs, ys) in _SIDES.items() for x in xs for y in ys))
def a20_encoded(spark, sf):
    o = _orders(spark, sf, "o_totalprice", "o_custkey", "o_orderpriority", "o_orderstatus")
    out = report.encoded_spearman(o, ["o_custkey"], ["o_orderpriority", "o_orderstatus"], ["o_totalprice"], "o_totalprice", "o_orderkey")
    return out.withColumn("corr", F.round("corr", 5))


@register("s4_feed_order", """
SELECT CAST(row_number() OVER (ORDER BY station NULLS FIRST, time NULLS FIRST, feed_seq) - 1 AS BIGINT) AS place, station, time FROM weather_obs
""")
def s4_order(spark, sf):
    """A feed written in one order of (station, time) comes back numbered in it."""
    from legflow.sources import io

    path = io.scratch_table_path(spark, "feed-order")
    w = fx.weather_obs(spark, sf)
    feed = w.orderBy("station", "time", "feed_seq").select(
        "station", F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time"),
        *[F.col(c) if c in w.columns else F.lit("M").alias(c) for c in io.FEED_FIELDS[1:]])
    feed.write.option("header", True).csv(path)
    return io.read_station_feed(spark, path).select(F.col("feed_seq").alias("place"), "station", "time")


# ------------------------------------------------------------------ models in closed form

@register("r5_ridge_one_column", """
WITH s AS (SELECT covar_pop(l_extendedprice, l_quantity) * count(*) AS sxy, var_pop(l_quantity) * count(*) AS sxx,
                  avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem)
SELECT round(sxy / (sxx + 5000), 3) AS slope, round(my - sxy / (sxx + 5000) * mx, 1) AS offset_ FROM s
""")
def r5_one(spark, sf):
    """||y - xb||^2 + 5000 b^2 in one column."""
    x = fx.read_table(spark, sf, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label"))
    v = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(x)
    m = model.ridge(v, alpha=5000.0).fit(v)
    return spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "slope double, offset_ double").select(
        F.round("slope", 3).alias("slope"), F.round("offset_", 1).alias("offset_"))


@register("e13_e14_one_column_coefficient", """
SELECT 'l_quantity' AS feature, round(exp(sum(l_quantity * (l_extendedprice / 10000)) / sum(l_quantity * l_quantity)), 6) AS odds FROM lineitem
""")
def e14_one(spark, sf):
    x = fx.read_table(spark, sf, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 10000).alias("label"))
    kept, m = select.backward_elimination(x, ["l_quantity"], "label")
    return select.coefficient_table(spark, m, kept).select("feature", r6(F.col("odds")).alias("odds"))


@register("r17_tuning_report_table", """
WITH r AS (SELECT CAST(l_linenumber AS INTEGER) AS idx, avg(l_extendedprice) AS mse, stddev_pop(l_extendedprice) AS mse_std, avg(l_quantity) AS mae,
                  stddev_pop(l_quantity) AS mae_std, avg(l_discount) AS r2, stddev_pop(l_discount) AS r2_std FROM lineitem GROUP BY 1),
a AS (SELECT arg_min(idx, (mse, idx)) AS i1, min(mse) AS b1, avg(mse) AS m1, arg_min(idx, (mae, idx)) AS i2, min(mae) AS b2, avg(mae) AS m2,
             arg_min(idx, (-r2, idx)) AS i3, max(r2) AS b3, avg(r2) AS m3 FROM r)
SELECT 'mse' AS metric, i1 AS best_idx, round(b1, 4) AS best, round(m1, 4) AS mean_score FROM a UNION ALL
SELECT 'mae', i2, round(b2, 4), round(m2, 4) FROM a UNION ALL SELECT 'r2', i3, round(b3 * 100, 4), round(m3 * 100, 4) FROM a UNION ALL
SELECT 'rmse', i1, round(sqrt(b1), 4), round(sqrt(m1), 4) FROM a
""")
def r17_table(spark, sf):
    li = fx.read_table(spark, sf, "lineitem")
    res = li.groupBy(F.col("l_linenumber").cast("int").alias("idx")).agg(
        *[x for m, c in (("mse", "l_extendedprice"), ("mae", "l_quantity"), ("r2", "l_discount"))
          for x in (F.avg(c).alias(m), F.stddev_pop(c).alias(f"{m}_std"))])
    return model.tuning_report(res).select("metric", "best_idx", F.round("best", 4).alias("best"), F.round("mean_score", 4).alias("mean_score"))


def _priced(spark, sf):
    return fx.read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", F.col("l_extendedprice").alias("label"))


@register("s7_reloaded_chain_scores", f"""
SELECT count(*) AS n_scored, 0.0 AS max_abs_diff FROM lineitem WHERE {uniform_sql('l_orderkey', 8)} < 0.2
""")
def s7_scores(spark, sf):
    """A chain saved, reloaded by its manifest, and applied beside the one in memory."""
    from legflow.sources import io

    train, test = model.train_test_split(_priced(spark, sf), "l_orderkey", seed=8, arithmetic=True)
    chain = model.fit_chain(train, "ridge", ["l_quantity", "l_discount", "l_tax"], categorical=["l_returnflag"], scaler="robust", pca_k=3, whiten=True)
    path = io.scratch_table_path(spark, "chain")
    chain.save(path)
    again = io.load_chain(path)
    cols = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]
    both = again.transform(chain.transform(test.withColumns({f"raw_{c}": F.col(c) for c in cols})).select(
        *[F.col(f"raw_{c}").alias(c) for c in cols], "label", F.col("prediction").alias("first")))
    return both.agg(F.count("*").alias("n_scored"), F.round(F.max(F.abs(F.col("prediction") - F.col("first"))), 6).alias("max_abs_diff"))


@register("r11_r14_named_chain_scores", f"""
SELECT count(*) AS n_scored, count(*) AS n_predicted FROM lineitem WHERE {uniform_sql('l_orderkey', 9)} < 0.2
""")
def r14_named(spark, sf):
    """The ridge chain by name: leave-one-out codes, min-max, chi-square best columns, ridge."""
    train, test = model.train_test_split(_priced(spark, sf).withColumn("label", F.round(F.col("label") / 10000)), "l_orderkey", seed=9, arithmetic=True)
    chain = model.fit_named(train, "ridge", ["l_quantity", "l_discount", "l_tax"], categorical=["l_returnflag"])
    scored = chain.transform(test)
    return scored.agg(F.count("*").alias("n_scored"), F.count("prediction").alias("n_predicted"))


@register("r24_importance_total", f"""
SELECT count(*) AS n_scored, 1.0 AS total FROM lineitem WHERE {uniform_sql('l_orderkey', 10)} < 0.2
""")
def r24_total(spark, sf):
    train, test = model.train_test_split(_priced(spark, sf), "l_orderkey", seed=10, arithmetic=True)
    chain = model.fit_chain(train, "rf", ["l_quantity", "l_discount", "l_tax"], scaler=None, rounds=500)
    imp = evaluate.feature_importances(spark, chain.model.stages[-1], chain.assembler_cols).agg(F.round(F.sum("importance"), 2).alias("total"))
    return chain.transform(test).agg(F.count("prediction").alias("n_scored")).crossJoin(F.broadcast(imp))


@register("r25_permutation_keeps_rows", """
SELECT count(*) AS n_rows, round(sum(l_quantity), 2) AS total, count(DISTINCT l_quantity) AS n_values FROM lineitem
""")
def r25_rows(spark, sf):
    """The permutation under R25: every row keeps its place, every value is dealt once."""
    li = fx.read_table(spark, sf, "lineitem").withColumn("row_id", li_row_id())
    out = evaluate.permuted(li, "l_quantity", "row_id", seed=3)
    return out.agg(F.count("*").alias("n_rows"), F.round(F.sum("l_quantity"), 2).alias("total"),
                   F.countDistinct("l_quantity").alias("n_values"))
