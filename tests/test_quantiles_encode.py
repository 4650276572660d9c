"""Exact ranks / quantiles, encoders, scalers, PCA, regression penalty mapping."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from legflow.operators import encode, model, report
from legflow.operators.quantiles import average_ranks, quantiles


def test_quantiles_and_ranks_with_ties(spark):
    rng = np.random.default_rng(0)
    vals = np.round(rng.normal(size=3000), 1)
    df = spark.createDataFrame([("g", float(v)) for v in vals], "g string, v double")
    q = {r.q: r.quantile for r in quantiles(df, "g", "v", [0.1, 0.25, 0.5, 0.9]).collect()}
    for p, v in q.items():
        assert v == pytest.approx(np.quantile(vals, p))
    ranks = {r.v: r.avg_rank for r in average_ranks(df, "g", "v").collect()}
    expect = pd.Series(vals).rank(method="average")
    for v, r in zip(vals[:200], expect[:200]):
        assert ranks[float(v)] == pytest.approx(r)


def test_rank_matrix_is_the_same_looked_up_and_joined(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": range(400), "a": rng.integers(0, 5, 400), "b": rng.normal(size=400), "c": rng.integers(0, 60, 400)}).astype(
        {"a": float, "c": float})
    pdf["c"] += pdf["a"] * 9
    pdf.loc[rng.random(400) < 0.1, "b"] = None
    rows = [tuple(None if v != v else v for v in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double")
    ranks = pdf[["a", "b", "c"]].rank()
    for most in (report.RANK_ROWS, 100, 0):
        monkeypatch.setattr(report, "RANK_ROWS", most)
        out = report.spearman_long(df, ["a", "b", "c"], "id")
        got = {(r.x, r.y): r["corr"] for r in out.collect()}
        assert len(got) == 9
        for (x, y), v in got.items():
            assert v == pytest.approx(ranks[x].corr(ranks[y])), (most, x, y)
        if most > 1000:  # the rows themselves go through one exchange only, the sums' own
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert plan.split("Initial Plan")[-1].count("Exchange SinglePartition") == 1 and "SortMergeJoin" not in plan


def test_leave_one_out_hand_cases(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "c string, label double")
    m, tr = encode.LeaveOneOutEncoder(["c"], "label").fit_transform(df)
    got = sorted((r.c, r.label) for r in tr.select(F.col("c"), "label").collect())
    # (sum - own) / (n - 1) within "a"; the singleton "b" gets the prior 3.0
    assert got == [(1.0, 3.0), (3.0, 1.0), (3.0, 5.0)]
    test = spark.createDataFrame([("a",), ("zz",), (None,)], "c string")
    assert sorted(r.c for r in m.transform(test).collect()) == [2.0, 3.0, 3.0]


def test_scaler_round_trip_and_null(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, None), (4.0, 30.0)], "a double, b double")
    for cls in (encode.StandardScaler, encode.MinMaxScaler, encode.RobustScaler):
        m = cls(["a", "b"]).fit(df)
        back = m.inverse_transform(m.transform(df)).collect()
        assert [r.a for r in back] == pytest.approx([1.0, 2.0, 4.0])
        assert back[1].b is None


def test_pca_matches_numpy_eigen(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)) @ np.array([[2, 0, 0], [1, 1, 0], [0, 0.3, 0.2]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    m = encode.CenteredPCA(["a", "b", "c"], 2).fit(df)
    cov = np.cov(x, rowvar=False)
    w, v = np.linalg.eigh(cov)
    top = v[:, np.argsort(w)[::-1][:2]]
    for j in range(2):
        assert abs(np.dot(top[:, j], m.components[j])) == pytest.approx(1.0, abs=1e-6)
    z = np.array([[r.pc1, r.pc2] for r in m.transform(df).collect()])
    assert abs(z[:, 0].mean()) < 1e-9


def test_ridge_penalty_mapping_matches_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) * np.array([1, 10, 0.1])
    y = x @ np.array([1.0, -0.5, 3.0]) + rng.normal(size=200)
    rows = [tuple(map(float, r)) + (float(t),) for r, t in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, c double, label double")
    vec = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    alpha = 0.5
    m = model.ridge(vec, alpha).setFitIntercept(True).fit(vec)
    xc, yc = x - x.mean(0), y - y.mean()
    beta = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
    assert np.allclose(m.coefficients.toArray(), beta, atol=1e-5)


def test_stratified_folds_balanced(spark):
    df = spark.range(1000).withColumn("label", (F.col("id") % 3).cast("int"))
    f = model.stratified_folds(df, "label", "id", k=5, buckets=8)
    counts = {(r.fold, r.label): r.n for r in f.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    for lab in range(3):
        per = [counts[(k, lab)] for k in range(5)]
        assert max(per) - min(per) <= 1


def test_bracketed_quantiles_are_the_exact_ones(spark, monkeypatch):
    from legflow.operators import quantiles as ranks

    rng = np.random.default_rng(4)
    n = 30_000
    rows = [(float(a), float(b), None if i % 7 == 0 else float(i % 5), float(i)) for i, (a, b) in enumerate(zip(rng.normal(size=n), rng.integers(0, 3, n)))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    ranked = []
    plain = ranks.value_ranks
    monkeypatch.setattr(ranks, "value_ranks", lambda long, g, v, weight=None: (ranked.append(long.distinct().count()), plain(long, g, v, weight))[1])
    for x in (df, df.limit(1), df.limit(2), df.limit(9), df.limit(0), df.withColumn("b", F.lit(None).cast("double")),
              df.withColumn("a", F.when(F.col("d") % 3 == 0, float("nan")).otherwise(F.col("a")))):
        x = x.localCheckpoint()  # the same rows for both
        want = {(r["column"], r["q"]): r["quantile"] for r in ranks.wide_quantiles(x, ["a", "b", "c", "d"], probs).collect()}
        ranked.clear()
        got = ranks.bracketed_quantiles(x, ["a", "b", "c", "d"], probs)
        assert got.keys() == want.keys() and all(got[k] == want[k] or (np.isnan(got[k]) and np.isnan(want[k])) for k in want)
        if x.count() == n and not x.where("isnan(a)").count():
            assert ranked and ranked[0] < n / 50


def test_few_levels_are_broadcast_whatever_the_estimate(spark):
    """The optimizer takes a written level table for as large as the rows it was fitted on; joined by a shuffle, a level would be one task."""
    a, b = spark.range(3000).toDF("a"), spark.range(3000).toDF("b")
    df = a.join(b, F.col("a") == F.col("b")).select((F.col("a") % 3).cast("string").alias("k"), (F.col("a") % 2).cast("string").alias("m"), F.col("a").cast("double").alias("label"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m, out = encode.LeaveOneOutEncoder(["k", "m"]).fit_transform(df)
        codes = encode.OrdinalEncoder(["k", "m"]).fit(df)
        for x in (m.transform(df), out, codes.transform(df), codes.inverse_transform(codes.transform(df))):
            plan = x._jdf.queryExecution().sparkPlan().toString()
            assert plan.count("BroadcastHashJoin") >= 2 and plan.count("SortMergeJoin") <= 1  # the rows' own join
        assert out.count() == 3000 and codes.transform(df).where("k is null or m is null").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_many_levels_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(encode, "BROADCAST_MAX_BYTES", 100)
    df = spark.range(40).select((F.col("id") % 8).cast("string").alias("k"), F.col("id").cast("double").alias("label"))
    out = encode.LeaveOneOutEncoder(["k"]).fit(df).transform(df)
    assert sorted({r.k for r in out.collect()}) == [16.0 + i for i in range(8)]
