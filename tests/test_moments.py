"""Moment matrices against plain numpy: models, branches, folds, elimination, imputation."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from legflow.operators import impute, model, moments, select


def frame(spark, n=400, d=4, seed=1, offset=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + offset + np.arange(d)
    y = np.round(x @ np.arange(1, d + 1) / 3 + rng.normal(size=n))
    fold = rng.integers(0, 5, n)
    cols = [f"x{i}" for i in range(d)]
    df = spark.createDataFrame([(*map(float, r), float(v), int(f)) for r, v, f in zip(x, y, fold)],
                               ", ".join(f"{c} double" for c in cols) + ", label double, fold int")
    return df, cols, x, y, fold


def test_moments_of_far_columns_with_gaps(spark):
    df, cols, x, y, fold = frame(spark, offset=1e7)
    gappy = df.unionByName(df.limit(5).selectExpr("CAST(NULL AS DOUBLE) AS x0", *cols[1:], "label", "fold")).unionByName(
        df.limit(5).selectExpr("CAST('NaN' AS DOUBLE) AS x0", *cols[1:], "label", "CAST(NULL AS INT) AS fold"))
    got = moments.moments(gappy.repartition(3), [*cols, "label"], "fold")
    z = np.column_stack([x, y])
    for f in range(5):
        part = z[fold == f]
        m = got[f]
        assert m.n == len(part) and np.allclose(m.mean, part.mean(axis=0), rtol=1e-14)
        assert np.allclose(m.ss, (part - part.mean(axis=0)).T @ (part - part.mean(axis=0)), rtol=1e-7, atol=1e-5)
        assert np.allclose(m.low, part.min(axis=0)) and np.allclose(m.high, part.max(axis=0))
    rest = moments.without(got, 2)
    part = z[fold != 2]
    assert rest.n == len(part) and np.allclose(rest.ss, np.cov(part.T, bias=True) * len(part), rtol=1e-7, atol=1e-4)
    assert moments.moments(df.limit(0), cols) == {}


def reduced(x, y, branch):
    """(function to the reduced columns) of a branch fitted on numpy rows."""
    s = {"standard": lambda: (x.mean(axis=0), x.std(axis=0)), "minmax": lambda: (x.min(axis=0), x.max(axis=0) - x.min(axis=0)),
         "robust": lambda: (np.median(x, axis=0), np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0))}[branch["scaler"]]()
    z = (x - s[0]) / s[1]
    if branch.get("pca_k"):
        mean = z.mean(axis=0)
        u, w, vt = np.linalg.svd(z - mean, full_matrices=False)
        v = vt[:branch["pca_k"]].T
        if branch.get("whiten"):
            v = v / (w[:branch["pca_k"]] / math.sqrt(len(z) - 1))
        return lambda q: ((q - s[0]) / s[1] - mean) @ v
    chi2 = []
    for j in range(z.shape[1]):
        c = 0.0
        for k in np.unique(y):
            e = (y == k).mean() * z[:, j].sum()
            c += (z[y == k, j].sum() - e) ** 2 / e if e else 0
        chi2.append(c)
    keep = sorted(sorted(range(len(chi2)), key=lambda j: (-chi2[j], j))[:branch["chi2_k"]])
    return lambda q: ((q - s[0]) / s[1])[:, keep]


def descended(z, y, alpha, ratio, steps=20_000):
    """Proximal gradient with the constant step of the largest eigenvalue."""
    n, b = len(y), np.zeros(z.shape[1])
    step = 1 / (np.linalg.eigvalsh(z.T @ z / n)[-1] + alpha * (1 - ratio))
    for _ in range(steps):
        g = z.T @ (z @ b - y) / n + alpha * (1 - ratio) * b
        b = b - step * g
        b = np.sign(b) * np.maximum(np.abs(b) - step * alpha * ratio, 0)
    return b


@pytest.mark.parametrize("name", ["ridge", "lasso", "elastic"])
def test_branches_equal_plain_chains(spark, name):
    df, cols, x, y, fold = frame(spark)
    extra = dict(ridge=dict(alpha=3.0), lasso=dict(alpha=0.2), elastic=dict(alpha=0.3, l1_ratio=0.6))[name]
    branches = [dict(scaler=s, pca_k=k, whiten=w, **extra) for s, k, w in itertools.product(("standard", "robust"), (2, 4), (True, False))]
    branches += [dict(scaler="minmax", chi2_k=k, **extra) for k in (2, 4)]
    scores, fits = moments.fold_scores(df, name, cols, branches)
    assert len(scores) == 5 * len(branches)
    for i, b in enumerate(branches):
        for f in range(5):
            tr = fold != f
            red = reduced(x[tr], y[tr], b)
            z, zc = red(x[tr]), red(x[tr]).mean(axis=0)
            yc = y[tr] - y[tr].mean()
            if name == "ridge":
                w = np.linalg.solve((z - zc).T @ (z - zc) + 3.0 * np.eye(z.shape[1]), (z - zc).T @ yc)
            else:
                w = descended(z - zc, yc, extra["alpha"], extra.get("l1_ratio", 1.0))
            e = y[~tr] - (y[tr].mean() + (red(x[~tr]) - zc) @ w)
            got = next(s for s in scores if s["idx"] == i and s["fold"] == f)
            assert got["mse"] == pytest.approx((e ** 2).mean(), rel=1e-5) and got["mae"] == pytest.approx(np.abs(e).mean(), rel=1e-5)
            assert got["r2"] == pytest.approx(1 - (e ** 2).sum() / ((y[~tr] - y[~tr].mean()) ** 2).sum(), rel=1e-5)
    pred = np.array([r[0] for r in fits[0].transform(df).select("prediction").collect()])
    assert np.allclose(pred.mean(), y.mean())


def test_linear_fits_equal_mllib(spark):
    df, cols, _, _, _ = frame(spark)
    v = VectorAssembler(inputCols=cols, outputCol="features").transform(df)
    m = moments.moments(df, [*cols, "label"])[0]
    for name, factory in (("ridge", lambda: model.ridge(v, 2.0)), ("lasso", lambda: model.lasso(v, 0.1)), ("elastic", lambda: model.elastic_net(v, 0.1, 0.9))):
        params = dict(ridge=dict(alpha=2.0), lasso=dict(alpha=0.1), elastic=dict(alpha=0.1, l1_ratio=0.9))[name]
        fit, = moments.fit_branches(m, name, cols, "label", [params])
        other = factory().fit(v)
        assert np.allclose(fit.coefficients, list(other.coefficients), atol=2e-4) and fit.intercept == pytest.approx(other.intercept, abs=2e-3)


def test_sparse_solutions_meet_their_conditions():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6))
    x[:, 5] = x[:, 0]  # equal columns
    y = x[:, 0] * 3 - x[:, 2] + rng.normal(size=300)
    x, y = x - x.mean(axis=0), y - y.mean()
    start = None
    for alpha, ratio in itertools.product((1.0, 0.1, 1e-4, 1e-6), (1.0, 0.5)):
        start = moments.elastic_solution(x.T @ x, x.T @ y, 300, alpha, ratio, start)
        assert moments.optimality_gap(x.T @ x, x.T @ y, 300, start, alpha, ratio) < 1e-9
    assert not moments.elastic_solution(np.zeros((2, 2)), np.zeros(2), 10, 0.1, 1.0).any()


def test_student_distribution():
    for t, dof, p in ((2.228138852, 10, 0.05), (12.7062047, 1, 0.05), (1.959963985, 1e9, 0.05), (0.0, 5, 1.0), (4.032142984, 5, 0.01)):
        assert moments.t_two_sided(t, dof) == pytest.approx(p, rel=1e-6)
        if p < 1:
            assert moments.t_bound(1 - p, dof) == pytest.approx(t, rel=1e-6)


def stepwise(x, y, names, level):
    names, removed = list(names), []
    while names:
        z = x[:, names]
        b = np.linalg.solve(z.T @ z, z.T @ y)
        dof = len(y) - len(names)
        se = np.sqrt(((y - z @ b) ** 2).sum() / dof * np.diag(np.linalg.inv(z.T @ z)))
        p = [moments.t_two_sided(t, dof) for t in b / se]
        worst = int(np.argmax(p))
        if p[worst] <= level:
            return names, b, se, p, removed
        removed.append(names.pop(worst))


def test_elimination_by_sweeps_is_the_stepwise_one(spark):
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.normal(size=200) * 10.0 ** rng.integers(-3, 4) for _ in range(6)])
    y = x[:, 1] / x[:, 1].std() + 0.3 * x[:, 4] / x[:, 4].std() + rng.normal(size=200)
    cols = [f"x{i}" for i in range(6)]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], ", ".join(f"{c} double" for c in cols) + ", label double")
    kept, fit = select.backward_elimination(df, cols, "label", 0.05)
    names, b, se, p, removed = stepwise(x, y, range(6), 0.05)
    assert kept == [cols[i] for i in names] and fit.removed == [cols[i] for i in removed] and len(removed) >= 2
    assert np.allclose(fit.coefficients, b) and np.allclose(fit.errors, se) and np.allclose(fit.p_values, p, atol=1e-12)
    table = {r.feature: r for r in select.coefficient_table(spark, fit, kept).collect()}
    assert table[kept[0]].upper == pytest.approx(float(np.exp(b[0] + moments.t_bound(0.95, fit.dof) * se[0])))
    twin = df.withColumn("copy", df["x1"] * 2)
    assert select.backward_elimination(twin, [*cols, "copy"], "label", 0.05)[0] == kept
    assert select.backward_elimination(df, ["x0"], "label", 1e-30)[0] == [] and select.backward_elimination(df.limit(0), cols)[0] == []
    assert select.coefficient_table(spark, None, []).count() == 0


def test_recursive_elimination_is_the_plain_one(spark):
    df, cols, x, y, fold = frame(spark, n=250)
    kept, history = select.recursive_elimination_cv(df, cols, alpha=0.3)
    names, want = list(range(4)), []
    while names:
        mse = []
        for f in range(5):
            tr = fold != f
            zc, yc = x[tr][:, names].mean(axis=0), y[tr].mean()
            b = descended(x[tr][:, names] - zc, y[tr] - yc, 0.3, 1.0)
            mse.append(((y[~tr] - yc - (x[~tr][:, names] - zc) @ b) ** 2).mean())
        want.append((len(names), np.mean(mse)))
        b = descended(x[:, names] - x[:, names].mean(axis=0), y - y.mean(), 0.3, 1.0)
        names.pop(int(np.argmin(np.abs(b))))
    assert [n for n, _ in history] == [4, 3, 2, 1] and np.allclose([s for _, s in history], [s for _, s in want], rtol=1e-5)
    assert len(kept) == min(want, key=lambda h: (h[1], h[0]))[0]


def plain_chained(x, rounds, reg):
    gap = np.isnan(x)
    x = np.where(gap, np.nanmean(x, axis=0), x)
    order = sorted(np.flatnonzero(gap.any(axis=0)), key=lambda c: (gap[:, c].sum(), c))
    for _ in range(rounds):
        for c in order:
            rows, others = ~gap[:, c], [o for o in range(x.shape[1]) if o != c]
            z, t = x[rows][:, others], x[rows, c]
            s = z.std(axis=0) * math.sqrt(len(z))
            zc = (z - z.mean(axis=0)) / s
            w = np.linalg.solve(zc.T @ zc + reg * np.eye(len(others)), zc.T @ (t - t.mean())) / s
            x[gap[:, c], c] = t.mean() + (x[gap[:, c]][:, others] - z.mean(axis=0)) @ w
    return x


@pytest.mark.parametrize("patterns", [impute.PATTERNS, 2])
def test_chained_equations_equal_plain_ones(spark, patterns):
    """From the moments of missing-cell patterns, and from a scan a regression where there are too many patterns."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 3)) + 5
    x[rng.random(x.shape) < np.array([0.1, 0.3, 0.2])] = np.nan
    x[0] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "k bigint, a double, b double, c double")
    rounds = 10 if patterns > 2 else 2
    imp = impute.IterativeImputer(["a", "b", "c"], "k", max_iter=rounds, reg=1e-6, patterns=patterns).fit(df)
    got = np.array([tuple(r)[1:] for r in imp.transform(df).orderBy("k").collect()])
    assert np.allclose(got, plain_chained(x, rounds, 1e-6), rtol=1e-6, atol=1e-6)


def test_chained_equations_without_values_or_rows(spark):
    df = spark.createDataFrame([(1, None, 1.0, 2.0), (2, None, None, 4.0), (3, None, 3.0, None)], "k bigint, a double, b double, c double")
    got = [tuple(r) for r in impute.IterativeImputer(["a", "b", "c"], "k").fit_transform(df).orderBy("k").collect()]
    assert all(r[1] is None and r[2] is not None and r[3] is not None for r in got)
    assert impute.IterativeImputer(["b", "c"], "k").fit_transform(df.limit(0)).count() == 0
    whole = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 5.0)], "k bigint, a double, b double")
    assert impute.IterativeImputer(["a", "b"], "k").fit_transform(whole).orderBy("k").collect() == whole.collect()


def test_reconstruction_rounds_inside_the_row(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 1)) @ np.array([[1.0, 2.0, -1.0]]) + rng.normal(size=(200, 3)) * 0.1 + 3
    full = x.copy()
    x[:150][rng.random((150, 3)) < 0.3] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "k bigint, a double, b double, c double")
    imp = impute.ReconstructImputer(["a", "b", "c"], "k", k=1, max_iter=25, blend=0.5).fit(df)
    got = np.array([tuple(r)[1:] for r in imp.transform(df).orderBy("k").collect()])
    whole = x[~np.isnan(x).any(axis=1)]
    center, scale = whole.mean(axis=0), whole.std(axis=0)
    v = np.linalg.svd((whole - center) / scale, full_matrices=False)[2][0]
    gap = np.isnan(x)
    z = np.where(gap, 0.0, (x - center) / scale)
    for _ in range(25):
        z = np.where(gap, 0.5 * z + 0.5 * np.outer(z @ v, v), z)
    assert np.allclose(got, z * scale + center, atol=1e-8)
    early = np.array([tuple(r)[1:] for r in imp.transform(df, rounds=1).orderBy("k").collect()])
    some = gap & (gap.sum(axis=1) == 1)[:, None]
    assert np.abs(got - full)[some].mean() < np.abs(early - full)[some].mean()


def test_stacking_bases_are_out_of_fold(spark):
    df, cols, _, _, _ = frame(spark, n=200)
    chain = model.fit_chain(df, "stacking", cols, rounds=3)
    out = chain.transform(df)
    assert {"p_ridge", "p_lasso", "p_elastic", "prediction"} <= set(out.columns) and out.filter("prediction is null").count() == 0
