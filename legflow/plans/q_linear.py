"""Queries over moment matrices: validation, tuning, penalties, elimination, imputation; their SQL solves the normal equations.

The rows are orders described by their lines, with whole-number labels, so
that folds are stratified on the label as they are on whole minutes.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legflow.functions.nulls import uniform, uniform_sql
from legflow.operators import encode, evaluate, impute, model, moments, select
from legflow.plans.catalog import register
from legflow.sources import fixtures as fx

FEATURES = ["n_lines", "quantity", "discount", "tax", "returned"]

_ROWS_SQL = f"""
x AS (SELECT l_orderkey AS k, CAST(count(*) AS DOUBLE) AS n_lines, sum(l_quantity) AS quantity, avg(l_discount) AS discount, avg(l_tax) AS tax,
             avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS returned, floor(round(sum(l_extendedprice) * 100) / 2500000) AS label
      FROM lineitem GROUP BY 1),
f AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY {uniform_sql('k', 101)}, k) - 1) % 5 AS INTEGER) AS fold FROM x)"""


def order_rows(spark, sf) -> DataFrame:
    li = fx.read_table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.count("*").cast("double").alias("n_lines"), F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"),
        F.avg("l_tax").alias("tax"), F.avg((F.col("l_returnflag") == "R").cast("double")).alias("returned"),
        F.floor(F.round(F.sum("l_extendedprice") * 100) / 2500000).cast("double").alias("label"))


def folded(spark, sf) -> DataFrame:
    """Written once: the rows are an aggregate, and their folds a count, a shuffle and a window."""
    from legflow.session import written

    return written(model.stratified_folds(written(order_rows(spark, sf), "orders"), "label", "k", arithmetic=True), "folds")


# ------------------------------------------------------------------ normal equations in SQL

def sums_sql(cols: list[str], source: str, folds: bool) -> str:
    """One row for each training set t (fold t left out, or -1 for all rows) with means, bounds, deviations and sums of products."""
    names = [*cols, "label"]
    pairs = [f"covar_pop({a}, {b}) * count(*) AS s_{a}__{b}" for i, a in enumerate(names) for b in names[i:]]
    stats = [x for c in names for x in (f"avg({c}) AS a_{c}", f"min({c}) AS lo_{c}", f"max({c}) AS hi_{c}", f"stddev_pop({c}) AS d_{c}")]
    sets = f"{source} JOIN (SELECT DISTINCT fold AS t FROM {source} UNION ALL SELECT -1) ON fold <> t" if folds else f"(SELECT *, -1 AS t FROM {source})"
    return f"SELECT t, count(*) AS n, {', '.join(stats + pairs)} FROM {sets} GROUP BY t"


def solved_sql(cols: list[str], sums: str, scale, penalty: str, penalties: str) -> str:
    """CTEs up to ``fit`` (t, idx, b_<col>, offset_): Gauss-Jordan on (X'X + penalty I | X'y), pivot by pivot.

    ``scale(c)``: what a column is divided by.  ``penalties``: rows (idx, ...); ``penalty``: an expression over them and sums.
    """
    at = {c: i + 1 for i, c in enumerate(cols)}
    pair = lambda a, b: f"s_{a}__{b}" if at.get(a, 99) <= at.get(b, 99) else f"s_{b}__{a}"
    cells = [f"SELECT t, idx, {at[a]} AS i, {at[b]} AS j, {pair(a, b)} / ({scale(a)} * {scale(b)})" + (f" + {penalty}" if a == b else "") + " AS v FROM w"
             for a in cols for b in cols]
    cells += [f"SELECT t, idx, {at[a]}, {len(cols) + 1}, {pair(a, 'label')} / {scale(a)} FROM w" for a in cols]
    out = f"w AS MATERIALIZED (SELECT * FROM ({sums}), ({penalties})),\nm0 AS MATERIALIZED ({' UNION ALL '.join(cells)})"
    for s in range(1, len(cols) + 1):
        p = f"m{s - 1}"
        out += f""",
m{s} AS MATERIALIZED (SELECT a.t, a.idx, a.i, a.j, CASE WHEN a.i = {s} THEN a.v / p.v ELSE a.v - c.v * r.v / p.v END AS v
  FROM {p} a JOIN {p} p ON p.t = a.t AND p.idx = a.idx AND p.i = {s} AND p.j = {s}
  JOIN {p} r ON r.t = a.t AND r.idx = a.idx AND r.i = {s} AND r.j = a.j JOIN {p} c ON c.t = a.t AND c.idx = a.idx AND c.i = a.i AND c.j = {s})"""
    last = len(cols) + 1
    b = {c: f"max(CASE WHEN i = {at[c]} AND j = {last} THEN v END)" for c in cols}
    return out + f""",
fit AS (SELECT z.*, {', '.join(f'z.z_{c} / {scale(c)} AS b_{c}' for c in cols)},
               a_label - ({' + '.join(f'z.z_{c} / {scale(c)} * a_{c}' for c in cols)}) AS offset_
        FROM (SELECT t, idx, {', '.join(f'{v} AS z_{c}' for c, v in b.items())} FROM m{len(cols)} GROUP BY t, idx) z JOIN w USING (t, idx))"""


def scored_sql(cols: list[str], source: str) -> str:
    """CTEs ``score`` (idx, fold, mse, mae, r2) of each fold by the fit without it."""
    predicted = " + ".join(f"b_{c} * {c}" for c in cols)
    return f"""
score AS (SELECT idx, fold, avg(e * e) AS mse, avg(abs(e)) AS mae, 1 - avg(e * e) / var_pop(label) AS r2
          FROM (SELECT idx, fold, label, label - (offset_ + {predicted}) AS e FROM {source} JOIN fit ON fold = t) GROUP BY idx, fold)"""


def grid(alphas) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS idx, {a} AS alpha" for i, a in enumerate(alphas))


MINMAX = "(hi_{0} - lo_{0})".format
STANDARD = "d_{0}".format

# ------------------------------------------------------------------ R13, R15..R17


@register("r13_cross_validation", f"""
WITH {_ROWS_SQL},
{solved_sql(FEATURES, sums_sql(FEATURES, 'f', True), MINMAX, 'alpha', grid([0.5]))},
{scored_sql(FEATURES, 'f')}
SELECT CAST(fold AS VARCHAR) AS fold, round(mse, 4) AS mse, round(mae, 4) AS mae, round(r2, 4) AS r2 FROM score
UNION ALL SELECT 'mean', round(avg(mse), 4), round(avg(mae), 4), round(avg(r2), 4) FROM score
UNION ALL SELECT 'std', round(stddev_pop(mse), 4), round(stddev_pop(mae), 4), round(stddev_pop(r2), 4) FROM score
""")
def r13(spark, sf):
    """The named ridge chain (min-max, all five columns within its chi-square choice) over five stratified folds."""
    cv = model.cross_validate_linear(folded(spark, sf), "ridge", FEATURES)
    return cv.select("fold", *[F.round(c, 4).alias(c) for c in ("mse", "mae", "r2")])


_ALPHAS = sorted({a for g in model.GRIDS["ridge"].values() for a in g["alpha"]})


@register("r15_r17_grid_search_report", f"""
WITH {_ROWS_SQL},
{solved_sql(FEATURES, sums_sql(FEATURES, 'f', True), STANDARD, 'alpha', grid(_ALPHAS))},
{scored_sql(FEATURES, 'f')},
r AS (SELECT idx, avg(mse) AS mse, stddev_pop(mse) AS mse_std, avg(mae) AS mae, stddev_pop(mae) AS mae_std, avg(r2) AS r2, stddev_pop(r2) AS r2_std
      FROM score GROUP BY idx),
best AS (SELECT 'mse' AS metric, arg_min(idx, mse) AS best_idx, min(mse) AS best, arg_min(mse_std, mse) AS best_std, avg(mse) AS mean_score FROM r
         UNION ALL SELECT 'mae', arg_min(idx, mae), min(mae), arg_min(mae_std, mae), avg(mae) FROM r
         UNION ALL SELECT 'r2', arg_max(idx, r2), max(r2) * 100, arg_max(r2_std, r2), avg(r2) * 100 FROM r
         UNION ALL SELECT 'rmse', arg_min(idx, mse), sqrt(min(mse)), arg_min(mse_std, mse), sqrt(avg(mse)) FROM r)
SELECT metric, best_idx, round(best, 4) AS best, round(best_std, 4) AS best_std, round(mean_score, 4) AS mean_score FROM best
""")
def r15(spark, sf):
    """Every ridge penalty of the grids on standardised columns, five folds, and the report of the search."""
    branches = [dict(scaler="standard", alpha=a) for a in _ALPHAS]
    res, _ = model.grid_search_linear(folded(spark, sf), "ridge", FEATURES, branches)
    return model.tuning_report(res).select("metric", "best_idx", *[F.round(c, 4).alias(c) for c in ("best", "best_std", "mean_score")])


@register("r15_refit_best", f"""
WITH {_ROWS_SQL},
{solved_sql(FEATURES, sums_sql(FEATURES, 'f', True), STANDARD, 'alpha', grid(_ALPHAS))},
{scored_sql(FEATURES, 'f')},
pick AS (SELECT idx FROM score GROUP BY idx ORDER BY avg(mse), idx LIMIT 1)
SELECT k, round(offset_ + {' + '.join(f'b_{c} * {c}' for c in FEATURES)}, 4) AS prediction
FROM f, fit WHERE t = -1 AND idx = (SELECT idx FROM pick)
""")
def r15_refit(spark, sf):
    """The penalty of least error, refitted on all rows and applied to them."""
    x = folded(spark, sf)
    res, fits = model.grid_search_linear(x, "ridge", FEATURES, [dict(scaler="standard", alpha=a) for a in _ALPHAS])
    return model.best_fit(res, fits).transform(x).select("k", F.round("prediction", 4).alias("prediction"))


@register("r16_branch_tuning")
def r16(spark, sf):
    """Every branch of the ridge grid: scalers, sizes, whitening, chi-square columns, penalties; five folds."""
    branches = model.model_grid("ridge", len(FEATURES))
    res = model.tune_chain(folded(spark, sf), "ridge", FEATURES, branches)
    return res.select("idx", "branch", F.round("mse", 3).alias("mse"), F.round("r2", 3).alias("r2"))


@register("r16_lasso_elastic_tuning")
def r16_sparse(spark, sf):
    """Every branch of the lasso and elastic net grids; five folds."""
    x, out = folded(spark, sf), None
    for name in ("lasso", "elastic"):
        res, _ = model.grid_search_linear(x, name, FEATURES, model.model_grid(name, len(FEATURES)))
        res = res.select(F.lit(name).alias("model"), "idx", "params", F.round("mse", 3).alias("mse"), F.round("r2", 3).alias("r2"))
        out = res if out is None else out.unionByName(res)
    return out


_FULL = [b for b in model.model_grid("ridge", len(FEATURES)) if b.get("pca_k") == len(FEATURES) and b["scaler"] == "standard" and not b["whiten"]]


@register("r16_full_size_branches", f"""
WITH {_ROWS_SQL},
{solved_sql(FEATURES, sums_sql(FEATURES, 'f', True), STANDARD, 'alpha', grid([b['alpha'] for b in _FULL]))},
{scored_sql(FEATURES, 'f')}
SELECT CAST(idx AS INTEGER) AS idx, round(avg(mse), 4) AS mse, round(avg(r2), 4) AS r2 FROM score GROUP BY idx
""")
def r16_full(spark, sf):
    """All components without whitening turn the columns only: the branch is ridge on the scaled columns."""
    res = model.tune_chain(folded(spark, sf), "ridge", FEATURES, _FULL)
    return res.select("idx", F.round("mse", 4).alias("mse"), F.round("r2", 4).alias("r2"))


_CHI2_SQL = ", ".join(
    f"sum(CASE WHEN e_{c} > 0 THEN (o_{c} - e_{c}) * (o_{c} - e_{c}) / e_{c} END) AS c_{c}" for c in FEATURES)


@register("r16_chi2_columns", f"""
WITH {_ROWS_SQL},
tr AS (SELECT * FROM f JOIN (SELECT DISTINCT fold AS t FROM f) ON fold <> t),
b AS (SELECT t, count(*) AS n, {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in FEATURES)} FROM tr GROUP BY t),
z AS (SELECT tr.t, label, {', '.join(f'({c} - lo_{c}) / (hi_{c} - lo_{c}) AS {c}' for c in FEATURES)} FROM tr JOIN b USING (t)),
p AS (SELECT t, label, count(*) AS m, {', '.join(f'sum({c}) AS o_{c}' for c in FEATURES)} FROM z GROUP BY t, label),
e AS (SELECT *, {', '.join(f'm / sum(m) OVER (PARTITION BY t) * sum(o_{c}) OVER (PARTITION BY t) AS e_{c}' for c in FEATURES)} FROM p),
s AS (SELECT t, {_CHI2_SQL} FROM e GROUP BY t)
""" + " UNION ALL ".join(f"SELECT CAST(t AS INTEGER) AS fold, '{c}' AS feature, round(c_{c}, 3) AS chi2 FROM s" for c in FEATURES))
def r16_chi2(spark, sf):
    """Chi-square of every column on every fold's training rows, from one class table."""
    x = folded(spark, sf)
    parts = moments.moments(x, [*FEATURES, "label"], "fold")
    got = moments.training_chi2(x, FEATURES, "label", "fold", parts, 5)
    rows = [(f, c, float(v)) for f in range(5) for c, v in got[f].items()]
    return spark.createDataFrame(rows, "fold int, feature string, chi2 double").withColumn("chi2", F.round("chi2", 3))


# ------------------------------------------------------------------ R6, R7

_PENALTIES = [(n, p.get("alpha"), p.get("l1_ratio", 1.0)) for n in ("lasso", "elastic")
              for p in [dict(zip(model.GRIDS[n]["pca"], v)) for v in itertools.product(*model.GRIDS[n]["pca"].values())]]
_PENALTIES += [("lasso", 0.05, 1.0), ("elastic", 0.05, 0.5)]


@register("r6_r7_one_column_paths", f"""
WITH {_ROWS_SQL}, w AS ({sums_sql(FEATURES, 'f', False)}),
p AS ({" UNION ALL ".join(f"SELECT '{n}' AS model, {a} AS alpha, {r} AS l1_ratio" for n, a, r in _PENALTIES)}),
s AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, s_{c}__{c} / n / (d_{c} * d_{c}) AS sxx, s_{c}__label / n / d_{c} AS sxy FROM w" for c in FEATURES)})
SELECT model, feature, alpha, l1_ratio,
       round(sign(sxy) * greatest(abs(sxy) - alpha * l1_ratio, 0) / (sxx + alpha * (1 - l1_ratio)), 6) + 0 AS coefficient FROM p, s
""")
def r6_r7_one(spark, sf):
    """One standardised column at a time: soft thresholds, for every penalty of the grids and two strong ones."""
    m = moments.moments(order_rows(spark, sf), [*FEATURES, "label"])[0]
    rows = []
    for n, a, r in _PENALTIES:
        for c in FEATURES:
            chain = moments.Chain(m, [c], "label", dict(scaler="standard"))
            _, b = chain.fit(n, dict(alpha=a, l1_ratio=r))
            rows.append((n, c, float(a), float(r), float(b[0])))
    out = spark.createDataFrame(rows, "model string, feature string, alpha double, l1_ratio double, coefficient double")
    return out.withColumn("coefficient", F.round("coefficient", 6) + 0)


@register("r6_r7_optimality", f"""
WITH p AS ({" UNION ALL ".join(f"SELECT '{n}' AS model, {a} AS alpha, {r} AS l1_ratio" for n, a, r in _PENALTIES)}),
c AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature" for c in FEATURES)})
SELECT model, alpha, l1_ratio, feature, true AS optimal FROM p, c
""")
def r6_r7_optimal(spark, sf):
    """The subgradient conditions of every penalty's solution, from the residuals of the rows themselves."""
    x = order_rows(spark, sf)
    m = moments.moments(x, [*FEATURES, "label"])[0]
    d = dict(zip(m.cols, (m.ss.diagonal() / m.n) ** 0.5))
    mean = dict(zip(m.cols, m.mean))
    z = x.select(*[((F.col(c) - F.lit(float(mean[c]))) / F.lit(float(d[c]))).alias(c) for c in FEATURES],
                 (F.col("label") - F.lit(float(mean["label"]))).alias("label"))
    fits = [moments.Chain(m, FEATURES, "label", dict(scaler="standard")).fit(n, dict(alpha=a, l1_ratio=r))[1] for n, a, r in _PENALTIES]
    aggs = []
    for i, b in enumerate(fits):
        e = F.col("label") - sum(F.col(c) * F.lit(float(v)) for c, v in zip(FEATURES, b))
        aggs += [F.avg(F.col(c) * e).alias(f"g{i}_{c}") for c in FEATURES]
    slope = z.agg(*aggs).first()
    rows = []
    for i, ((n, a, r), b) in enumerate(zip(_PENALTIES, fits)):
        for c, v in zip(FEATURES, b):
            g = slope[f"g{i}_{c}"] - a * (1 - r) * v
            gap = abs(g - a * r * (1 if v > 0 else -1)) if v else max(abs(g) - a * r, 0.0)
            rows.append((n, float(a), float(r), c, bool(gap < 1e-8)))
    return spark.createDataFrame(rows, "model string, alpha double, l1_ratio double, feature string, optimal boolean")


# ------------------------------------------------------------------ E13..E15

_NOISE = {"noise_a": (3, 2246822519), "noise_b": (7, 3266489917), "noise_c": (11, 668265263)}
_E13_SQL = ", ".join(f"{uniform_sql('k', s, m)} - 0.5 AS {c}" for c, (s, m) in _NOISE.items())


@register("e13_e14_backward_elimination", f"""
WITH {_ROWS_SQL}, y AS (SELECT n_lines, 1.0 AS always, label / 10 AS label FROM f),
s AS (SELECT count(*) AS n, sum(n_lines * n_lines) AS aa, sum(n_lines * always) AS ab, sum(always * always) AS bb,
             sum(n_lines * label) AS ay, sum(always * label) AS by_, sum(label * label) AS yy FROM y),
b AS (SELECT *, aa * bb - ab * ab AS det, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS b1, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS b2 FROM s),
v AS (SELECT *, (yy - b1 * ay - b2 * by_) / (n - 2) AS s2, n - 2 AS dof FROM b),
t AS (SELECT *, z + (z * z * z + z) / (4 * dof) + (5 * power(z, 5) + 16 * power(z, 3) + 3 * z) / (96 * dof * dof) AS q
      FROM v, (SELECT CAST(1.959963984540054 AS DOUBLE) AS z))
SELECT 'n_lines' AS feature, round(exp(b1), 4) AS odds, round(exp(b1 - q * sqrt(s2 * bb / det)), 4) AS lower, round(exp(b1 + q * sqrt(s2 * bb / det)), 4) AS upper, true AS significant FROM t
UNION ALL SELECT 'always', round(exp(b2), 4), round(exp(b2 - q * sqrt(s2 * aa / det)), 4), round(exp(b2 + q * sqrt(s2 * aa / det)), 4), true FROM t
""")
def e13(spark, sf):
    """Three columns of noise leave one by one; what stays has odds, bounds and p-values."""
    x = order_rows(spark, sf).withColumns({c: uniform("k", s, m) - 0.5 for c, (s, m) in _NOISE.items()}).withColumns(
        {"label": F.col("label") / 10, "always": F.lit(1.0)})
    kept, fit = select.backward_elimination(x, ["n_lines", "noise_a", "always", "noise_b", "noise_c"], "label", 0.01)
    return select.coefficient_table(spark, fit, kept).select(
        "feature", *[F.round(c, 4).alias(c) for c in ("odds", "lower", "upper")], (F.col("p_value") <= 0.01).alias("significant"))


@register("e15_recursive_elimination", f"""
WITH {_ROWS_SQL},
w AS MATERIALIZED ({sums_sql(['n_lines', 'tax'], 'f', True)}),
two AS (SELECT t, (s_tax__tax * s_n_lines__label - s_n_lines__tax * s_tax__label) / (s_n_lines__n_lines * s_tax__tax - s_n_lines__tax * s_n_lines__tax) AS b1,
               (s_n_lines__n_lines * s_tax__label - s_n_lines__tax * s_n_lines__label) / (s_n_lines__n_lines * s_tax__tax - s_n_lines__tax * s_n_lines__tax) AS b2,
               a_label, a_n_lines, a_tax FROM w),
left_ AS (SELECT abs(b1) < abs(b2) AS first_goes FROM two WHERE t = -1),
one AS (SELECT t, CASE WHEN first_goes THEN 0 ELSE s_n_lines__label / s_n_lines__n_lines END AS b1,
               CASE WHEN first_goes THEN s_tax__label / s_tax__tax ELSE 0 END AS b2, a_label, a_n_lines, a_tax FROM w, left_),
e AS (SELECT n_features, fold, label - a_label - b1 * (n_lines - a_n_lines) - b2 * (tax - a_tax) AS e FROM f JOIN
      (SELECT 2 AS n_features, * FROM two UNION ALL SELECT 1, * FROM one) ON fold = t)
SELECT n_features, round(avg(mse), 6) AS mse FROM (SELECT n_features, fold, avg(e * e) AS mse FROM e GROUP BY 1, 2) GROUP BY 1
""")
def e15(spark, sf):
    """Two columns without a penalty: the weaker one leaves; both sets scored on five folds from one scan."""
    _, history = select.recursive_elimination_cv(folded(spark, sf), ["n_lines", "tax"], alpha=0.0)
    return spark.createDataFrame(history, "n_features int, mse double").withColumn("mse", F.round("mse", 6))


@register("e15_lasso_elimination_curve")
def e15_lasso(spark, sf):
    """Five columns under the lasso penalty of the reports."""
    kept, history = select.recursive_elimination_cv(folded(spark, sf), FEATURES)
    return spark.createDataFrame([(n, s, n == len(kept)) for n, s in history], "n_features int, mse double, kept boolean").withColumn(
        "mse", F.round("mse", 4))


# ------------------------------------------------------------------ M10..M12

@register("m10_one_gappy_column", f"""
WITH x AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DOUBLE) AS a, CAST(o_custkey AS DOUBLE) AS b FROM orders),
g AS (SELECT k, b, CASE WHEN {uniform_sql('k', 31)} >= 0.3 THEN a END AS a FROM x),
r AS (SELECT regr_slope(a, b) AS s, regr_intercept(a, b) AS i FROM g)
SELECT k, round(coalesce(a, i + s * b), 3) AS a FROM g, r
""")
def m10_one(spark, sf):
    """One incomplete column beside a complete one: its regression on the observed rows, after ten rounds as after one."""
    o = fx.read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.when(uniform("o_orderkey", 31) >= 0.3, F.col("o_totalprice").cast("double")).alias("a"),
        F.col("o_custkey").cast("double").alias("b"))
    return impute.IterativeImputer(["a", "b"], "k", reg=0.0).fit_transform(o).select("k", F.round("a", 3).alias("a"))


#: A fixed reconstruction for the checked query: centre, scale and one component of three columns.
_FIXED = dict(center=[25.0, 0.05, 0.04], scale=[14.0, 0.03, 0.02], component=[0.6, 0.64, 0.48])
_R_COLS = ["quantity", "discount", "tax"]


@register("m11_m12_fixed_components", f"""
WITH RECURSIVE {_ROWS_SQL.replace('sum(l_quantity) AS quantity', 'avg(l_quantity) AS quantity')},
g AS (SELECT k, {', '.join(f"CASE WHEN {uniform_sql('k', 41 + i, m)} >= 0.25 THEN ({c} - {_FIXED['center'][i]}) / {_FIXED['scale'][i]} END AS {c}"
                           for i, (c, m) in enumerate(zip(_R_COLS, (2654435761, 2246822519, 3266489917))))} FROM x),
it AS (SELECT 0 AS n, g.*, {', '.join(f'coalesce({c}, 0.0) AS z_{c}' for c in _R_COLS)} FROM g
       UNION ALL SELECT n + 1, k, {', '.join(_R_COLS)}, {', '.join(
           f"coalesce({c}, 0.5 * z_{c} + 0.5 * {w} * ({' + '.join(f'{v} * z_{o}' for o, v in zip(_R_COLS, _FIXED['component']))}))"
           for c, w in zip(_R_COLS, _FIXED['component']))} FROM it WHERE n < 25)
SELECT k, {', '.join(f"round(z_{c} * {_FIXED['scale'][i]} + {_FIXED['center'][i]}, 6) AS {c}" for i, c in enumerate(_R_COLS))} FROM it WHERE n = 25
""")
def m11_fixed(spark, sf):
    """Twenty-five blended rounds inside the row, with components that SQL can repeat."""
    li = fx.read_table(spark, sf, "lineitem")
    x = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))
    gaps = {c: F.when(uniform("k", 41 + i, m) >= 0.25, F.col(c)) for i, (c, m) in enumerate(zip(_R_COLS, (2654435761, 2246822519, 3266489917)))}
    imp = impute.ReconstructImputer(_R_COLS, "k", k=1, max_iter=25, blend=0.5)
    imp.scaler = encode.ScalerModel(_R_COLS, dict(zip(_R_COLS, _FIXED["center"])), dict(zip(_R_COLS, _FIXED["scale"])))
    imp.pca = encode.PCAModel(_R_COLS, 1, False, "pc", dict.fromkeys(_R_COLS, 0.0), [_FIXED["component"]], [1.0], [1.0], 1)
    return imp.transform(x.withColumns(gaps)).select("k", *[F.round(c, 6).alias(c) for c in _R_COLS])


# ------------------------------------------------------------------ R25

_MAPS = "".join(f""",
c{i} AS (SELECT n, (SELECT min(a) FROM range(({(0x9E3779B1 * (2 * (5 + i) + 1) + 0x85EBCA6B)} % n), ({(0x9E3779B1 * (2 * (5 + i) + 1) + 0x85EBCA6B)} % n) + 1000) r(a) WHERE gcd(a, n) = 1) AS a,
                {0xC2B2AE35 * (5 + i + 1)} % n AS b FROM (SELECT count(*) AS n FROM p))""" for i in range(2))


@register("r25_permuted_values", f"""
WITH p AS (SELECT o_orderkey, o_totalprice, o_custkey,
                  row_number() OVER (ORDER BY {uniform_sql('o_orderkey', 5)}, o_orderkey) - 1 AS place FROM orders){_MAPS}
SELECT p.o_orderkey, CAST(x.o_totalprice AS DOUBLE) AS price, CAST(y.o_custkey AS DOUBLE) AS customer
FROM p, c0, c1, p x, p y
WHERE x.place = (CAST(c0.a AS HUGEINT) * p.place + c0.b) % c0.n AND y.place = (CAST(c1.a AS HUGEINT) * p.place + c1.b) % c1.n
""")
def r25_values(spark, sf):
    """Two columns dealt anew, row by row: the maps under the permutation importance."""
    o = fx.read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    out = evaluate.permuted_columns(o, ["o_totalprice", "o_custkey"], "o_orderkey", seed=5, arithmetic=True)
    return out.select("o_orderkey", F.col("__permuted_o_totalprice").alias("price"), F.col("__permuted_o_custkey").alias("customer"))


# ------------------------------------------------------------------ E16, T20 with fixed parameters

_CENTRES = [[1.0, 0.01], [10.0, 0.05], [25.0, 0.1], [50.0, 0.0]]


@register("e16_rbf_fixed_centres", f"""
SELECT l_orderkey, l_linenumber, {', '.join(f"round(exp(-0.01 * (power(l_quantity - {a}, 2) + power(l_discount - {b}, 2))), 6) AS rbf{j + 1}" for j, (a, b) in enumerate(_CENTRES))}
FROM lineitem
""")
def e16_fixed(spark, sf):
    li = fx.read_table(spark, sf, "lineitem")
    out = select.rbf_columns(li, ["l_quantity", "l_discount"], _CENTRES, gamma=0.01)
    return out.select("l_orderkey", "l_linenumber", *[F.round(f"rbf{j}", 6).alias(f"rbf{j}") for j in range(1, 5)])


_LAMBDAS = [-1.0, -0.5, 0.0, 0.5, 1.0, 1.5]


@register("t20_box_cox_fitted_lambda", """
WITH x AS (SELECT CAST(o_totalprice AS DOUBLE) + 1 AS a, CAST(o_custkey AS DOUBLE) + 1 AS b FROM orders),
l AS (SELECT unnest([""" + ", ".join(map(str, _LAMBDAS)) + """])::DOUBLE AS lam),
ll AS (""" + " UNION ALL ".join(f"""SELECT '{n}' AS column_name, lam, -count(*) / 2.0 * ln(var_pop(CASE WHEN lam = 0 THEN ln({c}) ELSE (power({c}, lam) - 1) / (CASE WHEN lam = 0 THEN 1 ELSE lam END) END))
       + (lam - 1) * sum(ln({c})) AS v FROM x, l GROUP BY lam""" for n, c in (("o_totalprice", "a"), ("o_custkey", "b"))) + """)
SELECT column_name, arg_max(lam, v) AS lambda FROM ll GROUP BY 1
""")
def t20_fitted(spark, sf):
    """The power of greatest likelihood over a grid, for two columns at once."""
    m = encode.BoxCox(["o_totalprice", "o_custkey"], _LAMBDAS).fit(fx.read_table(spark, sf, "orders"))
    return spark.createDataFrame(sorted(m.lambdas.items()), "column_name string, lambda double")


# ------------------------------------------------------------------ R5, R11, R14: scores row by row

@register("r11_ridge_chain_predictions", f"""
WITH {_ROWS_SQL}, tr AS (SELECT * FROM x WHERE {uniform_sql('k', 9)} >= 0.2),
{solved_sql(FEATURES, sums_sql(FEATURES, 'tr', False), MINMAX, 'alpha', grid([0.5]))}
SELECT k, round(offset_ + {' + '.join(f'b_{c} * {c}' for c in FEATURES)}, 3) AS prediction FROM x, fit WHERE {uniform_sql('k', 9)} < 0.2
""")
def r11_predictions(spark, sf):
    """The named ridge chain fitted on four fifths: every prediction on the rest."""
    train, test = model.train_test_split(order_rows(spark, sf), "k", seed=9, arithmetic=True)
    chain = model.fit_named(train, "ridge", FEATURES)
    return chain.transform(test).select("k", F.round("prediction", 3).alias("prediction"))


@register("r14_every_named_model")
def r14_all(spark, sf):
    """All seven named chains fitted and scored on the same split."""
    from legflow.operators import evaluate as ev
    from legflow.session import written

    x = written(order_rows(spark, sf), "orders")
    train, test = model.train_test_split(x, "k", seed=9)
    out = None
    for name in model.MODEL_NAMES:
        chain = model.fit_named(train, name, FEATURES, key="k")
        m = ev.test_metrics(chain.transform(test)).select(F.lit(name).alias("model"), F.round("mae", 2).alias("mae"), F.round("r2", 1).alias("r2"))
        out = m if out is None else out.unionByName(m)
    return out
