"""Splitting, model factories, pipelines, stacking, cross-validation and tuning (R1..R18).

Splits and folds are functions of a row key (stable under re-partitioning and
re-reads).  Regressors are MLlib; the penalty of each linear model is mapped
so that MLlib minimises the same objective as the reference's models.
"""

from __future__ import annotations

import itertools
import math
import os
from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legflow.functions.nulls import hash_uniform, uniform
from legflow.operators.boost import EnsembleModel, Growth, StackedModel, boosted, forest
from legflow.operators.encode import Fitted
from legflow.operators.moments import LINEAR, LinearFit, fit_branches, fold_scores, moments, total, without

# ------------------------------------------------------------------ R1..R4: splits and folds


def _u(key: str, seed: int, arithmetic: bool):
    return uniform(key, seed) if arithmetic else hash_uniform(key, seed)


def train_test_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 0,
                     arithmetic: bool = False) -> tuple[DataFrame, DataFrame]:
    """Hash-of-key threshold."""
    u = _u(key, seed, arithmetic)
    return df.where(u >= test_share), df.where(u < test_share)


def train_val_test_split(df: DataFrame, key: str, seed: int = 0, arithmetic: bool = False):
    """R2: 20 % test, then 20 % of the rest as validation (thresholds .2 and .36)."""
    u = _u(key, seed, arithmetic)
    return df.where(u >= 0.36), df.where((u >= 0.2) & (u < 0.36)), df.where(u < 0.2)


def imputed_split(df: DataFrame, complete_keys: DataFrame, key: str, test_share: float = 0.3, seed: int = 1,
                  arithmetic: bool = False):
    """Test rows only from originally complete rows, ceil(test_share x all rows)
    of them (lowest hash first); the rest splits 80/20 into train / validation."""
    from legflow.operators.quantiles import value_ranks

    n_test = math.ceil(df.count() * test_share)
    ranked = complete_keys.select(key).distinct().withColumn("__u", _u(key, seed, arithmetic))
    # The n_test smallest (u, key) without a global sort into one task: the
    # distributed rank of u gives the cut value; only keys that tie on it
    # (hash collisions, a handful) are ordered by key.
    ranks = value_ranks(ranked.withColumn("__g", F.lit(0)), "__g", "__u")
    cut = ranks.where((F.col("below") < n_test) & (F.col("below") + F.col("cnt") >= n_test)).first()
    if cut is None:
        test_keys = ranked.select(key)
    else:
        need = n_test - cut["below"]
        tied = ranked.where(F.col("__u") == cut["__u"]).orderBy(key).limit(int(need)).select(key)
        test_keys = ranked.where(F.col("__u") < cut["__u"]).select(key).unionByName(tied)
    test = df.join(test_keys, key, "left_semi")
    rest = df.join(test_keys, key, "left_anti")
    u2 = _u(key, seed + 1, arithmetic)
    return rest.where(u2 >= 0.2), rest.where(u2 < 0.2), test


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 101, buckets: int | None = None,
                     arithmetic: bool = False, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """``fold`` column; within each label, rows in hash order are dealt to folds
    round-robin.  Each label is split into hash buckets (enough that the largest
    label has about ``rows_per_bucket`` rows per bucket) whose offsets come from
    per-bucket counts, so no task orders a whole label."""
    if buckets is None:
        largest = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        buckets = max(64, -(-largest // rows_per_bucket))
    u = _u(key, seed, arithmetic)
    x = df.withColumn("__u", u).withColumn("__b", F.floor(F.col("__u") * buckets).cast("int"))
    sizes = x.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__n"))
    w_off = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.withColumn("__off", F.coalesce(F.sum("__n").over(w_off), F.lit(0))).drop("__n")
    w = Window.partitionBy(label, "__b").orderBy("__u", key)
    offs = offs.select(F.col(label).alias("__label"), F.col("__b").alias("__bucket"), "__off")
    # null-safe: rows without a label form a stratum of their own
    x = x.join(offs, x[label].eqNullSafe(offs["__label"]) & (x["__b"] == offs["__bucket"])).withColumn("__r", F.row_number().over(w) + F.col("__off") - 1)
    return x.withColumn("fold", (F.col("__r") % k).cast("int")).drop("__u", "__b", "__off", "__r", "__label", "__bucket")


# ------------------------------------------------------------------ R5..R10: regressors

def label_stats(df: DataFrame, label: str = "label") -> tuple[int, float, float]:
    r = df.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("sp"), F.stddev_samp(label).alias("ss")).first()
    return r["n"], r["sp"] or 1.0, r["ss"] or 1.0


def ridge(df: DataFrame, alpha: float = 0.5, label: str = "label", features: str = "features") -> LinearRegression:
    """Minimise ||y - Xb||^2 + alpha ||b||^2 (sum form): regParam = alpha / n x sd."""
    n, sd, _ = label_stats(df, label)
    return LinearRegression(featuresCol=features, labelCol=label, elasticNetParam=0.0, regParam=alpha / n * sd,
                            standardization=False, solver="normal")


def lasso(df: DataFrame, alpha: float = 1e-6, label: str = "label", features: str = "features") -> LinearRegression:
    """(1 / 2n) ||y - Xb||^2 + alpha |b|_1."""
    return LinearRegression(featuresCol=features, labelCol=label, elasticNetParam=1.0, regParam=alpha,
                            standardization=False, maxIter=1000, tol=1e-10)


def elastic_net(df: DataFrame, alpha: float = 1e-4, l1_ratio: float = 0.9, label: str = "label",
                features: str = "features") -> LinearRegression:
    """(1 / 2n) ||r||^2 + alpha r |b|_1 + alpha (1 - r) / 2 ||b||^2, mapped through the
    label deviation MLlib divides by (sample deviation for l-bfgs)."""
    _, _, sd = label_stats(df, label)
    reg = alpha * l1_ratio + alpha * (1 - l1_ratio) * sd
    return LinearRegression(featuresCol=features, labelCol=label, regParam=reg,
                            elasticNetParam=(alpha * l1_ratio) / reg, standardization=False, maxIter=1000, tol=1e-10)


def boosted_trees(df: DataFrame, features: Sequence[str], rounds: int = 500, label: str = "label", seed: int = 0, rate: float = 0.05,
                  subset: str = "sqrt", key: str | None = None, folder: str | None = None) -> EnsembleModel:
    """500 x depth 4, rate 0.05, sqrt features per split, from the label's mean."""
    if subset not in ("all", "sqrt"):
        raise ValueError(f"unknown feature subset {subset!r}")
    drawn = max(1, int(math.sqrt(len(features)))) if subset == "sqrt" else None
    return boosted(df, features, label, rounds, rate, Growth(node_columns=drawn, seed=seed), None, key, folder)


def regularised_boosted_trees(df: DataFrame, features: Sequence[str], rounds: int = 500, label: str = "label", seed: int = 0,
                              rate: float = 0.1, reg_alpha: float = 1e-3, reg_lambda: float = 0.1, row_share: float = 0.8,
                              tree_columns: float = 0.7, key: str | None = None, folder: str | None = None) -> EnsembleModel:
    """500 rounds, rate 0.1, depth 4, row sample 0.8, 0.7 of the columns drawn for each tree, leaf weights with
    L1 0.001 and L2 0.1, from one half."""
    growth = Growth(l1=reg_alpha, l2=reg_lambda, row_share=row_share, tree_columns=tree_columns, seed=seed)
    return boosted(df, features, label, rounds, rate, growth, 0.5, key, folder)


def random_forest(df: DataFrame, features: Sequence[str], trees: int = 500, label: str = "label", seed: int = 0,
                  key: str | None = None) -> EnsembleModel:
    """500 trees of depth 4 on bootstrap samples, every feature considered at each split."""
    return forest(df, features, label, trees, 4, seed, key)


# ------------------------------------------------------------------ R11, R14: pipelines by name

def _factories(params: dict | None = None) -> dict[str, Callable[[DataFrame], object]]:
    """MLlib estimators of the linear models."""
    p = {k: v for k, v in (params or {}).items() if k in ("alpha", "l1_ratio")}
    return {"ridge": lambda d: ridge(d, **p), "lasso": lambda d: lasso(d, **p), "elastic": lambda d: elastic_net(d, **p)}


def _trees(name: str, df: DataFrame, cols: Sequence[str], rounds: int, params: dict | None, label: str, key: str | None,
           folder: str | None) -> EnsembleModel:
    g = {k: v for k, v in (params or {}).items() if k in ("rate", "subset")}
    if name == "gb":
        return boosted_trees(df, cols, rounds, label, key=key, folder=folder, **g)
    if name == "xgb":
        return regularised_boosted_trees(df, cols, rounds, label, key=key, folder=folder, **{k: v for k, v in g.items() if k == "rate"})
    return random_forest(df, cols, rounds, label, key=key)


MODEL_NAMES = ["ridge", "lasso", "elastic", "gb", "xgb", "rf", "stacking"]


# Scaler, reducer and own parameters of each named model.
MODEL_CHAINS = {
    "ridge": dict(scaler="minmax", chi2_k=32, alpha=0.5),
    "lasso": dict(scaler="robust", pca_k=29, alpha=1e-6),
    "elastic": dict(scaler="robust", pca_k=29, alpha=1e-4, l1_ratio=0.9),
    "gb": dict(scaler="robust", pca_k=31, whiten=True),
    "xgb": dict(scaler="robust", pca_k=28, whiten=True),
    "rf": dict(scaler="robust", pca_k=27),
    "stacking": dict(scaler="robust", pca_k=22),
}


def chain_of(name: str, n_features: int) -> dict:
    """The named model's chain; reducers keep at most the features there are."""
    if name not in MODEL_CHAINS:
        raise ValueError(f"unknown model {name!r}; expected one of {MODEL_NAMES}")
    return {k: min(v, n_features) if k in ("pca_k", "chi2_k") else v for k, v in MODEL_CHAINS[name].items()}


def fit_named(train: DataFrame, name: str, features: Sequence[str], categorical: Sequence[str] = (),
              label: str = "label", rounds: int = 500, key: str | None = None, folder: str | None = None) -> FittedChain:
    """The named model with its own chain and parameters."""
    p = chain_of(name, len(features) + len(categorical))
    return fit_chain(train, name, features, categorical, label, scaler=p.get("scaler"), pca_k=p.get("pca_k"),
                     whiten=p.get("whiten", False), chi2_k=p.get("chi2_k"), rounds=rounds, params=p, key=key, folder=folder)


class FittedChain:
    """Encoder (leave-one-out, fitted with leave-one-out values on the
    training rows), column scaler, optional PCA, then an MLlib regressor."""

    def __init__(self, encoder, scaler, pca, assembler_cols, model: PipelineModel, label: str):
        self.encoder, self.scaler, self.pca = encoder, scaler, pca
        self.assembler_cols, self.model, self.label = assembler_cols, model, label

    def features(self, df: DataFrame) -> DataFrame:
        x = self.encoder.transform(df) if self.encoder else df
        x = self.scaler.transform(x) if self.scaler else x
        return self.pca.transform(x) if self.pca else x

    def transform(self, df: DataFrame) -> DataFrame:
        """Batch scoring."""
        return self.model.transform(self.features(df))

    def save(self, path: str) -> None:
        """Regressor as an MLlib PipelineModel; fitted statistics as parquet."""
        import json

        parts = {"encoder": self.encoder, "scaler": self.scaler, "pca": self.pca}
        if isinstance(self.model, Fitted):
            self.model.save(os.path.join(path, "model"))
        else:
            self.model.write().overwrite().save(os.path.join(path, "model"))
        for name, part in parts.items():
            if part is not None:
                part.save(os.path.join(path, name))
        manifest = {"parts": [n for n, p in parts.items() if p is not None], "columns": list(self.assembler_cols),
                    "label": self.label, "model": getattr(self.model, "kind", "pipeline")}
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1) \
            .write.mode("overwrite").parquet(os.path.join(path, "manifest"))


def fit_chain(train: DataFrame, name: str, features: Sequence[str], categorical: Sequence[str] = (),
              label: str = "label", scaler: str | None = "standard", pca_k: int | None = None,
              rounds: int = 500, params: dict | None = None, whiten: bool = False, chi2_k: int | None = None,
              key: str | None = None, folder: str | None = None) -> FittedChain:
    """Fit a model chain: leave-one-out codes, scaler, PCA (optionally
    whitened) or the chi-square best columns, model; unknown names raise.
    ``key`` names the row key that stacking deals its folds by and trees draw their rows by; a boosted
    model saves its progress to ``folder`` and resumes there."""
    from legflow.operators.encode import CenteredPCA, LeaveOneOutEncoder, MinMaxScaler, RobustScaler, StandardScaler

    factories = _factories(params)
    if name not in MODEL_NAMES:
        raise ValueError(f"unknown model {name!r}; expected one of {MODEL_NAMES}")
    enc = None
    x = train
    if categorical:
        enc, x = LeaveOneOutEncoder(categorical, label).fit_transform(train)
    cols = list(features) + list(categorical)
    sc = None
    if scaler:
        sc = {"standard": StandardScaler, "minmax": MinMaxScaler, "robust": RobustScaler}[scaler](cols).fit(x)
        x = sc.transform(x)
    pca = None
    if pca_k:
        pca = CenteredPCA(cols, pca_k, whiten=whiten).fit(x)
        x = pca.transform(x)
        cols = [f"pc{j + 1}" for j in range(pca_k)]
    elif chi2_k:
        from legflow.operators.select import select_k_best_chi2

        cols = select_k_best_chi2(x, cols, chi2_k, label)
    if name == "stacking":
        model = StackingRegressor(rounds=rounds, label=label, key=key).fit(x, cols, folder)
    elif name in factories:
        assembler = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")
        model = Pipeline(stages=[assembler, factories[name](x)]).fit(x)
    else:
        model = _trees(name, x, cols, rounds, params, label, key, folder)
    return FittedChain(enc, sc, pca, cols, model, label)


# ------------------------------------------------------------------ R12: stacking

class StackingRegressor:
    """Out-of-fold predictions of ridge, lasso and elastic net (5 folds) feed
    a boosted-tree meta model; the bases are refitted on all rows.  Folds are a
    hash of ``key``; without one, of all the row's columns, so they never
    depend on partitioning."""

    def __init__(self, rounds: int = 500, label: str = "label", folds: int = 5, key: str | None = None):
        self.rounds, self.label, self.folds, self.key = rounds, label, folds, key

    def fit(self, df: DataFrame, cols: Sequence[str], folder: str | None = None) -> StackedModel:
        from legflow.session import written

        by = [self.key] if self.key else [*cols, self.label]
        x = df.withColumn("__fold", F.pmod(F.xxhash64(*by), F.lit(self.folds))).withColumn("__row", F.xxhash64(*by))
        x = written(x.select(*cols, self.label, "__fold", "__row"), "stacked")
        bases = {"ridge": dict(alpha=0.5), "lasso": dict(alpha=1e-6), "elastic": dict(alpha=1e-4, l1_ratio=0.9)}
        # one scan: a fold's bases come from the total's moments without its own
        parts = moments(x, [*cols, self.label], "__fold")

        def fitted(m) -> list[LinearFit]:
            return [fit_branches(m, n, cols, self.label, [p])[0] for n, p in bases.items()]

        fits = {k: fitted(without(parts, k)) for k in sorted(parts)} if len(parts) > 1 else {k: fitted(parts[k]) for k in parts}
        # a held-out row takes its fold's coefficients: no joins and no unions
        oof = x
        for i, n in enumerate(bases):
            pred = F.lit(None).cast("double")
            for k, fs in fits.items():
                here = sum([F.col(c).cast("double") * F.lit(float(w)) for c, w in zip(cols, fs[i].coefficients)], F.lit(float(fs[i].intercept)))
                pred = F.when(F.col("__fold") == k, here).otherwise(pred)
            oof = oof.withColumn(f"p_{n}", pred)
        meta = boosted_trees(oof, [f"p_{n}" for n in bases], self.rounds, self.label, key="__row", folder=folder)
        full = fitted(total([parts[k] for k in sorted(parts)])) if parts else []
        return StackedModel({n: (list(cols), [float(w) for w in f.coefficients], f.intercept) for n, f in zip(bases, full)}, meta)


# ------------------------------------------------------------------ R13, R15..R17: CV and tuning

def regression_scores(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> dict:
    r = pred.agg(F.avg((F.col(label) - F.col(prediction)) ** 2).alias("mse"),
                 F.avg(F.abs(F.col(label) - F.col(prediction))).alias("mae"),
                 F.var_pop(label).alias("v")).first()
    return {"mse": r["mse"], "mae": r["mae"], "r2": 1 - r["mse"] / r["v"] if r["v"] else None}


def cross_validate(df: DataFrame, fit: Callable[[DataFrame], object], fold_col: str = "fold", k: int = 5,
                   label: str = "label") -> DataFrame:
    """Per fold MSE, MAE, R2, plus mean and population deviation rows."""
    spark = df.sparkSession
    rows = []
    for i in range(k):
        model = fit(df.where(F.col(fold_col) != i))
        s = regression_scores(model.transform(df.where(F.col(fold_col) == i)), label)
        rows.append((str(i), s["mse"], s["mae"], s["r2"]))
    folds = spark.createDataFrame(rows, "fold string, mse double, mae double, r2 double")
    summ = folds.agg(*[F.avg(m).alias(m) for m in ("mse", "mae", "r2")]).withColumn("fold", F.lit("mean"))
    dev = folds.agg(*[F.stddev_pop(m).alias(m) for m in ("mse", "mae", "r2")]).withColumn("fold", F.lit("std"))
    return folds.unionByName(summ).unionByName(dev)


def grid_search(df: DataFrame, make: Callable[[dict], Callable[[DataFrame], object]], grid: dict[str, list],
                fold_col: str = "fold", k: int = 5, label: str = "label") -> DataFrame:
    """Every grid point cross-validated on the fold column; per point the
    mean and population deviation of MSE, MAE and R2."""
    spark = df.sparkSession
    names = list(grid)
    rows = []
    for idx, values in enumerate(itertools.product(*[grid[n] for n in names])):
        params = dict(zip(names, values))
        cv = cross_validate(df, make(params), fold_col, k, label).collect()  # k + 2 rows
        folds = [r for r in cv if r["fold"] not in ("mean", "std")]
        mean = next(r for r in cv if r["fold"] == "mean")
        std = next(r for r in cv if r["fold"] == "std")
        rows.append((idx, str(params), mean["mse"], std["mse"], mean["mae"], std["mae"], mean["r2"], std["r2"],
                     len(folds)))
    return spark.createDataFrame(rows, "idx int, params string, mse double, mse_std double, mae double, "
                                       "mae_std double, r2 double, r2_std double, n_folds int")


def refit_best(df: DataFrame, make: Callable[[dict], Callable[[DataFrame], object]], grid: dict[str, list],
               results: DataFrame):
    """(parameters, model) of the grid point of least mean MSE, fitted on all rows."""
    idx = results.orderBy("mse", "idx").first()["idx"]
    params = dict(zip(grid, list(itertools.product(*grid.values()))[idx]))
    return params, make(params)(df)


def tuning_report(results: DataFrame) -> DataFrame:
    """Per metric the best index, best score, its deviation, the mean score;
    RMSE = sqrt(MSE), R2 in percent."""
    parts = []
    for metric, better in (("mse", "min"), ("mae", "min"), ("r2", "max")):
        order = F.col(metric).asc() if better == "min" else F.col(metric).desc()
        best = results.orderBy(order, "idx").limit(1).select(
            F.lit(metric).alias("metric"), F.col("idx").alias("best_idx"), F.col(metric).alias("best"),
            F.col(f"{metric}_std").alias("best_std"))
        mean = results.agg(F.avg(metric).alias("mean_score"))
        parts.append(best.withColumn("mean_score", F.lit(mean.first()[0])))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    rmse = out.where(F.col("metric") == "mse").select(F.lit("rmse").alias("metric"), "best_idx",
                                                      F.sqrt("best").alias("best"), "best_std",
                                                      F.sqrt("mean_score").alias("mean_score"))
    out = out.withColumns({"best": F.when(F.col("metric") == "r2", F.col("best") * 100).otherwise(F.col("best")),
                           "mean_score": F.when(F.col("metric") == "r2", F.col("mean_score") * 100)
                           .otherwise(F.col("mean_score"))})
    return out.unionByName(rmse)


# The parameter grids of each model's branches.
GRIDS = {
    "ridge": dict(pca=dict(alpha=[0.01, 0.05, 0.1, 0.5, 1.0]), chi2=dict(alpha=[0.2, 0.5, 1.0])),
    "lasso": dict(pca=dict(alpha=[1e-6, 5e-6, 1e-5, 5e-5, 1e-4, 5e-4]), chi2=dict(alpha=[1e-6, 5e-6, 1e-5, 5e-5, 1e-4, 5e-4])),
    "elastic": dict(pca=dict(alpha=[1e-6, 1e-5, 1e-4], l1_ratio=[0.8, 0.9, 0.99]),
                    chi2=dict(alpha=[1e-6, 1e-5, 1e-4], l1_ratio=[0.8, 0.9, 0.99])),
    "xgb": dict(pca=dict(rounds=[500], rate=[0.1])),
    "gb": dict(pca=dict(rounds=[500], rate=[0.01, 0.05], subset=["all", "sqrt"])),
    "rf": dict(pca=dict(rounds=[500])),
}


def model_grid(name: str, n_features: int) -> list[dict]:
    """The branches of a model: scalers x reducer sizes (n-5 .. n) x whitening x the
    model's own parameters for PCA, and min-max with the chi-square best columns
    for the linear models.  Trees use the robust scaler and leave out the largest size."""
    if name not in GRIDS:
        raise ValueError(f"unknown model {name!r}")
    sizes = list(range(max(1, n_features - 5), n_features + 1))
    linear = "chi2" in GRIDS[name]

    def points(grid: dict) -> list[dict]:
        return [dict(zip(grid, v)) for v in itertools.product(*grid.values())]

    out = [dict(scaler=s, pca_k=k, whiten=w, **p) for s in (("standard", "robust") if linear else ("robust",))
           for k in (sizes if linear else sizes[:-1] or sizes) for w in (True, False) for p in points(GRIDS[name]["pca"])]
    if linear:
        out += [dict(scaler="minmax", chi2_k=k, **p) for k in sizes for p in points(GRIDS[name]["chi2"])]
    return out


def _mean_dev(values: Sequence[float | None]) -> tuple[float | None, float | None]:
    known = [v for v in values if v is not None]
    if not known:
        return None, None
    mean = sum(known) / len(known)
    return mean, math.sqrt(sum((v - mean) ** 2 for v in known) / len(known))


def _score_table(spark: SparkSession, scores: list[dict], branches: Sequence[dict]) -> DataFrame:
    """The table of ``grid_search`` from fold scores."""
    rows = []
    for i, b in enumerate(branches):
        mine = [s for s in scores if s["idx"] == i]
        rows.append((i, str(b), *(v for m in ("mse", "mae", "r2") for v in _mean_dev([s[m] for s in mine])), len(mine)))
    return spark.createDataFrame(rows, "idx int, params string, mse double, mse_std double, mae double, "
                                       "mae_std double, r2 double, r2_std double, n_folds int")


def cross_validate_linear(df: DataFrame, name: str, features: Sequence[str], branch: dict | None = None, label: str = "label",
                          fold_col: str = "fold", k: int = 5) -> DataFrame:
    """R13 for ridge, lasso and elastic chains, from moment matrices: two scans for all folds.  ``branch`` is a scaler,
    reducer and penalty; without it, the named model's own chain."""
    branch = chain_of(name, len(features)) if branch is None else branch
    scores, _ = fold_scores(df, name, features, [branch], label, fold_col, k)
    rows = [(str(s["fold"]), s["mse"], s["mae"], s["r2"]) for s in scores]
    both = [_mean_dev([s[m] for s in scores]) for m in ("mse", "mae", "r2")]
    rows += [("mean", *(m for m, _ in both)), ("std", *(d for _, d in both))]
    return df.sparkSession.createDataFrame(rows, "fold string, mse double, mae double, r2 double")


def grid_search_linear(df: DataFrame, name: str, features: Sequence[str], branches: Sequence[dict], label: str = "label",
                       fold_col: str = "fold", k: int = 5) -> tuple[DataFrame, list[LinearFit]]:
    """R15, R16 for linear models: the table of ``grid_search`` for every branch, and every branch refitted on all rows.
    The number of scans does not depend on that of branches or folds."""
    scores, fits = fold_scores(df, name, features, branches, label, fold_col, k)
    return _score_table(df.sparkSession, scores, branches), fits


def best_fit(results: DataFrame, fits: Sequence[LinearFit]) -> LinearFit:
    """The refitted branch of least mean MSE."""
    return fits[results.orderBy("mse", "idx").first()["idx"]]


def tune_chain(df: DataFrame, name: str, features: Sequence[str], branches: Sequence[dict], label: str = "label",
               fold_col: str = "fold", k: int = 5, categorical: Sequence[str] = ()) -> DataFrame:
    """Cross-validate each branch of a named chain (R15 contract per branch).  Linear models of numeric columns are
    tuned from moment matrices; trees, and chains with encoders, fit each branch and fold."""
    spark = df.sparkSession
    if name in LINEAR and not categorical:
        res, _ = grid_search_linear(df, name, features, branches, label, fold_col, k)
        return res.select("idx", F.col("params").alias("branch"), "mse", "r2")
    rows = []
    for idx, b in enumerate(branches):
        scores = []
        for i in range(k):
            tr, te = df.where(F.col(fold_col) != i), df.where(F.col(fold_col) == i)
            chain = fit_chain(tr, name, features, categorical, label, scaler=b.get("scaler"), pca_k=b.get("pca_k"),
                              whiten=b.get("whiten", False), chi2_k=b.get("chi2_k"), rounds=b.get("rounds", 500), params=b)
            scores.append(regression_scores(chain.transform(te), label))
        mse = [s["mse"] for s in scores]
        r2 = [s["r2"] for s in scores]
        rows.append((idx, str(b), sum(mse) / k, sum(r2) / k))
    return spark.createDataFrame(rows, "idx int, branch string, mse double, r2 double")
