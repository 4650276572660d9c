"""Feature selection and derived feature sets (E12..E16)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legflow.operators.moments import Regression, eliminated, moments, recursive_elimination, total
from legflow.session import ensure_checkpoint_dir


def chi2_scores(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """(feature, chi2) with observed = per-class feature sum and expected =
    class share x feature total.  Features must be non-negative."""
    feats = list(features)
    # one scan: per class its rows and feature sums (a row per class), and the minima
    per = df.groupBy(F.col(label).alias("__c")).agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(F.col(c).cast("double")).alias(f"__s_{c}") for c in feats],
        *[F.min(F.col(c).cast("double")).alias(f"__m_{c}") for c in feats])
    ensure_checkpoint_dir(df.sparkSession)
    per = per.checkpoint()
    all_ = per.agg(F.sum("__n").alias("__n"), *[F.sum(f"__s_{c}").alias(f"__s_{c}") for c in feats],
                   *[F.min(f"__m_{c}").alias(f"__m_{c}") for c in feats]).first()
    if any(all_[f"__m_{c}"] is not None and all_[f"__m_{c}"] < 0 for c in feats):
        raise ValueError("chi-square selection needs non-negative features")
    share = F.col("__n") / F.lit(float(all_["__n"] or 1))
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"__s_{c}").alias("obs"),
                               (share * F.lit(float(all_[f"__s_{c}"] or 0.0))).alias("exp")) for c in feats])
    return per.select(F.inline(cells)).groupBy("feature").agg(
        F.sum(F.try_divide((F.col("obs") - F.col("exp")) ** 2, F.col("exp"))).alias("chi2"))


def select_k_best_chi2(df: DataFrame, features: Sequence[str], k: int, label: str = "label") -> list[str]:
    """The k highest-scoring features, in their original order."""
    scores = {r["feature"]: r["chi2"] for r in chi2_scores(df, features, label).collect()}  # one row per feature
    best = sorted(features, key=lambda f: (-(scores.get(f) or 0.0), list(features).index(f)))[:k]
    return [f for f in features if f in best]


def backward_elimination(df: DataFrame, features: Sequence[str], label: str = "label",
                         level: float = 0.05) -> tuple[list[str], Regression | None]:
    """OLS without intercept; drop the largest p-value while it exceeds ``level``.  One scan: each removal is a
    sweep of the moment matrix.  Columns that are combinations of earlier ones leave first."""
    parts = moments(df, [*features, label])
    fit = eliminated(total([parts[k] for k in sorted(parts)]), features, label, level) if parts else None
    return (fit.features, fit) if fit else ([], None)


def coefficient_table(spark, model: Regression | None, features: Sequence[str], conf: float = 0.95) -> DataFrame:
    """Per feature exp(coef), exp of the confidence bounds, and the two-sided p-value."""
    def exp(v):
        try:
            return math.exp(v)
        except OverflowError:
            return float("inf")
    rows = []
    if model is not None:
        lower, upper = model.bounds(conf)
        rows = [(f, *(exp(float(v)) for v in (b, lo, hi)), float(p))
                for f, b, lo, hi, p in zip(features, model.coefficients, lower, upper, model.p_values)]
    return spark.createDataFrame(rows, "feature string, odds double, lower double, upper double, p_value double")


def recursive_elimination_cv(df: DataFrame, features: Sequence[str], label: str = "label", fold_col: str = "fold",
                             n_folds: int = 5, alpha: float = 5e-4) -> tuple[list[str], list[tuple[int, float]]]:
    """Lasso of penalty ``alpha`` on features standardised by the caller; remove the
    smallest |coefficient| each step, score each feature count by mean squared
    error over the folds, keep the count of least error (the fewer features at ties).  One scan."""
    parts = {f: m for f, m in moments(df, [*features, label], fold_col).items() if 0 <= f < n_folds}
    return recursive_elimination(parts, features, label, alpha)


def rbf_columns(df: DataFrame, features: Sequence[str], centres: Sequence[Sequence[float]], gamma: float = 1.0,
                prefix: str = "rbf") -> DataFrame:
    """exp(-gamma * ||x - c||^2) for each of the given centres."""
    new = {}
    for j, c in enumerate(centres):
        d2 = sum((F.col(f) - F.lit(float(v))) ** 2 for f, v in zip(features, c))
        new[f"{prefix}{j + 1}"] = F.exp(-F.lit(gamma) * d2)
    return df.withColumns(new)


def rbf_features(df: DataFrame, features: Sequence[str], k: int, gamma: float = 1.0, seed: int = 0,
                 prefix: str = "rbf") -> tuple[DataFrame, list[list[float]]]:
    """K-means centres (k-means|| init), then exp(-gamma * ||x - c||^2) per centre."""
    vec = VectorAssembler(inputCols=list(features), outputCol="__x").transform(df.dropna(subset=list(features)))
    centres = [list(map(float, c)) for c in KMeans(k=k, seed=seed, featuresCol="__x").fit(vec).clusterCenters()]
    return rbf_columns(df, features, centres, gamma, prefix), centres
