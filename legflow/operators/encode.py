"""Encoders, scalers and reduction (E1..E11, T20).

Every estimator follows one contract: ``fit(df) -> model``; ``model.transform(df)``
returns ``df`` with the listed columns replaced.  Fitted state is small
(one number or one row per column and level) and is applied either as
literals (bounded by the number of columns) or through a broadcast join of
the level table, whose size is checked first.  ``save`` / ``load`` write the
fitted state as parquet so a fitted chain can be restored (S7).
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Sequence

from pyspark.ml.feature import PCA as _PCA
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legflow.operators.enrich import BROADCAST_MAX_BYTES
from legflow.operators.quantiles import bracketed_quantiles
from legflow.session import ensure_checkpoint_dir


class Fitted:
    """Base for fitted models: state is a dict of plain values (JSON) plus optional tables."""

    kind = "fitted"

    def state(self) -> dict:
        raise NotImplementedError

    def tables(self) -> dict[str, DataFrame]:
        return {}

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(self.kind, json.dumps(self.state()))], "kind string, state string") \
            .coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "state"))
        for name, t in self.tables().items():
            t.write.mode("overwrite").parquet(os.path.join(path, name))


class LevelTable(Fitted):
    """A fitted model with ``levels``: rows (__column, __level, ...)."""

    levels: DataFrame

    def broadcast_levels(self, table: DataFrame, c: str) -> DataFrame:
        """``table``, the part of column ``c``, broadcast where its levels are few.

        They are counted, once for a model: the optimizer's estimate follows the rows that a written table was fitted on,
        and a join that is not broadcast would send all rows of a frequent level to one task.
        """
        if getattr(self, "_sized", None) is not self.levels:
            self._bytes = {r["__column"]: r["b"] for r in self.levels.groupBy("__column").agg(
                F.sum(F.coalesce(F.octet_length("__level"), F.lit(0)) + 64).alias("b")).collect()}  # a row for each column
            self._sized = self.levels
        return F.broadcast(table) if self._bytes.get(c, 0) <= BROADCAST_MAX_BYTES else table


# ------------------------------------------------------------------ E1, E2: target encoders

class LeaveOneOutEncoder:
    """Training rows get (level sum - own label) / (level count - 1); scoring
    rows get the level mean; unseen levels, NULL, and levels seen once in
    training get the global mean.  ``transform`` never reads a label."""

    def __init__(self, cols: Sequence[str], label: str = "label", suffix: str = ""):
        self.cols, self.label, self.suffix = list(cols), label, suffix

    def _levels(self, df: DataFrame) -> DataFrame:
        long = df.select(F.col(self.label).cast("double").alias("__y"),
                         *[F.col(c).cast("string").alias(c) for c in self.cols]).unpivot(
            "__y", self.cols, "__column", "__level")
        return long.groupBy("__column", "__level").agg(F.sum("__y").alias("__sum"), F.count("__y").alias("__n"))

    def fit(self, df: DataFrame) -> LeaveOneOutModel:
        # one scan of the training rows; the level table is written, so a fitted model does not follow its source
        ensure_checkpoint_dir(df.sparkSession)
        prior = df.agg(F.avg(F.col(self.label).cast("double"))).first()[0]
        return LeaveOneOutModel(self.cols, self.label, self.suffix, prior, self._levels(df).checkpoint())

    def fit_transform(self, df: DataFrame) -> tuple[LeaveOneOutModel, DataFrame]:
        model = self.fit(df)
        return model, model.transform(df, training=True)


class LeaveOneOutModel(LevelTable):
    kind = "leave_one_out"

    def __init__(self, cols, label, suffix, prior, levels: DataFrame, min_count: int = 2):
        self.cols, self.label, self.suffix, self.prior, self.levels = cols, label, suffix, prior, levels
        self.min_count = min_count

    def state(self):
        return {"cols": self.cols, "label": self.label, "suffix": self.suffix, "prior": self.prior,
                "min_count": self.min_count}

    def tables(self):
        return {"levels": self.levels}

    def transform(self, df: DataFrame, training: bool = False) -> DataFrame:
        out = df
        for c in self.cols:
            lv = self.levels.where(F.col("__column") == c).select(
                F.col("__level").alias(f"__lv_{c}"), F.col("__sum").alias(f"__s_{c}"), F.col("__n").alias(f"__n_{c}"))
            out = out.join(self.broadcast_levels(lv, c), out[c].cast("string") == lv[f"__lv_{c}"], "left")
            s, n = F.col(f"__s_{c}"), F.col(f"__n_{c}")
            if training:
                y = F.col(self.label).cast("double")
                enc = F.when(n > 1, (s - y) / (n - 1))
            else:
                enc = F.when(n >= self.min_count, s / n)
            out = out.withColumn(c + self.suffix, F.coalesce(enc, F.lit(self.prior))).drop(
                f"__lv_{c}", f"__s_{c}", f"__n_{c}")
        return out


class TargetMeanEncoder:
    """Level mean blended toward the prior by a sigmoid of the level count,
    weight 1 / (1 + exp(-(n - min_samples_leaf) / smoothing)); a level seen
    once gets the prior.  ``smoothing = 0`` gives the plain level mean."""

    def __init__(self, cols: Sequence[str], label: str = "label", smoothing: float = 1.0, min_samples_leaf: int = 1):
        self.cols, self.label, self.smoothing, self.min_samples_leaf = list(cols), label, smoothing, min_samples_leaf

    def fit(self, df: DataFrame) -> LeaveOneOutModel:
        inner = LeaveOneOutEncoder(self.cols, self.label).fit(df)
        n, mean = F.col("__n"), F.col("__sum") / F.col("__n")
        if self.smoothing > 0:
            w = 1 / (1 + F.exp(-(n - self.min_samples_leaf) / F.lit(float(self.smoothing))))
            mean = F.when(n > 1, F.lit(inner.prior) * (1 - w) + mean * w).otherwise(F.lit(inner.prior))
        # the model scores sum / count: store the blended value with a count of one
        inner.levels = inner.levels.where(n > 0).select("__column", "__level", mean.alias("__sum"),
                                                        F.lit(1).cast("bigint").alias("__n"))
        inner.min_count = 1
        return inner


# ------------------------------------------------------------------ E3..E6: categorical codes

class OrdinalEncoder:
    """Level -> 1..n by sorted level (stable across reruns); NULL and unseen
    -> NULL (the reference's -1 marker turned into a missing value)."""

    def __init__(self, cols: Sequence[str]):
        self.cols = list(cols)

    def fit(self, df: DataFrame) -> OrdinalModel:
        from legflow.operators.quantiles import value_ranks

        long = df.select(*[F.col(c).cast("string").alias(c) for c in self.cols]).unpivot(
            [], self.cols, "__column", "__level").where(F.col("__level").isNotNull()).distinct()
        # dense rank of the level within its column = number of smaller levels + 1,
        # computed without sending a column's levels to one task
        ranks = value_ranks(long, "__column", "__level")
        # written once, so transforms do not rank the training rows again
        return OrdinalModel(self.cols, ranks.select("__column", "__level", (F.col("below") + 1).alias("__code")).checkpoint())


class OrdinalModel(LevelTable):
    kind = "ordinal"

    def __init__(self, cols, levels: DataFrame):
        self.cols, self.levels = cols, levels

    def state(self):
        return {"cols": self.cols}

    def tables(self):
        return {"levels": self.levels}

    def _table(self, c):
        return self.broadcast_levels(self.levels.where(F.col("__column") == c).select(
            F.col("__level").alias(f"__l_{c}"), F.col("__code").alias(f"__c_{c}")), c)

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.cols:
            t = self._table(c)
            out = out.join(t, out[c].cast("string") == t[f"__l_{c}"], "left") \
                .withColumn(c, F.col(f"__c_{c}").cast("double")).drop(f"__l_{c}", f"__c_{c}")
        return out

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """Round half to even, clamp into 1..n, map back to the level."""
        out = df
        for c in self.cols:
            t = self._table(c)
            n = self.levels.where(F.col("__column") == c).count()
            code = F.least(F.greatest(F.bround(F.col(c), 0), F.lit(1.0)), F.lit(float(n))).cast("int")
            out = out.withColumn(c, code).join(t, F.col(c) == t[f"__c_{c}"], "left") \
                .withColumn(c, F.col(f"__l_{c}")).drop(f"__l_{c}", f"__c_{c}")
        return out


def one_hot_name(col: str, level: str) -> str:
    return f"{col}_{level}"


class OneHotEncoder:
    """Indicator per fitted level; a NULL value gives NULL in every indicator
    of that attribute (so imputers see the whole attribute as missing).
    The level list becomes columns, so its size is checked (``max_levels``)."""

    def __init__(self, cols: Sequence[str], max_levels: int = 10_000):
        self.cols, self.max_levels = list(cols), max_levels

    def fit(self, df: DataFrame) -> OneHotModel:
        long = df.select(*[F.col(c).cast("string").alias(c) for c in self.cols]).unpivot(
            [], self.cols, "c", "v").where(F.col("v").isNotNull()).distinct()
        rows = long.orderBy("c", "v").limit(self.max_levels + 1).collect()
        if len(rows) > self.max_levels:
            raise ValueError(f"more than {self.max_levels} levels: one-hot columns would not fit a schema; "
                             "use one_hot_vector, which has no bound")
        levels: dict[str, list[str]] = {c: [] for c in self.cols}
        for r in rows:
            levels[r["c"]].append(r["v"])
        return OneHotModel(levels)


def one_hot_vector(df: DataFrame, cols: Sequence[str], suffix: str = "_vec") -> DataFrame:
    """E4 for any number of levels: a sparse indicator vector per column instead of a
    column per level; NULL and levels unseen in ``df`` give a NULL vector.  Encoded in the JVM."""
    from pyspark.ml.feature import OneHotEncoder as IndexEncoder
    from pyspark.ml.linalg import VectorUDT

    codes = OrdinalEncoder(cols).fit(df)
    sizes = {r["__column"]: int(r["n"]) for r in codes.levels.groupBy("__column").agg(F.max("__code").alias("n")).collect()}
    out = codes.transform(df.withColumns({f"__raw_{c}": F.col(c) for c in cols}))
    for c in cols:
        if not sizes.get(c):
            out = out.withColumn(c + suffix, F.lit(None).cast(VectorUDT()))
        else:
            # its size is that of the largest code; with "keep" the dropped last place is that of invalid codes, of which there are none
            encoder = IndexEncoder(inputCol="__code", outputCol="__vec", dropLast=True, handleInvalid="keep").fit(
                df.sparkSession.createDataFrame([(float(sizes[c] - 1),)], "__code double"))
            out = encoder.transform(out.withColumn("__code", F.coalesce(F.col(c) - 1, F.lit(0.0)))).withColumn(
                c + suffix, F.when(F.col(c).isNotNull(), F.col("__vec"))).drop("__code", "__vec")
        out = out.withColumn(c, F.col(f"__raw_{c}")).drop(f"__raw_{c}")
    return out


class OneHotModel(Fitted):
    kind = "one_hot"

    def __init__(self, levels: dict[str, list[str]]):
        self.levels = levels

    def state(self):
        return {"levels": self.levels}

    def output_columns(self) -> list[str]:
        return [one_hot_name(c, v) for c, vs in self.levels.items() for v in vs]

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c, vs in self.levels.items():
            x = F.col(c).cast("string")
            for v in vs:
                new[one_hot_name(c, v)] = F.when(x.isNull(), F.lit(None).cast("double")).otherwise(
                    (x == F.lit(v)).cast("double"))
        return df.withColumns(new).drop(*self.levels)

    def most_likely(self, df: DataFrame) -> DataFrame:
        """E5: per attribute, 1.0 at the first maximum indicator, 0.0 elsewhere."""
        new = {}
        for c, vs in self.levels.items():
            arr = F.array(*[F.col(one_hot_name(c, v)) for v in vs])
            pos = F.array_position(arr, F.array_max(arr))
            for i, v in enumerate(vs):
                new[one_hot_name(c, v)] = F.when(pos.isNull(), F.lit(None).cast("double")).when(
                    pos == i + 1, 1.0).otherwise(0.0)
        return df.withColumns(new)

    def decode(self, df: DataFrame) -> DataFrame:
        """Indicator columns -> one categorical column (first maximum)."""
        out = df
        for c, vs in self.levels.items():
            cols = [one_hot_name(c, v) for v in vs]
            arr = F.array(*[F.col(x) for x in cols])
            pos = F.array_position(arr, F.array_max(arr))
            pick = F.element_at(F.array(*[F.lit(v) for v in vs]), pos.cast("int"))
            out = out.withColumn(c, F.when(pos.isNotNull() & (pos > 0), pick)).drop(*cols)
        return out


# ------------------------------------------------------------------ E7..E9: scalers

class _ColumnScaler:
    """Shared contract: ``center`` and ``scale`` per column, NULL preserved,
    zero scale treated as 1, fitted on complete rows by default."""

    def __init__(self, cols: Sequence[str], complete_rows_only: bool = True):
        self.cols, self.complete_rows_only = list(cols), complete_rows_only

    def _fit_frame(self, df: DataFrame) -> DataFrame:
        return df.dropna(subset=self.cols) if self.complete_rows_only else df

    def fit(self, df: DataFrame) -> ScalerModel:
        center, scale = self._stats(self._fit_frame(df))
        return ScalerModel(self.cols, center, {c: (s if s not in (None, 0.0) else 1.0) for c, s in scale.items()})


class StandardScaler(_ColumnScaler):
    """(x - mean) / population standard deviation."""

    def _stats(self, df):
        r = df.agg(*[F.avg(c).alias(f"m_{c}") for c in self.cols],
                   *[F.stddev_pop(c).alias(f"s_{c}") for c in self.cols]).first()
        return {c: r[f"m_{c}"] for c in self.cols}, {c: r[f"s_{c}"] for c in self.cols}


class MinMaxScaler(_ColumnScaler):
    """(x - min) / (max - min)."""

    def _stats(self, df):
        r = df.agg(*[F.min(c).alias(f"lo_{c}") for c in self.cols],
                   *[F.max(c).alias(f"hi_{c}") for c in self.cols]).first()
        return ({c: r[f"lo_{c}"] for c in self.cols},
                {c: (r[f"hi_{c}"] - r[f"lo_{c}"]) if r[f"hi_{c}"] is not None else None for c in self.cols})


class RobustScaler(_ColumnScaler):
    """(x - median) / (q75 - q25), exact linear-interpolated quantiles."""

    def _stats(self, df):
        q = bracketed_quantiles(df, self.cols, [0.25, 0.5, 0.75])
        center = {c: q.get((c, 0.5)) for c in self.cols}
        scale = {c: (q[(c, 0.75)] - q[(c, 0.25)]) if (c, 0.75) in q else None for c in self.cols}
        return center, scale


class ScalerModel(Fitted):
    kind = "scaler"

    def __init__(self, cols, center, scale):
        self.cols, self.center, self.scale = cols, center, scale

    def state(self):
        return {"cols": self.cols, "center": self.center, "scale": self.scale}

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(self.center[c])) / F.lit(self.scale[c]) for c in self.cols})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * F.lit(self.scale[c]) + F.lit(self.center[c]) for c in self.cols})


# ------------------------------------------------------------------ E10, E11: PCA

class CenteredPCA:
    """PCA on centred data (MLlib projects uncentred data, so centring comes
    first); ``whiten`` divides each component by its sample deviation."""

    def __init__(self, cols: Sequence[str], k: int, whiten: bool = False, output: str = "pc"):
        self.cols, self.k, self.whiten, self.output = list(cols), k, whiten, output

    def fit(self, df: DataFrame) -> PCAModel:
        means = df.agg(*[F.avg(c).alias(c) for c in self.cols]).first().asDict()
        centred = df.select([(F.col(c) - F.lit(means[c])).alias(c) for c in self.cols])
        vec = VectorAssembler(inputCols=self.cols, outputCol="__v").transform(centred)
        model = _PCA(k=self.k, inputCol="__v", outputCol="__pc").fit(vec)
        n = df.count()
        # sklearn: explained variance = eigenvalue of the sample covariance
        ev = list(model.explainedVariance)
        total_var = df.agg(*[F.var_samp(c).alias(c) for c in self.cols]).first()
        total = sum(v for v in total_var if v is not None)
        comp_var = [e * total for e in ev]
        return PCAModel(self.cols, self.k, self.whiten, self.output, means,
                        [list(map(float, row)) for row in model.pc.toArray().T], comp_var, ev, n)


class PCAModel(Fitted):
    kind = "pca"

    def __init__(self, cols, k, whiten, output, means, components, variances, ratios, n):
        self.cols, self.k, self.whiten, self.output = cols, k, whiten, output
        self.means, self.components, self.variances, self.ratios, self.n = means, components, variances, ratios, n

    def state(self):
        return {k: getattr(self, k) for k in ("cols", "k", "whiten", "output", "means", "components", "variances",
                                               "ratios", "n")}

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for j, comp in enumerate(self.components):
            expr = sum((F.col(c) - F.lit(self.means[c])) * F.lit(w) for c, w in zip(self.cols, comp))
            if self.whiten:
                expr = expr / F.lit(math.sqrt(self.variances[j]) if self.variances[j] > 0 else 1.0)
            new[f"{self.output}{j + 1}"] = expr
        return df.withColumns(new)

    def decoded(self) -> dict:
        """Each column's reconstruction as an expression over the component columns."""
        new = {}
        for i, c in enumerate(self.cols):
            expr = F.lit(self.means[c])
            for j, comp in enumerate(self.components):
                z = F.col(f"{self.output}{j + 1}")
                if self.whiten:
                    z = z * F.lit(math.sqrt(self.variances[j]) if self.variances[j] > 0 else 1.0)
                expr = expr + z * F.lit(comp[i])
            new[c] = expr
        return new

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.decoded())

    def explained_variance(self, spark: SparkSession) -> DataFrame:
        """E11 + W3: per component ratio and running total."""
        rows = [(j + 1, float(r)) for j, r in enumerate(self.ratios)]
        df = spark.createDataFrame(rows, "component int, ratio double")
        w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)  # k rows
        return df.withColumn("cumulative", F.sum("ratio").over(w))


def to_array(df: DataFrame, vec_col: str, out: str) -> DataFrame:
    return df.withColumn(out, vector_to_array(vec_col))


# ------------------------------------------------------------------ T20: Box-Cox

class BoxCox:
    """y = ((1 + x)^lambda - 1) / lambda (log(1 + x) at 0), lambda per
    column maximising the Box-Cox log-likelihood over a grid; all grid points
    are scored in one aggregation."""

    def __init__(self, cols: Sequence[str], grid: Sequence[float] | None = None):
        self.cols = list(cols)
        self.grid = list(grid) if grid is not None else [round(-2 + 0.1 * i, 1) for i in range(41)]

    @staticmethod
    def _t(x, lam):
        return F.log(x) if lam == 0 else (F.pow(x, F.lit(lam)) - 1) / F.lit(lam)

    def fit(self, df: DataFrame) -> BoxCoxModel:
        aggs = []
        for c in self.cols:
            x = F.col(c).cast("double") + 1
            aggs.append(F.sum(F.log(x)).alias(f"{c}__slog"))
            aggs.append(F.count(x).alias(f"{c}__n"))
            for i, lam in enumerate(self.grid):
                aggs.append(F.var_pop(self._t(x, lam)).alias(f"{c}__v{i}"))
        r = df.agg(*aggs).first()
        lams = {}
        for c in self.cols:
            n, slog = r[f"{c}__n"], r[f"{c}__slog"]
            best, best_ll = None, None
            for i, lam in enumerate(self.grid):
                v = r[f"{c}__v{i}"]
                if v is None or v <= 0:
                    continue
                ll = -n / 2.0 * math.log(v) + (lam - 1) * slog
                if best_ll is None or ll > best_ll:
                    best, best_ll = lam, ll
            lams[c] = best if best is not None else 1.0
        return BoxCoxModel(lams)


class BoxCoxModel(Fitted):
    kind = "box_cox"

    def __init__(self, lambdas: dict[str, float]):
        self.lambdas = lambdas

    def state(self):
        return {"lambdas": self.lambdas}

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: BoxCox._t(F.col(c).cast("double") + 1, lam) for c, lam in self.lambdas.items()})
