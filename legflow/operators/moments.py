"""Moment matrices: linear models fitted, validated, tuned and pruned from sums of products.

One scan gives, for each group of rows (a fold, or a pattern of missing
cells), the number of rows, the means, the centred sums of products and the
bounds of the columns.  Groups add and subtract, so the training rows of a
fold are the total without the fold.  Scaling, principal components,
whitening, column choice and the linear models themselves are functions of
those matrices; only absolute errors need a second scan, which scores every
candidate of every fold at once.

What reaches the driver is a matrix for each group, whose size follows the
number of columns and groups and never that of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose means become the origin of the sums.  Any origin gives the same moments up to rounding.
ORIGIN_ROWS = 1000


@dataclass
class Moments:
    """Rows, means, centred sums of products, and bounds of columns."""

    cols: list[str]
    n: float
    mean: np.ndarray
    ss: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def at(self, names: Sequence[str]) -> list[int]:
        return [self.cols.index(c) for c in names]

    def __add__(self, other: Moments) -> Moments:
        if not other.n:
            return self
        if not self.n:
            return other
        n, gap = self.n + other.n, other.mean - self.mean
        return Moments(self.cols, n, self.mean + gap * (other.n / n), self.ss + other.ss + np.outer(gap, gap) * (self.n * other.n / n),
                       np.minimum(self.low, other.low), np.maximum(self.high, other.high))

    def raw(self) -> np.ndarray:
        """Sums of products about zero."""
        return self.ss + self.n * np.outer(self.mean, self.mean)

    def affine(self, matrix: np.ndarray, shift: np.ndarray, cols: Sequence[str]) -> Moments:
        """The moments of ``matrix @ row + shift`` (bounds are not carried)."""
        none = np.full(len(cols), np.nan)
        return Moments(list(cols), self.n, matrix @ self.mean + shift, matrix @ self.ss @ matrix.T, none, none)


def total(parts: Sequence[Moments]) -> Moments:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def _matrix(batch: pa.RecordBatch, first: int) -> np.ndarray:
    """The columns from ``first`` on as a matrix; nulls become NaN."""
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(first, batch.num_columns)])


def moments(df: DataFrame, cols: Sequence[str], by: str | None = None, partial: bool = False) -> dict:
    """{group: Moments} of the columns over complete rows, in one scan.

    ``by`` names an integer column; without it the group is 0.  A row with a
    null or NaN in any of ``cols`` takes no part; with ``partial`` such cells
    count as zero instead (for groups that all miss the same cells).
    """
    cols = list(cols)
    d = len(cols)
    group = (F.col(by) if by else F.lit(0)).cast("bigint").alias("__g")
    rows = df.select(group, *[F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate(cols)]).where(F.col("__g").isNotNull())
    start = rows.limit(ORIGIN_ROWS).agg(*[F.avg(F.nanvl(f"__{i}", F.lit(None).cast("double"))).alias(f"__{i}") for i in range(d)]).first()
    origin = np.array([x if x is not None and math.isfinite(x) else 0.0 for x in start], float)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            g, x = batch.column(0).to_numpy(), _matrix(batch, 1) - origin
            missing = np.isnan(x)
            if partial:
                low, high = np.where(missing, np.inf, x), np.where(missing, -np.inf, x)
                x = np.where(missing, -origin, x)
            else:
                g, x = g[~missing.any(axis=1)], x[~missing.any(axis=1)]
                low = high = x
            for k in np.unique(g):
                here = g == k
                part = x[here]
                s = sums.setdefault(int(k), [0, np.zeros(d), np.zeros((d, d)), np.full(d, np.inf), np.full(d, -np.inf)])
                s[0] += len(part)
                s[1] += part.sum(axis=0)
                s[2] += part.T @ part
                s[3] = np.minimum(s[3], low[here].min(axis=0))
                s[4] = np.maximum(s[4], high[here].max(axis=0))
        groups, slots, values = [], [], []
        for k, (n, s, p, low, high) in sums.items():
            flat = np.concatenate([[n], s, p[upper], low, high])
            groups.append(np.full(len(flat), k))
            slots.append(np.arange(len(flat)))
            values.append(flat)
        join = lambda xs, kind: np.concatenate(xs).astype(kind) if xs else np.zeros(0, kind)
        yield pa.RecordBatch.from_arrays([pa.array(join(groups, np.int64)), pa.array(join(slots, np.int32)), pa.array(join(values, np.float64))],
                                         ["g", "slot", "value"])

    got = (rows.mapInArrow(run, "g bigint, slot int, value double").groupBy("g", "slot")
           .agg(F.sum("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi")).toPandas())
    out = {}
    for k, part in got.sort_values("slot").groupby("g"):
        s, lo, hi = (part[c].to_numpy() for c in ("s", "lo", "hi"))
        n, c = s[0], 1 + d + len(upper[0])
        shift = s[1:1 + d] / n
        p = np.zeros((d, d))
        p[upper] = s[1 + d:c]
        p = p + np.triu(p, 1).T
        out[int(k)] = Moments(cols, float(n), origin + shift, p - n * np.outer(shift, shift), origin + lo[c:c + d], origin + hi[c + d:])
    return out


def without(parts: dict[int, Moments], group: int) -> Moments:
    """All groups but one: a fold's training rows."""
    return total([m for k, m in sorted(parts.items()) if k != group])


# ------------------------------------------------------------------- linear models

def ridge_solution(gram: np.ndarray, cross: np.ndarray, alpha: float) -> np.ndarray:
    """Least ||y - Xb||^2 + alpha ||b||^2 of centred data."""
    a = gram + alpha * np.eye(len(cross))
    try:
        return np.linalg.solve(a, cross)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, cross, rcond=None)[0]


def elastic_solution(gram: np.ndarray, cross: np.ndarray, n: float, alpha: float, l1_ratio: float, start: np.ndarray | None = None,
                     tol: float = 1e-12, sweeps: int = 100_000) -> np.ndarray:
    """Least ||y - Xb||^2 / 2n + alpha r |b|_1 + alpha (1 - r) / 2 ||b||^2, by coordinate descent with covariance updates.

    ``start`` warms a path of penalties.  A column without spread stays at zero.
    """
    g, c = gram / n, cross / n
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    b = np.zeros(len(c)) if start is None else start.copy()
    slope = c - g @ b
    spread = np.diag(g)
    live = np.flatnonzero(spread > 0)
    for _ in range(sweeps):
        moved = 0.0
        for j in live:
            rho = slope[j] + spread[j] * b[j]
            new = math.copysign(max(abs(rho) - l1, 0.0), rho) / (spread[j] + l2)
            step = new - b[j]
            if step:
                slope -= step * g[:, j]
                b[j] = new
                moved = max(moved, abs(step) * math.sqrt(spread[j]))
        if moved <= tol * max(1.0, float(np.abs(b * np.sqrt(np.maximum(spread, 0))).max(initial=0.0))):
            break
    return b


def optimality_gap(gram: np.ndarray, cross: np.ndarray, n: float, b: np.ndarray, alpha: float, l1_ratio: float) -> float:
    """How far the subgradient conditions of ``elastic_solution`` are from holding, at most over the columns."""
    slope = (cross - gram @ b) / n - alpha * (1 - l1_ratio) * b
    l1 = alpha * l1_ratio
    return float(np.where(b != 0, np.abs(slope - l1 * np.sign(b)), np.maximum(np.abs(slope) - l1, 0.0)).max(initial=0.0))


@dataclass
class LinearFit:
    """Coefficients on the columns as they stand in the table."""

    cols: list[str]
    coefficients: np.ndarray
    intercept: float
    branch: dict

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        terms = [F.col(c).cast("double") * F.lit(float(w)) for c, w in zip(self.cols, self.coefficients)]
        return df.withColumn(prediction, sum(terms, F.lit(float(self.intercept))))


class Chain:
    """The scaler and reducer of a branch as one matrix T: reduced columns are T' (x / s), up to a shift the intercept takes up."""

    def __init__(self, m: Moments, features: Sequence[str], label: str, branch: dict, quartiles: dict | None = None,
                 chi2: dict[str, float] | None = None):
        self.m, self.features, self.branch = m, list(features), branch
        x, y = m.at(features), m.at([label])[0]
        self.mean, self.label_mean = m.mean[x], m.mean[y]
        ss, cross = m.ss[np.ix_(x, x)], m.ss[x, y]
        scaler = branch.get("scaler")
        if scaler == "standard":
            s = np.sqrt(np.diag(ss) / m.n)
        elif scaler == "minmax":
            s = m.high[x] - m.low[x]
        elif scaler == "robust":
            s = np.array([quartiles[c] for c in features], float)
        elif scaler is None:
            s = np.ones(len(x))
        else:
            raise ValueError(f"unknown scaler {scaler!r}")
        s = np.where((s == 0) | ~np.isfinite(s), 1.0, s)
        ss, cross = ss / np.outer(s, s), cross / s
        t = np.eye(len(x))
        if branch.get("pca_k"):
            value, vector = np.linalg.eigh(ss / max(m.n - 1, 1))
            order = np.argsort(-value, kind="stable")[:branch["pca_k"]]
            t = vector[:, order]
            if branch.get("whiten"):
                t = t / np.where(value[order] > 0, np.sqrt(np.maximum(value[order], 0)), 1.0)
        elif branch.get("chi2_k"):
            best = sorted(range(len(x)), key=lambda i: (-(chi2.get(self.features[i]) or 0.0), i))[:branch["chi2_k"]]
            t = t[:, sorted(best)]
        self.t = t / s[:, None]
        self.gram, self.cross = t.T @ ss @ t, t.T @ cross

    def fit(self, name: str, params: dict, start: np.ndarray | None = None) -> tuple[LinearFit, np.ndarray]:
        """The model of ``name`` on the reduced columns, and its coefficients there (to start the next penalty from)."""
        if name == "ridge":
            b = ridge_solution(self.gram, self.cross, params.get("alpha", 0.5))
        elif name in ("lasso", "elastic"):
            b = elastic_solution(self.gram, self.cross, self.m.n, params.get("alpha", 1e-6 if name == "lasso" else 1e-4),
                                 1.0 if name == "lasso" else params.get("l1_ratio", 0.9), start)
        else:
            raise ValueError(f"no closed form for {name!r}")
        w = self.t @ b
        return LinearFit(self.features, w, float(self.label_mean - w @ self.mean), params), b


LINEAR = ("ridge", "lasso", "elastic")


def chain_key(branch: dict) -> tuple:
    return tuple(branch.get(k) for k in ("scaler", "pca_k", "whiten", "chi2_k"))


def fit_branches(m: Moments, name: str, features: Sequence[str], label: str, branches: Sequence[dict], quartiles: dict | None = None,
                 chi2: dict | None = None) -> list[LinearFit]:
    """Every branch fitted on one training matrix; branches that differ in penalties share their chain, strongest penalty first."""
    out: list = [None] * len(branches)
    groups: dict = {}
    for i, b in enumerate(branches):
        groups.setdefault(chain_key(b), []).append(i)
    for at in groups.values():
        chain, start = Chain(m, features, label, branches[at[0]], quartiles, chi2), None
        for i in sorted(at, key=lambda i: -branches[i].get("alpha", 0)):
            out[i], start = chain.fit(name, branches[i], start)
    return out


# ------------------------------------------------------------------- what moments do not hold

def training_quartile_ranges(df: DataFrame, cols: Sequence[str], by: str, k: int) -> dict[int, dict[str, float]]:
    """{fold: {column: q75 - q25}} of each fold's training rows; fold k stands for all rows.  One set of ranks for all folds."""
    from legflow.operators.quantiles import quantiles

    long = df.select(F.col(by).cast("int").alias("__f"), *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        ["__f"], list(cols), "__c", "__v").where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    counts = long.groupBy("__c", "__f", "__v").agg(F.count(F.lit(1)).alias("__n"))
    uses = F.transform(F.filter(F.sequence(F.lit(0), F.lit(k)), lambda x: x != F.col("__f")), lambda x: F.concat_ws(":", x.cast("string"), F.col("__c")))
    rows = counts.select(F.explode(uses).alias("__g"), "__v", "__n")
    out: dict = {i: {} for i in range(k + 1)}
    for r in quantiles(rows, "__g", "__v", [0.25, 0.75], weight="__n").collect():  # two rows for each fold and column
        fold, c = r["__g"].split(":", 1)
        out[int(fold)][c] = out[int(fold)].get(c, 0.0) + (r["quantile"] if r["q"] == 0.75 else -r["quantile"])
    return out


def training_chi2(df: DataFrame, cols: Sequence[str], label: str, by: str, parts: dict[int, Moments], k: int) -> dict[int, dict[str, float]]:
    """{fold: {column: chi-square}} of each fold's training rows after min-max scaling; fold k stands for all rows.

    The class table has a row for each label value and stays in Spark; a
    class' training sums are its total without the fold's.
    """
    cols = list(cols)
    x = df.select(F.col(label).alias("__y"), F.col(by).cast("int").alias("__f"), *[F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate(cols)])
    x = x.dropna()
    folds = range(k + 1)
    per = x.groupBy("__y").agg(
        *[F.count_if(F.col("__f") != f).alias(f"n{f}") for f in folds],
        *[F.sum(F.when(F.col("__f") != f, F.col(f"__{i}")).otherwise(0.0)).alias(f"s{f}_{i}") for f in folds for i in range(len(cols))])
    aggs = []
    for f in folds:
        m = without(parts, f) if f < k else total([parts[g] for g in sorted(parts)])
        at = m.at(cols)
        for i, j in enumerate(at):
            width = m.high[j] - m.low[j] or 1.0
            observed = (F.col(f"s{f}_{i}") - F.col(f"n{f}") * F.lit(float(m.low[j]))) / F.lit(float(width))
            expected = F.col(f"n{f}") * F.lit(float((m.mean[j] - m.low[j]) / width))
            aggs.append(F.sum(F.try_divide((observed - expected) ** 2, expected)).alias(f"c{f}_{i}"))
    row = per.agg(*aggs).first()
    return {f: {c: row[f"c{f}_{i}"] for i, c in enumerate(cols)} for f in folds}


def fold_errors(df: DataFrame, features: Sequence[str], label: str, by: str, fits: dict[int, list[LinearFit]]) -> dict:
    """{(fold, candidate): (rows, sum of squared errors, sum of absolute errors)} on each fold's own rows, in one scan for all."""
    features = list(features)
    weights = {f: (np.column_stack([x.coefficients for x in fs]), np.array([x.intercept for x in fs])) for f, fs in fits.items()}
    rows = df.select(F.col(by).cast("bigint").alias("__g"), *[F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate([*features, label])])
    chunk = max(1, (1 << 22) // max(len(next(iter(fits.values()))), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            g, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch, 1)
            whole = ~np.isnan(x).any(axis=1)
            for f, (w, b) in weights.items():
                part = x[whole & (g == f)]
                for a in range(0, len(part), chunk):
                    e = part[a:a + chunk, -1:] - (part[a:a + chunk, :-1] @ w + b)
                    s = sums.setdefault(f, [0, np.zeros(len(b)), np.zeros(len(b))])
                    s[0] += len(e)
                    s[1] += (e * e).sum(axis=0)
                    s[2] += np.abs(e).sum(axis=0)
        cols: list[list] = [[], [], [], [], []]
        for f, (n, sse, sae) in sums.items():
            for i in range(len(sse)):
                for c, v in zip(cols, (f, i, float(n), sse[i], sae[i])):
                    c.append(v)
        kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["g", "i", "n", "sse", "sae"])

    got = (rows.mapInArrow(run, "g bigint, i int, n double, sse double, sae double").groupBy("g", "i")
           .agg(*[F.sum(c).alias(c) for c in ("n", "sse", "sae")]).collect())  # a row for each fold and candidate
    return {(r["g"], r["i"]): (r["n"], r["sse"], r["sae"]) for r in got}


def fold_scores(df: DataFrame, name: str, features: Sequence[str], branches: Sequence[dict], label: str = "label",
                fold_col: str = "fold", k: int = 5) -> tuple[list[dict], list[LinearFit]]:
    """Scores of every branch on every fold, and every branch fitted on all rows.

    Two scans in all (moments, errors); branches with the robust scaler add
    one for the quartiles, those with chi-square columns one for the classes.
    Returns [{idx, fold, mse, mae, r2}] and the fits.
    """
    parts = moments(df, [*features, label], fold_col)
    everything = total([parts[f] for f in sorted(parts)])
    ranges = training_quartile_ranges(df, features, fold_col, k) if any(b.get("scaler") == "robust" for b in branches) else {}
    chi2 = training_chi2(df, features, label, fold_col, parts, k) if any(b.get("chi2_k") for b in branches) else {}
    folds = [f for f in range(k) if f in parts and parts[f].n]
    fits = {f: fit_branches(without(parts, f), name, features, label, branches, ranges.get(f), chi2.get(f)) for f in folds}
    full = fit_branches(everything, name, features, label, branches, ranges.get(k), chi2.get(k))
    errors = fold_errors(df, features, label, fold_col, fits)
    out = []
    for f in folds:
        y = parts[f].at([label])[0]
        spread = float(parts[f].ss[y, y])
        for i in range(len(branches)):
            n, sse, sae = errors[f, i]
            out.append(dict(idx=i, fold=f, mse=sse / n, mae=sae / n, r2=1 - sse / spread if spread else None))
    return out, full


# ------------------------------------------------------------------- inference and elimination

def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    value = d
    for m in range(1, 10_000):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + numerator / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def t_two_sided(t: float, dof: float) -> float:
    """P(|T| >= |t|) of Student's distribution."""
    return 1.0 if math.isnan(t) else 0.0 if math.isinf(t) else beta_share(dof / 2, 0.5, dof / (dof + t * t))


def t_bound(conf: float, dof: float) -> float:
    """The t that |T| stays below with probability ``conf``, by bisection."""
    low, high = 0.0, 1.0
    while t_two_sided(high, dof) > 1 - conf:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, dof) > 1 - conf else (low, mid)
    return (low + high) / 2


def swept(a: np.ndarray, p: int) -> np.ndarray:
    """The sweep operator: column p enters the regression, or leaves it when swept a second time (with its sign kept)."""
    d = a[p, p]
    out = a - np.outer(a[:, p], a[p, :]) / d
    out[:, p], out[p, :] = a[:, p] / d, a[p, :] / d
    out[p, p] = -1 / d
    return out


def unswept(a: np.ndarray, p: int) -> np.ndarray:
    d = a[p, p]
    out = a - np.outer(a[:, p], a[p, :]) / d
    out[:, p], out[p, :] = -a[:, p] / d, -a[p, :] / d
    out[p, p] = -1 / d
    return out


@dataclass
class Regression:
    """Least squares without intercept: coefficients, their errors and two-sided p-values."""

    features: list[str]
    coefficients: np.ndarray
    errors: np.ndarray
    p_values: np.ndarray
    dof: float
    removed: list[str]

    def bounds(self, conf: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
        t = t_bound(conf, self.dof)
        return self.coefficients - t * self.errors, self.coefficients + t * self.errors


def eliminated(m: Moments, features: Sequence[str], label: str, level: float) -> Regression | None:
    """Backward elimination on one moment matrix: every column is swept in, and the one of largest p-value out while above ``level``."""
    features = list(features)
    at = m.at([*features, label])
    a = m.raw()[np.ix_(at, at)]
    scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    a = a / np.outer(scale, scale)  # columns of unit length keep the sweeps well conditioned
    y, kept, removed = len(features), [], []
    for i in range(len(features)):
        if a[i, i] > 1e-12:
            a = swept(a, i)
            kept.append(i)
        else:
            removed.append(features[i])  # a combination of the columns before it
    while kept:
        dof = m.n - len(kept)
        variance = max(a[y, y], 0.0) / dof if dof > 0 else math.nan
        b = a[kept, y]
        errors = np.sqrt(-np.diag(a)[kept] * variance)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.array([t_two_sided(t, dof) for t in np.where(errors > 0, b / errors, np.where(b == 0, 0.0, np.inf))])
        worst = int(np.argmax(p))
        if not p[worst] > level:
            back = scale[y] / scale[kept]
            return Regression([features[i] for i in kept], b * back, errors * back, p, dof, removed)
        removed.append(features[kept[worst]])
        a = unswept(a, kept.pop(worst))
    return None


def recursive_elimination(parts: dict[int, Moments], features: Sequence[str], label: str, alpha: float) -> tuple[list[str], list[tuple[int, float]]]:
    """Lasso of penalty ``alpha``; the smallest |coefficient| of all rows leaves each step; each set is scored on the folds.

    All from the folds' moment matrices: a set is a submatrix, and a fold's
    squared error a quadratic form of its own moments.
    """
    everything = total([parts[f] for f in sorted(parts)])
    training = {f: without(parts, f) for f in parts if len(parts) > 1}
    current = list(features)
    history: list[tuple[list[str], float]] = []
    warm: dict = {}

    def fitted(key, m: Moments) -> tuple[np.ndarray, list[int], int]:
        x, y = m.at(current), m.at([label])[0]
        start = np.array([warm.get((key, c), 0.0) for c in current])
        b = elastic_solution(m.ss[np.ix_(x, x)], m.ss[x, y], m.n, alpha, 1.0, start)
        warm.update({(key, c): v for c, v in zip(current, b)})
        return b, x, y

    while current:
        scores = []
        for f, m in training.items():
            b, x, y = fitted(f, m)
            own = parts[f]
            # residual = (y - mean) - b (x - mean), about the training means
            drift = (own.mean[y] - m.mean[y]) - b @ (own.mean[x] - m.mean[x])
            sse = own.ss[y, y] - 2 * b @ own.ss[x, y] + b @ own.ss[np.ix_(x, x)] @ b + own.n * drift * drift
            scores.append(float(sse / own.n))
        history.append((list(current), sum(scores) / max(len(scores), 1)))
        b, _, _ = fitted("all", everything)
        current = [c for i, c in enumerate(current) if i != int(np.argmin(np.abs(b)))]
    # a column whose coefficient is zero changes its set's score by rounding alone: the fewest columns win such a tie
    low = min(score for _, score in history)
    ties = [h for h in history if h[1] <= low + 1e-9 * abs(low)]
    best = min(ties, key=lambda h: len(h[0])) if ties else min(history, key=lambda h: (h[1], len(h[0])))
    return best[0], [(len(f), s) for f, s in history]
