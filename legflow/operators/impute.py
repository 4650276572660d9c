"""Missing data: injection, imputation and its scoring (M1..M16).

Frames are keyed by a row key (``key``); truth / prediction / mask frames
are aligned by joining on it.  Iterative imputers learn from moment matrices
and fill rows in one pass, without a written table between rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legflow.functions.nulls import hash_uniform, uniform
from legflow.operators.clean import complete_numeric_rows, drop_columns
from legflow.operators.encode import CenteredPCA, StandardScaler
from legflow.operators.moments import Moments, moments, total

# Odd multipliers for per-column masks (distinct so masks are not correlated).
MASK_MULTIPLIERS = [2654435761, 2246822519, 3266489917, 668265263, 374761393, 1597334677, 3812015801,
                    1181783497, 2891336453, 3054961077]


def row_uniform(key: str, seed: int, slot: int, arithmetic: bool) -> "F.Column":
    """Per-row value in [0, 1).  Library default: xxhash64 (safe for any key);
    ``arithmetic`` uses the closed form the SQL oracle can recompute."""
    if arithmetic:
        return uniform(key, seed + 101 * slot, MASK_MULTIPLIERS[slot % len(MASK_MULTIPLIERS)])
    return hash_uniform(key, seed * 1009 + slot)


# ------------------------------------------------------------------ M1..M3

def inject_nulls(df: DataFrame, cols: Sequence[str], rate: float, key: str, seed: int = 0,
                 arithmetic: bool = False) -> DataFrame:
    """M1: each column loses an independent ``rate`` share of its rows (function of the key)."""
    out = {}
    for i, c in enumerate(cols):
        u = row_uniform(key, seed, i + 1, arithmetic)
        out[c] = F.when(u >= F.lit(rate), F.col(c))
    return df.withColumns(out)


def imputation_benchmark(df: DataFrame, key: str, drop: Sequence[str] = (), sample_rate: float = 0.5,
                         miss_rate: float = 0.5, seed: int = 0,
                         arithmetic: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M2: (incomplete, truth, full).  ``truth`` = complete rows of ``full`` sampled at
    ``sample_rate``; ``incomplete`` = truth with ``miss_rate`` of the cells removed in
    every column that has missing values in ``full``."""
    full = drop_columns(df, drop)
    cols = [c for c in full.columns if c != key]
    null_any = full.agg(*[F.max(F.col(c).isNull().cast("int")).alias(c) for c in cols]).first().asDict()
    gappy = [c for c in cols if null_any[c]]
    truth = full.dropna(subset=cols).where(row_uniform(key, seed, 0, arithmetic) < F.lit(sample_rate))
    incomplete = inject_nulls(truth, gappy, miss_rate, key, seed + 7, arithmetic)
    return incomplete, truth, full


def missing_mask(df: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """M3: boolean mask columns ``<c>__missing``."""
    return df.select(key, *[F.col(c).isNull().alias(f"{c}__missing") for c in cols])


# ------------------------------------------------------------------ M4..M6, M9: scores

def _cells(truth: DataFrame, pred: DataFrame, incomplete: DataFrame, cols: Sequence[str], key: str,
           kind: str = "double") -> DataFrame:
    """Long form (column, t, p, masked) over all cells of ``cols``: one join of the wide rows on the key, then a
    narrow expansion, so a row is shuffled once and not once per column."""
    t = truth.select(key, *[F.col(c).cast(kind).alias(f"{c}__t") for c in cols])
    p = pred.select(key, *[F.col(c).cast(kind).alias(f"{c}__p") for c in cols])
    m = incomplete.select(key, *[F.col(c).isNull().alias(f"{c}__m") for c in cols])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__t").alias("t"), F.col(f"{c}__p").alias("p"),
                               F.col(f"{c}__m").alias("masked")) for c in cols])
    return t.join(p, key).join(m, key).select(F.inline(cells))


def masked_scores(truth: DataFrame, pred: DataFrame, incomplete: DataFrame, cols: Sequence[str], key: str,
                  observed: bool = False, per_column: bool = False, scaler=None) -> DataFrame:
    """M4 / M6: MSE, MAE, MAPE over the masked numeric cells (``observed`` scores
    the other cells instead), pooled or per column.  With a fitted ``scaler`` the
    scores are in its (standardised) units."""
    if scaler is not None:
        truth, pred = scaler.transform(truth), scaler.transform(pred)
    cells = _cells(truth, pred, incomplete, cols, key).where(F.col("masked") != F.lit(observed))
    t, p = F.col("t"), F.col("p")
    aggs = [F.avg((t - p) ** 2).alias("mse"), F.avg(F.abs(t - p)).alias("mae"),
            (F.avg(F.try_divide(F.abs(t - p), F.abs(t))) * 100).alias("mape"), F.count(F.lit(1)).alias("n_cells")]
    return cells.groupBy("column").agg(*aggs) if per_column else cells.agg(*aggs)


def masked_accuracy(truth: DataFrame, pred: DataFrame, incomplete: DataFrame, cols: Sequence[str], key: str,
                    per_column: bool = False) -> DataFrame:
    """M5 / M6: share of masked categorical cells predicted exactly."""
    cells = _cells(truth, pred, incomplete, cols, key, "string").where(F.col("masked"))
    aggs = [F.avg((F.col("t") == F.col("p")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n_cells")]
    return cells.groupBy("column").agg(*aggs) if per_column else cells.agg(*aggs)


def mean_baseline_mae(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M9: per column mean absolute deviation from the column mean, over all cells."""
    long = df.select([F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column", "v")
    means = long.groupBy("column").agg(F.avg("v").alias("__m"))
    return long.join(F.broadcast(means), "column").groupBy("column").agg(
        F.avg(F.abs(F.col("v") - F.col("__m"))).alias("mae"))


# ------------------------------------------------------------------ M7, M8: baselines

class MeanFill:
    """M7: fill numeric NULL with the column mean (fitted)."""

    def __init__(self, cols: Sequence[str]):
        self.cols = list(cols)

    def fit(self, df: DataFrame) -> MeanFill:
        self.values = df.agg(*[F.avg(c).alias(c) for c in self.cols]).first().asDict()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(self.values[c])) for c in self.cols})


class ModeFill:
    """M8: fill categorical NULL with the most frequent value (ties: smallest)."""

    def __init__(self, cols: Sequence[str]):
        self.cols = list(cols)

    def fit(self, df: DataFrame) -> ModeFill:
        long = df.select([F.col(c).cast("string").alias(c) for c in self.cols]).unpivot(
            [], self.cols, "column", "v").where(F.col("v").isNotNull())
        counts = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
        # min over (-n, v): the most frequent value, ties to the smallest
        best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("nn"), F.col("v"))).alias("b"))
        self.values = {r["column"]: r["b"]["v"] for r in best.collect()}  # one row per column
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(self.values.get(c))) for c in self.cols})


# ------------------------------------------------------------------ M10: chained equations

#: Patterns of missing cells whose moments are kept at once; beyond it each regression scans the rows.
PATTERNS = 1024


class IterativeImputer:
    """Start from column means, then for ``max_iter`` rounds regress each
    incomplete column (fewest missing first) on all other columns, using rows
    where it is observed, and overwrite only its missing cells.  ``fit`` learns
    the per-round regressions on one frame; ``transform`` replays them by round
    and column, in the fitted order, in one pass over the rows.  A column that
    had no gaps in ``fit`` has no regression: its gaps keep the fitted mean.
    NaN counts as missing; a column without any value stays empty and is no
    predictor.

    Rows that miss the same cells are filled by the same affine map of what
    they hold, in every round.  So the moments of each pattern of missing cells
    (one scan) give the moments of the filled rows, and with them all
    regressions of all rounds.  Where there are more than ``patterns``
    patterns, each regression takes its moments from a scan instead.  ``reg``
    is a ridge on standardised columns."""

    def __init__(self, cols: Sequence[str], key: str, max_iter: int = 10, reg: float = 1e-6, patterns: int = PATTERNS):
        self.cols, self.key, self.max_iter, self.reg, self.patterns = list(cols), key, max_iter, reg, patterns

    def _regression(self, m: Moments, c: int, live: list[int]) -> tuple[np.ndarray, float]:
        """Coefficients (zero for columns that are no predictors) and offset of column ``c`` on the other live ones."""
        w = np.zeros(len(self.cols))
        others = [o for o in live if o != c]
        spread = np.sqrt(np.maximum(np.diag(m.ss)[others], 0))
        used = [(o, s) for o, s in zip(others, spread) if s > 1e-9 * (1 + abs(m.mean[o])) * math.sqrt(max(m.n, 1))]
        if used and m.n:
            at, s = [o for o, _ in used], np.array([s for _, s in used])
            corr = m.ss[np.ix_(at, at)] / np.outer(s, s) + self.reg * np.eye(len(at))
            try:
                w[at] = np.linalg.solve(corr, m.ss[at, c] / s) / s
            except np.linalg.LinAlgError:
                w[at] = np.linalg.lstsq(corr, m.ss[at, c] / s, rcond=None)[0] / s
        return w, float(m.mean[c] - w @ m.mean) if m.n else 0.0

    def fit(self, df: DataFrame) -> IterativeImputer:
        cols, d = self.cols, len(self.cols)
        x = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols])
        miss = x.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in cols], *[F.avg(c).alias(f"m_{c}") for c in cols]).first()
        self.means = {c: miss[f"m_{c}"] for c in cols}
        live = [i for i, c in enumerate(cols) if self.means[c] is not None]
        order = sorted([i for i in live if miss[f"n_{cols[i]}"] > 0], key=lambda i: (miss[f"n_{cols[i]}"], i))
        self.models = {}
        if not order:
            return self
        pattern = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in cols])
        coded = x.withColumn("__p", pattern)
        seen = [r["__p"] for r in coded.select("__p").distinct().limit(self.patterns + 1).collect()]  # bounded
        start = np.array([self.means[c] or 0.0 for c in cols])
        if len(seen) <= self.patterns:
            code = F.create_map(*[F.lit(v) for i, p in enumerate(sorted(seen)) for v in (p, i)])
            held = moments(coded.withColumn("__i", code[F.col("__p")]), cols, "__i", partial=True)
            gaps = {k: np.array([ch == "1" for ch in sorted(seen)[k]]) for k in held}
            fill = {k: (np.diag((~g).astype(float)), np.where(g, start, 0.0)) for k, g in gaps.items()}
        for it in range(self.max_iter):
            for c in order:
                if len(seen) <= self.patterns:
                    m = total([held[k].affine(*fill[k], cols) for k in sorted(held) if not gaps[k][c]])
                else:
                    m = moments(self._replayed(x, cols[c]), cols).get(0) or Moments(cols, 0, start, np.zeros((d, d)), start, start)
                w, b = self._regression(m, c, live)
                self.models[it, cols[c]] = ([float(v) for v in w], b)
                if len(seen) <= self.patterns:
                    for k, (a, shift) in fill.items():
                        if gaps[k][c]:
                            a, shift = a.copy(), shift.copy()
                            a[c], shift[c] = w @ a, w @ shift + b
                            fill[k] = (a, shift)
        return self

    def _filler(self):
        cols = self.cols
        start = np.array([np.nan if self.means[c] is None else self.means[c] for c in cols])
        steps = [(cols.index(c), np.array(w), b) for (_, c), (w, b) in self.models.items()]

        def filled(x: np.ndarray) -> np.ndarray:
            gap = np.isnan(x)
            x = np.where(gap, start, x)
            for c, w, b in steps:
                rows, used = gap[:, c], np.flatnonzero(w)
                x[rows, c] = x[np.ix_(rows, used)] @ w[used] + b
            return x
        return filled

    def _replayed(self, x: DataFrame, observed: str) -> DataFrame:
        """The rows of ``x`` where ``observed`` is not missing, filled by the regressions learnt so far."""
        return _mapped(x.where(F.col(observed).isNotNull()), [], self.cols, self._filler())

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def transform(self, df: DataFrame) -> DataFrame:
        return _mapped(df, [self.key], self.cols, self._filler())


def _mapped(df: DataFrame, keep: Sequence[str], cols: Sequence[str], change) -> DataFrame:
    """(``keep``, ``cols``) with the matrix of ``cols`` changed batch by batch; nulls are NaN inside and null outside."""
    n = len(keep)
    x = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = change(np.column_stack([batch.column(n + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(cols))]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *[pa.array(out[:, i], pa.float64(), from_pandas=True) for i in range(len(cols))]],
                                             [*keep, *cols])

    return x.mapInArrow(run, x.schema)


# ------------------------------------------------------------------ M11, M12: reconstruct and refill

class ReconstructImputer:
    """Missing cells start at ``init`` (in scaled units); each round the row is encoded
    to ``k`` centred principal components and decoded, and only missing cells
    take the reconstruction (``blend`` < 1 mixes old and new).  Scaling and
    components are fitted on complete rows.  The rounds are an iteration inside
    the row: one pass over the rows, whatever their number."""

    def __init__(self, cols: Sequence[str], key: str, k: int = 2, max_iter: int = 25, init: float = 0.0, blend: float = 1.0):
        self.cols, self.key, self.k, self.max_iter = list(cols), key, k, max_iter
        self.init, self.blend = init, blend

    def fit(self, df: DataFrame) -> ReconstructImputer:
        complete = complete_numeric_rows(df, self.cols)
        self.scaler = StandardScaler(self.cols).fit(complete)
        self.pca = CenteredPCA(self.cols, self.k).fit(self.scaler.transform(complete))
        return self

    def transform(self, df: DataFrame, rounds: int | None = None) -> DataFrame:
        """(key, cols) after ``rounds`` rounds (all if None); fewer rounds give the trace of the filling."""
        center = np.array([self.scaler.center[c] for c in self.cols], float)
        scale = np.array([self.scaler.scale[c] for c in self.cols], float)
        mean = np.array([self.pca.means[c] for c in self.cols], float)
        components = np.array(self.pca.components, float).reshape(-1, len(self.cols))
        n, init, blend = self.max_iter if rounds is None else rounds, self.init, self.blend

        def filled(x: np.ndarray) -> np.ndarray:
            gap = np.isnan(x)
            z = np.where(gap, init, (x - center) / scale)
            some = gap.any(axis=1)
            part, there = z[some], gap[some]
            for _ in range(n):
                back = mean + (part - mean) @ components.T @ components
                part = np.where(there, (1 - blend) * part + blend * back, part)
            z[some] = part
            return np.where(gap, z * scale + center, x)
        return _mapped(df, [self.key], self.cols, filled)


# ------------------------------------------------------------------ M14

def drop_unfilled(pred: DataFrame, truth: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows an imputer left incomplete leave both prediction and truth."""
    filled = pred.dropna("any")
    return filled, truth.join(filled.select(key), key, "left_semi")


# ------------------------------------------------------------------ M15, M16: nearest neighbours

KNN_BLOCK_BYTES = 16 << 20
KNN_CHUNK = 256
#: Distances that a task holds at once.
KNN_DISTANCES = 1 << 20
#: Queries that meet a block of train rows in one task.
KNN_QUERIES = 1 << 14


def _knn_block(k: int):
    """Top k of each query against the block of train rows that precedes it in a task's sorted rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, ready = None, [], None
        for pdf in batches:
            for (b, side), part in pdf.groupby(["task", "side"], sort=True):
                if b != block:
                    block, held, ready = b, [], None
                if side == 0:
                    held.append(part)
                    continue
                if ready is None:
                    if not held:
                        continue
                    t = pd.concat(held).sort_values("id", kind="stable")
                    x = np.stack(t["features"].to_numpy()).astype(np.float64)
                    ready = (x, (x ** 2).sum(axis=1), t["label"].to_numpy(), t["id"].to_numpy())
                    held, t = [], None
                x, x2, y, ids = ready
                kk = min(k, len(ids))
                step = max(1, min(KNN_CHUNK, KNN_DISTANCES // len(ids)))
                for at in range(0, len(part), step):
                    sub = part.iloc[at:at + step]
                    q = np.stack(sub["features"].to_numpy()).astype(np.float64)
                    d2 = (q ** 2).sum(axis=1)[:, None] + x2[None, :]
                    d2 -= 2.0 * q @ x.T
                    # everything not beyond the k-th distance, then order by (distance, train id)
                    edge = np.partition(d2, kk - 1, axis=1)[:, kk - 1]
                    rows = []
                    for i in range(len(sub)):
                        near = np.flatnonzero(d2[i] <= edge[i])
                        near = near[np.lexsort((ids[near], d2[i][near]))][:kk]
                        rows.append(pd.DataFrame({"query_id": sub["id"].iloc[i], "neighbour_id": ids[near],
                                                  "neighbour_label": y[near], "dist2": d2[i][near]}))
                    yield pd.concat(rows)
    return run


def nearest_neighbours(train: DataFrame, query: DataFrame, k: int, block_bytes: int = KNN_BLOCK_BYTES,
                       slot_queries: int = KNN_QUERIES) -> DataFrame:
    """(query_id, rank, neighbour_id, neighbour_label, dist2): exact k nearest train
    rows per query row.  Inputs: ``id``, ``features`` (array<double>), train also
    ``label``.  Train rows are dealt into blocks of about ``block_bytes`` and
    queries into slots of about ``slot_queries`` by hashes of their ids; a task
    is one block and one slot, so tasks grow with either side and each holds
    one block, reads its queries as a stream, and returns at most k rows a
    query.  A per-query top k merges the blocks.  No pair of rows is ever
    materialised, and nothing passes through the driver but three counts."""
    r = train.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("d")).first()
    blocks = max(1, -(-(r["n"] or 0) * 8 * max(r["d"] or 1, 1) // block_bytes))
    slots = max(1, -(-query.count() // slot_queries))
    cols = ["task", "side", "id", "features", "label"]

    def dealt(parts: int):
        return F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")

    t = train.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda s: dealt(blocks) * slots + s)).alias("task"),
                     F.lit(0).alias("side"), F.col("id").cast("long").alias("id"), "features", F.col("label").cast("int").alias("label"))
    q = query.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b * slots + dealt(slots))).alias("task"),
                     F.lit(1).alias("side"), F.col("id").cast("long").alias("id"), "features", F.lit(0).cast("int").alias("label"))
    # a partition for each task by its number: a hash would pile several into one
    both = t.select(cols).unionByName(q.select(cols)).repartitionById(blocks * slots, "task").sortWithinPartitions("task", "side")
    out = both.mapInPandas(_knn_block(k), "query_id long, neighbour_id long, neighbour_label int, dist2 double")
    w = Window.partitionBy("query_id").orderBy("dist2", "neighbour_id")
    return (out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "neighbour_id", "neighbour_label", "dist2"))


def knn_vote(neighbours: DataFrame, k: int) -> DataFrame:
    """Majority label among the k nearest (ties: smallest label)."""
    votes = neighbours.where(F.col("rank") <= k).groupBy("query_id", "neighbour_label").agg(
        F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("query_id").agg(F.min(F.struct((-F.col("n")).alias("nn"), "neighbour_label")).alias("b"))
    return best.select("query_id", F.col("b.neighbour_label").alias("prediction"))


def knn_error_rates(neighbours: DataFrame, truth: DataFrame, ks: Sequence[int] = range(1, 10)) -> DataFrame:
    """Error rate for each k from one ranked neighbour table: a neighbour of rank r votes
    for every k >= r, so the search and its ranking run once."""
    each = neighbours.select("query_id", "neighbour_label", F.explode(
        F.expr(f"filter(array({', '.join(map(str, ks))}), k -> k >= rank)")).alias("k"))
    votes = each.groupBy("query_id", "k", "neighbour_label").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("query_id", "k").agg(F.min(F.struct((-F.col("n")).alias("nn"), "neighbour_label")).alias("b"))
    pred = best.select("query_id", "k", F.col("b.neighbour_label").alias("prediction")).join(
        truth.select(F.col("id").alias("query_id"), "label"), "query_id")
    return pred.groupBy("k").agg(F.avg((F.col("prediction") != F.col("label")).cast("double")).alias("error_rate"))


# ------------------------------------------------------------------ M13: whole-table flow

def impute_table(df: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str] = (),
                 method: str = "iterative", max_iter: int = 10, k: int = 2, decomposed_dates: Sequence[str] = (),
                 out_path: str | None = None) -> DataFrame:
    """Encode categories as ordinal codes, scale (fitted on complete rows; on all where no row is complete),
    impute, unscale, round (numbers to 2 places, codes half-even), decode,
    drop decomposed date parts, rejoin the untouched columns by key, and
    optionally write the table."""
    from legflow.operators.derive import remove_decomposed_dates
    from legflow.operators.encode import OrdinalEncoder

    numeric, categorical = list(numeric), list(categorical)
    cols = numeric + categorical
    enc = OrdinalEncoder(categorical).fit(df) if categorical else None
    x = enc.transform(df.select(key, *cols)) if enc else df.select(key, *cols)
    x = x.select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    complete = complete_numeric_rows(x, cols)
    scaler = StandardScaler(cols).fit(complete if complete.limit(1).count() else x)
    scaled = scaler.transform(x)
    if method == "iterative":
        filled = IterativeImputer(cols, key, max_iter=max_iter).fit_transform(scaled)
    elif method == "reconstruct":
        filled = ReconstructImputer(cols, key, k=k, max_iter=max_iter).fit(scaled).transform(scaled)
    else:
        raise ValueError(f"unknown imputation method {method!r}")
    back = scaler.inverse_transform(filled)
    back = back.withColumns({c: F.round(F.col(c), 2) for c in numeric})
    if enc:
        back = enc.inverse_transform(back)
    rest = [c for c in df.columns if c not in cols]
    out = df.select(*rest).join(back, key)
    if decomposed_dates:
        out = remove_decomposed_dates(out, decomposed_dates)
    if out_path:
        out.write.mode("overwrite").parquet(out_path)
    return out
