"""Trees grown from histograms: second-order boosting and forests.

Columns are cut into bins once.  A level of a tree is one aggregation: every
task adds up gradients and hessians by node, column and bin, Spark sums them,
and the driver, which sees a histogram and never a row, picks the splits.  A
boosted tree costs a job for each of its levels; a forest grows ``BLOCK``
trees in each job.

Rows of equal bins reach the same leaf of every tree.  Where the distinct bins
(cells) are few beside the rows, one pass draws the rows' weights for many
trees and adds them up by cell, and the levels of those trees read the sums
instead of the rows.  With many cells the levels read the rows.  Either way
every row is drawn by its own key, and the trees are the same but for rounding.

Boosted trees follow one another, so levels would take four jobs a round.
Where the rows, or the cells, fit a fixed number of bytes, one task holds them
and grows the rounds in turn, by the same sums; beyond it a level is a job.

Boosting is resumable.  Every ``every`` rounds the rows' margins and the trees
so far are written to ``folder``; a run with the same folder goes on from the
last of these, and gives the trees that an uninterrupted run gives, since
samples depend on row keys, rounds and the seed alone.

Nulls and NaN count as less than every threshold; rows without a label take
no part in training.  Without rows the model is its base.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legflow.operators.encode import Fitted
from legflow.session import checkpoint_path

BINS, BLOCK = 64, 64
#: Rows a task works on at once.
CHUNK = 1 << 16


@dataclass
class Tree:
    """A complete binary tree in heap order from 1; ``feature`` is -1 at leaves.  Left are values up to the threshold."""

    feature: list[int]
    threshold: list[float]
    cut: list[int]
    value: list[float]

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 << depth
        return cls([-1] * n, [0.0] * n, [0] * n, [0.0] * n)


@dataclass
class Growth:
    """How trees are grown.  ``row_share``: rows drawn for each tree without replacement; ``bootstrap``: with replacement
    instead.  ``tree_columns``: share of the columns drawn for each tree; ``node_columns``: number drawn for each node."""

    depth: int = 4
    l1: float = 0.0
    l2: float = 0.0
    min_child: float = 1.0
    row_share: float = 1.0
    bootstrap: bool = False
    tree_columns: float = 1.0
    node_columns: int | None = None
    seed: int = 0


def hashed(h: np.ndarray, salt: int) -> np.ndarray:
    """Uniform integers below 2^53 from row hashes and a salt (splitmix64's finaliser)."""
    x = h.astype(np.uint64)
    x += np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    t = x >> np.uint64(30)
    x ^= t
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, np.uint64(27), out=t)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= np.right_shift(x, np.uint64(31), out=t)
    x >>= np.uint64(11)
    return x


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from row hashes and a salt."""
    return hashed(h, salt).astype(float) / float(1 << 53)


POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(19)])
#: Poisson counts by the first 16 bits of a hash; NaN where a bound lies inside.
_FIRST, _LAST = (np.searchsorted(POISSON, (np.arange(1 << 16) + end) / (1 << 16) - off, "right") for end, off in ((0, 0.0), (1, 2.0 ** -53)))
POISSON_TABLE = np.where(_FIRST == _LAST, _FIRST.astype(float), np.nan)


def row_weights(h: np.ndarray, g: Growth, number: int) -> np.ndarray:
    salt = g.seed * 1_000_003 + number
    if g.bootstrap:
        x = hashed(h, salt)
        out = POISSON_TABLE[(x >> np.uint64(37)).view(np.int64)]
        torn = np.flatnonzero(np.isnan(out))
        out[torn] = np.searchsorted(POISSON, x[torn].astype(float) / float(1 << 53), "right")
        return out
    return (mixed(h, salt) < g.row_share).astype(float) if g.row_share < 1 else np.ones(len(h))


#: Levels whose nodes are compared one by one; deeper ones look their node up.
WIDE_LEVELS = 5


def landed(tree: Tree, bins: np.ndarray, levels: int) -> np.ndarray:
    """The heap place each row has reached after ``levels`` levels; ``bins`` has a line for each column."""
    at = np.ones(bins.shape[1], np.uint8 if levels < 8 else np.int64)
    for level in range(levels):
        at = stepped(tree, bins, at, level)
    return at


def stepped(tree: Tree, bins: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
    """The places one level on, from those after ``level`` levels."""
    places = [q for q in range(1 << level, 2 << level) if tree.feature[q] >= 0]
    if not places:
        return at
    n = len(at)
    if level < WIDE_LEVELS:
        step = np.zeros(n, at.dtype)
        for q in places:  # from q to 2q, or to 2q + 1
            go = (bins[tree.feature[q]] > tree.cut[q]).view(np.uint8) + np.uint8(q)
            go *= (at == q).view(np.uint8)
            step += go
        return at + step
    feature, cut = np.array(tree.feature), np.array(tree.cut)
    f, deep = feature[at], at.astype(np.int64)
    right = bins[np.maximum(f, 0), np.arange(n)] > cut[at]
    return np.where(f >= 0, 2 * deep + right, deep).astype(at.dtype)


def binned(df: DataFrame, features: Sequence[str], label: str, key: str | None, bins: int = BINS) -> tuple[DataFrame, list[list[float]]]:
    """(rows (bins, label, h, margin), thresholds of each column): bin b of a column holds values up to its b-th threshold."""
    cols = [f"__{i}" for i in range(len(features))]
    by = [F.col(key)] if key else [*[F.col(c) for c in features], F.col(label)]
    x = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(n) for c, n in zip(features, cols)],
                  F.col(label).cast("double").alias("__y"), F.xxhash64(*by).alias("__h")).where("__y is not null and not isnan(__y)")
    probs = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)])
    found = x.agg(*[F.percentile_approx(c, probs, 100 * bins).alias(c) for c in cols], *[F.max(c).alias(f"m{c}") for c in cols]).first()
    edges = [sorted({v for v in (found[c] or []) if v < found[f"m{c}"]}) for c in cols]
    tables = [np.array(e) for e in edges]
    d = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, d), np.uint8)
            for i in range(d):
                v = batch.column(i).to_numpy(zero_copy_only=False).astype(float)
                out[:, i] = np.where(np.isnan(v), 0, np.searchsorted(tables[i], v, "left") + 1)
            flat = pa.py_buffer(np.ascontiguousarray(out))
            places = pa.py_buffer(np.arange(0, (batch.num_rows + 1) * d, d, dtype=np.int32)) if d else pa.py_buffer(np.zeros(batch.num_rows + 1, np.int32))
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, places, flat]), batch.column(d), batch.column(d + 1)],
                                             ["bins", "label", "h"])

    return x.select(*cols, "__y", "__h").mapInArrow(run, "bins binary, label double, h bigint"), edges


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt by their hash where the input has fewer partitions than there are cores."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, "h") if rows.rdd.getNumPartitions() < cores else rows


def columns_of(binary: pa.Array, d: int) -> np.ndarray:
    """The bytes of d-byte values, a line for each of the d places."""
    n = len(binary)
    if not n or not d:
        return np.zeros((d, n), np.uint8)
    wide = np.int64 if pa.types.is_large_binary(binary.type) else np.int32
    first = int(np.frombuffer(binary.buffers()[1], wide)[binary.offset])
    raw = np.frombuffer(binary.buffers()[2], np.uint8)[first:first + n * d]
    return np.ascontiguousarray(raw.reshape(n, d).T)


def chunks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(bins, label, h, margin) of about CHUNK rows at a time; bins with a line for each column."""
    held, n = [], 0

    def joined():
        table = pa.Table.from_batches(held).combine_chunks()
        return (columns_of(table.column(0).chunk(0), d), *(table.column(i).to_numpy() for i in range(1, table.num_columns)))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= CHUNK:
            yield joined()
            held, n = [], 0
    if held:
        yield joined()


# ------------------------------------------------------------------- cells

#: Cells up to which the sums of a task are kept by cell; their bytes in a task; trees that they are written for at once.
CELLS, CELL_BYTES, CELL_TREES = 1 << 16, 64 << 20, 256
#: Rows that a cell should have in each task.
CELL_ROWS = 8


@dataclass
class Cells:
    """Sums of the rows of equal bins: ``rows`` (bins, w, y, margin) hold, for each tree number from ``first`` on, the weights
    and the weighted labels about ``centre``; ``shared``: one sum for all trees, since none draws rows."""

    rows: DataFrame
    first: int
    centre: float
    shared: bool

    def at(self, number: int) -> int:
        return 0 if self.shared else number - self.first


def cell_tasks(rows: DataFrame) -> int:
    return 2 * rows.sparkSession.sparkContext.defaultParallelism


def cell_trees(n: int, cells: int, tasks: int, d: int, p: Growth) -> int:
    """For how many trees sums are kept by cell at once; 0 where the rows are read instead."""
    if not p.bootstrap and p.row_share >= 1:
        return CELL_TREES if cells * CELL_ROWS <= n else 0
    if d > 10 or cells > CELLS or cells * tasks * CELL_ROWS > n:
        return 0
    return max(1, min(CELL_TREES, CELL_BYTES // (16 * max(cells, 1))))


def summed(rows: DataFrame, numbers: Sequence[int], trees: list[Tree], start: float, centre: float, d: int, p: Growth, merged: bool = False) -> Cells:
    """The sums by cell for the trees of ``numbers``; a cell's margin is ``start`` and what ``trees`` add.  ``merged``: a row for each
    cell, not one from each task."""
    from legflow.session import written

    depth, first, many = p.depth, numbers[0], len(numbers)
    if not p.bootstrap and p.row_share >= 1:
        by = rows.groupBy("bins").agg(F.array(F.count(F.lit(1)).cast("double")).alias("w"), F.array(F.sum(F.col("label") - F.lit(centre))).alias("y"))
        cells = by.withColumn("margin", F.lit(float(start)))
        return Cells(written(cells, "cells"), first, centre, True)
    scale = 65 ** np.arange(d, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pd.Index(np.zeros(0, np.int64))
        places, w_sum, y_sum = np.zeros((d, 0), np.uint8), np.zeros((many, 0)), np.zeros((many, 0))
        for bins, label, h in chunks(batches, d):
            here, codes = pd.factorize(scale @ bins)
            at = known.get_indexer(codes)
            new = np.flatnonzero(at < 0)
            if len(new):
                at[new] = len(known) + np.arange(len(new))
                firsts = np.zeros(len(codes), np.int64)
                firsts[here[::-1]] = np.arange(len(here))[::-1]
                known, places = known.append(pd.Index(codes[new])), np.hstack([places, bins[:, firsts[new]]])
                if len(known) > w_sum.shape[1]:
                    more = np.zeros((many, max(len(known), 2 * w_sum.shape[1]) - w_sum.shape[1]))
                    w_sum, y_sum = np.hstack([w_sum, more]), np.hstack([y_sum, more])
            y, k = label - centre, len(codes)
            for i, number in enumerate(numbers):
                w = row_weights(h, p, number)
                w_sum[i, at] += np.bincount(here, w, k)
                w *= y
                y_sum[i, at] += np.bincount(here, w, k)
        margin = np.full(len(known), start)
        for t in trees:
            margin += np.array(t.value)[landed(t, places, depth)]
        yield from out(places, w_sum, y_sum, margin)

    def out(places: np.ndarray, w_sum: np.ndarray, y_sum: np.ndarray, margin: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, step = len(margin), max(1, (1 << 22) // many)
        for a in range(0, n, step):
            b = min(n, a + step)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * many, many, dtype=np.int32)), pa.array(np.ascontiguousarray(v[:, a:b].T).ravel()))
                     for v in (w_sum, y_sum)]
            offsets = pa.py_buffer(np.arange(0, (b - a + 1) * d, d, dtype=np.int32))
            binary = pa.Array.from_buffers(pa.binary(), b - a, [None, offsets, pa.py_buffer(np.ascontiguousarray(places[:, a:b].T))])
            yield pa.RecordBatch.from_arrays([binary, *lists, pa.array(margin[a:b])], ["bins", "w", "y", "margin"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = pd.Index(np.zeros(0, np.int64)), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            bins = columns_of(batch.column(0), d)
            by = np.argsort(codes := scale @ bins, kind="stable")
            firsts = np.flatnonzero(np.r_[True, np.diff(codes[by]) > 0])
            here = (bins[:, by[firsts]], *(np.add.reduceat(batch.column(i).flatten().to_numpy().reshape(n, many)[by], firsts).T for i in (1, 2)), batch.column(3).to_numpy()[by[firsts]])
            at = known.get_indexer(codes[by[firsts]])
            old, new = at >= 0, at < 0
            if held:
                for total, more in zip(held[1:3], here[1:3]):
                    total[:, at[old]] += more[:, old]
            known = known.append(pd.Index(codes[by[firsts]][new]))
            held = [np.concatenate([x, y[..., new]], axis=-1) for x, y in zip(held, here)] if held else [*here]
        if held:
            yield from out(*held)

    schema = "bins binary, w array<double>, y array<double>, margin double"
    dealt = rows.select("bins", "label", "h").coalesce(cell_tasks(rows))
    cells = dealt.mapInArrow(run, schema)
    if merged:
        cells = cells.repartition(rows.sparkSession.sparkContext.defaultParallelism, "bins").mapInArrow(joined, schema)
    return Cells(written(cells, "cells"), first, centre, False)


# ------------------------------------------------------------------- levels

def sums_of(rows: DataFrame, run, size: int) -> np.ndarray:
    """The sums (slot, [gradient, hessian]) that the tasks of ``run`` give."""
    got = (rows.mapInArrow(run, "slot bigint, g double, h double").groupBy("slot")
           .agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas())
    out = np.zeros((size, 2))
    out[got["slot"].to_numpy(np.int64)] = got[["g", "h"]].to_numpy(float)
    return out


def added(total: np.ndarray, at: np.ndarray, level: int, columns: Sequence[int], bins: np.ndarray, gradient: np.ndarray, w: np.ndarray | None) -> None:
    """The sums of rows of these places, gradients, weighted already, and weights (None: all one), in those of ``columns``."""
    nodes, wide = 1 << level, BINS + 1
    live = at >= nodes if w is None else w > 0 if not level else (at >= nodes) & (w > 0)
    base = at.astype(np.intp)
    base -= nodes
    base *= wide
    if not live.all():
        live = np.flatnonzero(live)
        if not len(live):
            return
        base, gradient, w, bins = base[live], gradient[live], None if w is None else w[live], bins[:, live]
    for f in columns:
        spot = base + bins[f]
        total[f, :, 0] += np.bincount(spot, gradient, nodes * wide)
        total[f, :, 1] += np.bincount(spot, w, nodes * wide)


def histograms(rows: DataFrame | Cells, trees: list[Tree], numbers: list[int], recent: list[Tree], level: int, d: int, g: Growth,
               wanted: Sequence[Sequence[int]]) -> np.ndarray:
    """Sums (tree, node, column, bin, [gradient, hessian]) of one level of all ``trees`` at squared loss, in the columns
    ``wanted`` of each.

    ``recent``: trees that the margins of the rows or cells do not hold yet.
    """
    nodes, wide, depth = 1 << level, BINS + 1, g.depth
    whole = not g.bootstrap and g.row_share >= 1
    cells = rows if isinstance(rows, Cells) else None
    spots, centre = ([cells.at(i) for i in numbers], cells.centre) if cells else ([], 0.0)

    def out(total: np.ndarray) -> pa.RecordBatch:
        flat = total.reshape(-1, 2)
        some = np.flatnonzero(flat[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(flat[some, 0]), pa.array(flat[some, 1])], ["slot", "g", "h"])

    def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(trees), d, nodes * wide, 2))
        for bins, label, h, margin in chunks(batches, d):
            for t in recent:
                margin = margin + np.array(t.value)[landed(t, bins, depth)]
            gradient = margin - label
            for k, (tree, number) in enumerate(zip(trees, numbers)):
                w = None if whole else row_weights(h, g, number)
                added(total[k], landed(tree, bins, level), level, wanted[k], bins, gradient if whole else gradient * w, w)
        yield out(total)

    def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(trees), d, nodes * wide, 2))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            bins, margin = columns_of(batch.column(0), d), batch.column(3).to_numpy() - centre
            for t in recent:
                margin = margin + np.array(t.value)[landed(t, bins, depth)]
            w, y = (batch.column(i).flatten().to_numpy().reshape(n, -1) for i in (1, 2))
            for k, (tree, at) in enumerate(zip(trees, spots)):
                mine = np.ascontiguousarray(w[:, at])
                added(total[k], landed(tree, bins, level), level, wanted[k], bins, margin * mine - y[:, at], mine)
        yield out(total)

    size = len(trees) * d * nodes * wide
    if cells:
        sums = sums_of(cells.rows.select("bins", "w", "y", "margin"), by_cell, size)
    else:
        sums = sums_of(rows.select("bins", "label", "h", "margin"), by_row, size)
    return sums.reshape(len(trees), d, nodes, wide, 2).transpose(0, 2, 1, 3, 4)


def shrunk(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def score(g, h, p: Growth):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(h + p.l2 > 0, shrunk(g, p.l1) ** 2 / (h + p.l2), 0.0)


def leaf(g: float, h: float, p: Growth) -> float:
    return float(-shrunk(g, p.l1) / (h + p.l2)) if h + p.l2 > 0 else 0.0


def split(tree: Tree, place: int, sums: np.ndarray, edges: list, allowed: Sequence[int], p: Growth, gains: np.ndarray) -> None:
    """Set the best split of one node from its histogram (column, bin, 2), or leave it a leaf; values of the children follow."""
    g, h = sums[allowed[0]].sum(axis=0)
    tree.value[place] = leaf(g, h, p)
    best = (1e-9, None)
    for f in allowed:
        left = np.cumsum(sums[f], axis=0)[1:len(edges[f]) + 1]
        if not len(left):
            continue
        gl, hl = left[:, 0], left[:, 1]
        ok = (hl >= p.min_child) & (h - hl >= p.min_child)
        gain = np.where(ok, score(gl, hl, p) + score(g - gl, h - hl, p) - score(g, h, p), -1.0)
        b = int(np.argmax(gain))
        if gain[b] > best[0]:
            best = (float(gain[b]), (f, b, gl[b], hl[b]))
    if best[1] is None:
        return
    f, b, gl, hl = best[1]
    tree.feature[place], tree.cut[place], tree.threshold[place] = f, b + 1, float(edges[f][b])
    tree.value[2 * place], tree.value[2 * place + 1] = leaf(gl, hl, p), leaf(g - gl, h - hl, p)
    gains[f] += best[0]


def grown(sums: Callable[[list[Tree], int, list[list[int]]], np.ndarray], numbers: Sequence[int], edges: list, p: Growth) -> tuple[list[Tree], np.ndarray]:
    """One tree for each number, level by level, and the gain of each column in each tree.  ``sums``: the histograms of a level
    (see there) of the trees so far, in each tree's columns."""
    d = len(edges)
    trees, gains = [Tree.empty(p.depth) for _ in numbers], np.zeros((len(numbers), d))
    drawn = [sorted(np.random.default_rng([p.seed, i]).permutation(d)[:max(1, int(p.tree_columns * d))].tolist()) for i in numbers]
    for level in range(p.depth):
        allowed: list[dict[int, list[int]]] = []  # of each tree's open nodes
        for tree, number, mine in zip(trees, numbers, drawn):
            places = [q for q in range(1 << level, 2 << level) if not level or tree.feature[q // 2] >= 0]
            some = p.node_columns and p.node_columns < len(mine)
            allowed.append({q: sorted(np.random.default_rng([p.seed, number, q]).permutation(mine)[:p.node_columns].tolist()) if some else mine for q in places})
        if not any(allowed):
            break
        got = sums(trees, level, [sorted({f for x in of.values() for f in x}) for of in allowed])
        for k, (tree, of) in enumerate(zip(trees, allowed)):
            for place, columns in of.items():
                split(tree, place, got[k, place - (1 << level)], edges, columns, p, gains[k])
    return trees, gains


def grown_by_jobs(rows: DataFrame | Cells, numbers: list[int], recent: list[Tree], edges: list, p: Growth) -> tuple[list[Tree], np.ndarray]:
    """``grown``, each level by a job over the rows or cells."""
    return grown(lambda trees, level, wanted: histograms(rows, trees, numbers, recent, level, len(edges), p, wanted), numbers, edges, p)


# ------------------------------------------------------------------- rounds in one task

#: Bytes of the rows or cells that one task holds to grow boosted trees, and those of a row beside its bins.
TASK_BYTES, ROW_BYTES = 96 << 20, 64


def fits_a_task(n: int, d: int) -> bool:
    return n * (d + ROW_BYTES) <= TASK_BYTES


def rounds_of(bins: np.ndarray, margin: np.ndarray, drawn: Callable[[int, np.ndarray], tuple], numbers: Sequence[int], edges: list, p: Growth,
              rate: float) -> tuple[list[Tree], np.ndarray]:
    """The boosted trees of ``numbers``, values scaled by ``rate``, and their gains, from rows or cells in memory.  ``drawn``: the
    gradients, weighted, and weights (None: all one) of a round at these margins."""
    d, trees, total = len(edges), [], np.zeros(len(edges))
    for number in numbers:
        gradient, w = drawn(number, margin)
        mine = bins
        if w is not None and not (live := w > 0).all():
            live = np.flatnonzero(live)
            mine, gradient, w = bins[:, live], gradient[live], w[live]
        at = np.ones(mine.shape[1], np.uint8 if p.depth < 8 else np.int64)

        def sums(grown_: list[Tree], level: int, wanted: list[list[int]]) -> np.ndarray:
            nonlocal at
            if level:
                at = stepped(grown_[0], mine, at, level - 1)
            out = np.zeros((d, (1 << level) * (BINS + 1), 2))
            added(out, at, level, wanted[0], mine, gradient, w)
            return out.reshape(1, d, 1 << level, BINS + 1, 2).transpose(0, 2, 1, 3, 4)

        (tree,), gains = grown(sums, [number], edges, p)
        tree.value = [rate * v for v in tree.value]
        margin = margin + np.array(tree.value)[landed(tree, bins, p.depth)]
        trees.append(tree)
        total += gains[0]
    return trees, total


def grown_in_a_task(source: DataFrame | Cells, numbers: Sequence[int], trees: list[Tree], start: float, centre: float, edges: list, p: Growth,
                    rate: float) -> tuple[list[Tree], np.ndarray]:
    """The boosted trees of ``numbers`` that follow ``trees``, and the gain of each column, from one task that holds all of ``source``:
    rows, worked by cell where these are few, or cells, whose margins may hold ``trees`` already."""
    d, depth, whole = len(edges), p.depth, not p.bootstrap and p.row_share >= 1
    cells = isinstance(source, Cells)
    spots, shared = {i: source.at(i) for i in numbers} if cells else {}, cells and source.shared  # a task gets these, not the table

    def walked(margin: np.ndarray, bins: np.ndarray) -> np.ndarray:
        for t in trees:
            margin = margin + np.array(t.value)[landed(t, bins, depth)]
        return margin

    def said(got: tuple[list[Tree], np.ndarray]) -> pa.RecordBatch:
        state = json.dumps([[[t.feature, t.threshold, t.cut, t.value] for t in got[0]], got[1].tolist()])
        return pa.RecordBatch.from_arrays([pa.array([state])], ["state"])

    def by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(chunks(batches, d))
        bins = np.hstack([x[0] for x in parts])
        label, h = (np.concatenate([x[i] for x in parts]) for i in (1, 2))
        del parts
        n = len(label)
        here, codes = pd.factorize(65 ** np.arange(d, dtype=np.int64) @ bins) if d <= 10 else (None, ())
        if here is None or len(codes) * CELL_ROWS > n:
            def drawn(number, margin):
                w = None if whole else row_weights(h, p, number)
                return (margin - label, None) if whole else ((margin - label) * w, w)

            yield said(rounds_of(bins, walked(np.full(n, start), bins), drawn, numbers, edges, p, rate))
            return
        k, y = len(codes), label - centre
        firsts = np.zeros(k, np.int64)
        firsts[here[::-1]] = np.arange(n)[::-1]
        places = np.ascontiguousarray(bins[:, firsts])
        of_all = (np.bincount(here, None, k).astype(float), np.bincount(here, y, k)) if whole else None

        def drawn(number, margin):
            if whole:
                w, y_sum = of_all
            else:
                w = row_weights(h, p, number)
                w, y_sum = np.bincount(here, w, k), np.bincount(here, w * y, k)
            return (margin - centre) * w - y_sum, w

        yield said(rounds_of(places, walked(np.full(k, start), places), drawn, numbers, edges, p, rate))

    def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(columns_of(x.column(0), d), *(x.column(i).flatten().to_numpy().reshape(x.num_rows, -1) for i in (1, 2)), x.column(3).to_numpy())
                 for x in batches if x.num_rows]
        bins, margin = np.hstack([x[0] for x in parts]), np.concatenate([x[3] for x in parts])
        w, y = (np.ascontiguousarray(np.concatenate([x[i] for x in parts]).T) for i in (1, 2))
        del parts

        def drawn(number, margin):
            at = spots[number]
            return (margin - centre) * w[at] - y[at], w[at]

        yield said(rounds_of(bins, walked(margin, bins) if shared else margin, drawn, numbers, edges, p, rate))

    if cells:
        found = source.rows.select("bins", "w", "y", "margin").coalesce(1).mapInArrow(by_cell, "state string")
    else:
        found = source.select("bins", "label", "h").coalesce(1).mapInArrow(by_row, "state string")
    some, gains = json.loads(found.first()[0])
    return [Tree(*t) for t in some], np.array(gains)


# ------------------------------------------------------------------- models

@dataclass
class EnsembleModel(Fitted):
    """A base value plus the value of the leaf that a row reaches in each tree."""

    features: list[str]
    base: float
    depth: int
    trees: list[Tree] = field(default_factory=list)
    importances: list[float] = field(default_factory=list)
    kind = "trees"

    @property
    def stages(self) -> list:
        return [self]

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802  the name that tree models of the ML library have
        return DenseVector(self.importances)

    def state(self) -> dict:
        return dict(features=self.features, base=self.base, depth=self.depth, importances=self.importances,
                    trees=[[t.feature, t.threshold, t.cut, t.value] for t in self.trees])

    @classmethod
    def of(cls, state: dict) -> EnsembleModel:
        return cls(state["features"], state["base"], state["depth"], [Tree(*t) for t in state["trees"]], state["importances"])

    def column(self):
        """The prediction as a column, worked out in Arrow batches."""
        d, depth, base = len(self.features), self.depth, self.base
        found: list[set] = [set() for _ in range(d)]
        for t in self.trees:
            for f, v in zip(t.feature, t.threshold):
                if f >= 0:
                    found[f].add(v)
        tables = [np.array(sorted(x), float) for x in found]
        kind = np.uint8 if max((len(x) for x in tables), default=0) < 256 else np.int32
        # a value beyond a threshold lies in a bin beyond that threshold's place
        trees = [Tree(t.feature, t.threshold, [int(np.searchsorted(tables[f], v)) if f >= 0 else 0 for f, v in zip(t.feature, t.threshold)], t.value)
                 for t in self.trees]

        @F.pandas_udf("double")
        def predicted(*cols: pd.Series) -> pd.Series:
            n = len(cols[0])
            bins = np.zeros((d, n), kind)
            for f, c in enumerate(cols):
                x = c.to_numpy(float, na_value=np.nan)
                bins[f] = np.where(np.isnan(x), 0, np.searchsorted(tables[f], x, "left"))
            out = np.full(n, base)
            for t in trees:
                out += np.array(t.value)[landed(t, bins, depth)]
            return pd.Series(out)

        return predicted(*[F.col(c).cast("double") for c in self.features])

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        return df.withColumn(prediction, self.column())


def _progress(spark: SparkSession, folder: str):
    """The last saved state of a run, or None."""
    try:
        return spark.read.parquet(f"{folder}/trees").orderBy(F.desc("round")).first()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def counted(rows: DataFrame) -> tuple[float | None, int, int]:
    """(mean label, rows, cells by estimate)."""
    r = rows.agg(F.avg("label").alias("mean"), F.count(F.lit(1)).alias("n"), F.approx_count_distinct("bins", 0.02).alias("cells")).first()
    return r["mean"], r["n"], r["cells"]


#: Boosting rounds that sums by cell are written for at once.
BOOST_TREES = 32


def boosted(df: DataFrame, features: Sequence[str], label: str = "label", rounds: int = 500, rate: float = 0.1, growth: Growth | None = None,
            base: float | None = None, key: str | None = None, folder: str | None = None, every: int = 10) -> EnsembleModel:
    """``rounds`` trees, each fitted to what the ones before leave, scaled by ``rate``.  ``base`` None is the label's mean.

    With a ``folder`` (shared by driver and executors) the run resumes there; only its last two written states are kept.
    """
    spark, p, resumes = df.sparkSession, growth or Growth(), folder is not None
    folder = folder or checkpoint_path(spark, f"boosted-{uuid.uuid4().hex}")
    saved = _progress(spark, folder) if resumes else None
    if saved is None:
        rows, edges = binned(df, features, label, key)
        spread(rows).write.mode("overwrite").parquet(f"{folder}/binned")
        rows = spark.read.parquet(f"{folder}/binned")
        mean, n, cells = counted(rows)
        start = (0.0 if mean is None else float(mean)) if base is None else base
        model, gains = EnsembleModel(list(features), start, p.depth), np.zeros(len(features))
        if mean is None:
            model.importances = gains.tolist()
            return model
        alone = fits_a_task(n, len(edges))
        many = 0 if alone else cell_trees(n, cells, cell_tasks(rows), len(edges), p)
        rows = rows.withColumn("margin", F.lit(start))
    else:
        state = json.loads(saved["state"])
        model, edges, gains = EnsembleModel.of(state["model"]), state["edges"], np.array(state["gains"])
        alone, many, mean, start = state.get("alone", False), state.get("many", 0), state.get("mean"), model.base
        rows = spark.read.parquet(f"{folder}/binned" if alone or many else f"{folder}/margins-{saved['round'] // every % 2}")
    shared, small = None, bool(many)
    if many and not p.bootstrap and p.row_share >= 1 and len(model.trees) < rounds:
        shared = summed(rows, [0], [], start, mean, len(edges), p)
        small = fits_a_task(shared.rows.count(), len(edges))
    r = written_at = len(model.trees)
    while r < rounds:
        most = min(rounds, r - r % every + every if resumes else rounds)
        if alone or small:
            numbers = range(r, most if alone or shared else min(most, r + min(many, BOOST_TREES)))
            source = rows if alone else shared or summed(rows, numbers, model.trees, start, mean, len(edges), p, merged=True)
            trees, more = grown_in_a_task(source, numbers, model.trees, start, mean, edges, p, rate)
        else:
            # cells hold no tree yet
            trees, more = grown_by_jobs(shared or rows, [r], model.trees if shared else model.trees[written_at:], edges, p)
            more = more[0]
            for t in trees:
                t.value = [rate * v for v in t.value]
        model.trees += trees
        gains, r = gains + more, r + len(trees)
        if r % every == 0 and r < rounds:
            slot = f"{folder}/margins-{r // every % 2}"
            by_row = not (alone or many)
            if by_row:
                _added(rows, model.trees[written_at:], len(edges), p.depth).write.mode("overwrite").parquet(slot)
            if resumes:
                state = json.dumps(dict(model=model.state(), edges=edges, gains=gains.tolist(), alone=alone, many=many, mean=mean))
                spark.createDataFrame([(r, state)], "round int, state string").coalesce(1).write.mode("append").parquet(f"{folder}/trees")
            if by_row:
                rows, written_at = spark.read.parquet(slot), r
    model.trees = model.trees[:rounds]
    model.importances = (gains / gains.sum() if gains.sum() else gains).tolist()
    return model


def _added(rows: DataFrame, trees: list[Tree], d: int, depth: int) -> DataFrame:
    """``rows`` with the trees' values added to the margins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bins, label, h, margin in chunks(iter([batch]), d):
                for t in trees:
                    margin = margin + np.array(t.value)[landed(t, bins, depth)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label), pa.array(h), pa.array(margin)], ["bins", "label", "h", "margin"])

    return rows.select("bins", "label", "h", "margin").mapInArrow(run, "bins binary, label double, h bigint, margin double")


def forest(df: DataFrame, features: Sequence[str], label: str = "label", trees: int = 500, depth: int = 4, seed: int = 0, key: str | None = None,
           node_columns: int | None = None) -> EnsembleModel:
    """The mean of ``trees`` trees on bootstrap samples; BLOCK trees grow in each pass over the rows, more by cells."""
    from legflow.session import written

    p = Growth(depth=depth, bootstrap=True, seed=seed, node_columns=node_columns)
    rows, edges = binned(df, features, label, key)
    rows = written(spread(rows), "binned")
    mean, n, cells = counted(rows)
    model, shares = EnsembleModel(list(features), 0.0 if mean is None else float(mean), depth), np.zeros(len(features))
    if mean is not None:
        many = cell_trees(n, cells, cell_tasks(rows), len(edges), p)
        for a in range(0, trees, many or BLOCK):
            numbers = list(range(a, min(a + (many or BLOCK), trees)))
            source = summed(rows, numbers, [], float(mean), float(mean), len(edges), p) if many else rows.withColumn("margin", F.lit(float(mean)))
            some, gains = grown_by_jobs(source, numbers, [], edges, p)
            for t, g in zip(some, gains):
                t.value = [v / trees for v in t.value]
                shares += g / g.sum() if g.sum() else 0
            model.trees += some
    model.importances = (shares / shares.sum() if shares.sum() else shares).tolist()
    return model


@dataclass
class StackedModel(Fitted):
    """Linear base models whose predictions feed an ensemble."""

    bases: dict[str, tuple[list[str], list[float], float]]
    meta: EnsembleModel
    kind = "stacked"

    def state(self) -> dict:
        return dict(bases=self.bases, meta=self.meta.state())

    @classmethod
    def of(cls, state: dict) -> StackedModel:
        return cls(state["bases"], EnsembleModel.of(state["meta"]))

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        base = {f"p_{n}": sum([F.col(c).cast("double") * F.lit(float(w)) for c, w in zip(cols, ws)], F.lit(float(b)))
                for n, (cols, ws, b) in self.bases.items()}
        return self.meta.transform(df.withColumns(base), prediction)
