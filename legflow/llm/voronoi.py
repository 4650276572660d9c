"""Exact top-k inner products by a Voronoi-partitioned join.

Vectors become whole numbers, floor(64 * x) by component.  A bounded sample
of them are pivots, as many as the square root of the rows (at least
``PIVOTS``, at most ``PIVOTS_MOST``); every vector belongs to the cell of its
nearest pivot.  Summaries of the cells (rows, radius) are a row each.  A cell
of more than ``BLOCK`` rows is split into blocks, so one cell may hold most
rows.

1. Every query is solved in its own cell; the k-th best score there is its bound.
2. Every other cell can reach at most q.p + |q| * r for a query q, its pivot
   p and radius r.  The query is replicated only to cells whose reach is at
   least its bound, and solved there.

Queries are the replicated side because they are fewer.  A task holds one
block of data and reads its queries as a stream, and returns at most k rows
a query.

Ties go to the smaller vec_id.  Vectors that are null, or hold null or
non-finite components, take no part.  Shorter vectors count as padded with
zeros.  Rows with a null vec_id take no part either.  Repeated rows are rows
of their own: each is a query if its id is, and only the very row is left out
of its own answers.  Fewer than k others give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legflow.llm.shared import cut

SCALE = 64
PIVOTS = 64
#: Pivots and cell summaries go to the driver and every task; this bounds them.
PIVOTS_MOST = 4096
BLOCK = 8192
#: Queries whose scores against a block are computed at once, and rows whose distances to the pivots are.
CHUNK = 256
WIDTHS = [np.dtype("<i1"), np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8")]


def packed(v: np.ndarray) -> bytes:
    """A whole-number vector in the narrowest width that holds it; the first byte names the width."""
    top = int(np.abs(v).max()) if len(v) else 0
    code = next(i for i, bits in enumerate((7, 15, 31, 64)) if top < 1 << bits)
    return bytes([code]) + v.astype(WIDTHS[code]).tobytes()


def unpacked(rows: list) -> np.ndarray:
    vectors = [np.frombuffer(r, WIDTHS[r[0]], offset=1) for r in rows]
    out = np.zeros((len(vectors), max((len(v) for v in vectors), default=0)))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, d - x.shape[1]))) if x.shape[1] < d else x for x in (a, b))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as int64; in floating point only where that is exact."""
    a, b = same_width(a, b)
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2.0 ** 53:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return (a @ b.T).astype(np.int64)


def whole(vectors: DataFrame, wanted: Column) -> DataFrame:
    """(uid, vec_id, v, is_query) of the vectors that take part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            keep, out = [], []
            for i, x in enumerate(lists):
                if not x.is_valid or not batch.column(0)[i].is_valid:
                    continue
                v = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)
                if x.values.null_count == 0 and np.isfinite(v).all():
                    keep.append(i)
                    out.append(packed(np.floor(SCALE * v).astype(np.int64)))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(2).take(at), batch.column(0).take(at), pa.array(out, pa.binary()),
                                              batch.column(3).take(at)], ["uid", "vec_id", "v", "is_query"])

    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"),
                          F.monotonically_increasing_id().alias("uid"), F.coalesce(wanted, F.lit(False)).alias("is_query"))
    return cut(rows.mapInArrow(run, "uid bigint, vec_id bigint, v binary, is_query boolean"))


def pivots_for(n: int) -> int:
    """Pivots for ``n`` rows."""
    return min(max(PIVOTS, isqrt(n)), PIVOTS_MOST)


def assigned(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` with the cell (nearest pivot, first at ties) and the distance to its pivot."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                x, p = same_width(unpacked(part.column(2).to_pylist()), sent.value)
                far = (x * x).sum(axis=1)[:, None] - 2 * (x @ p.T) + (p * p).sum(axis=1)[None, :]
                cell = far.argmin(axis=1)
                away = np.sqrt(((x - p[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(away)],
                                                 ["uid", "vec_id", "v", "is_query", "cell", "away"])

    return rows.mapInArrow(run, "uid bigint, vec_id bigint, v binary, is_query boolean, cell int, away double")


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of each row's k largest scores, ties to the smaller column (at most k + 1 columns: all)."""
    n = scores.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), scores.shape)
    if np.abs(scores).max() < (1 << 62) // n:
        return np.argpartition(np.arange(n)[None, :] - scores * n, k - 1, axis=1)[:, :k]
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def solved(data: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(quid, query_id, uid, vec_id, score): each query's k best rows of each block it is sent to, at least ``bound``.

    Both sides have cell and block; a task gets a block's data first, then its queries.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block, asked = None, [], None, []

        def answer():
            nonlocal block
            if not asked or not held:
                asked.clear()
                return
            if block is None:
                held.sort(key=lambda r: (r[1], r[0]))
                block = (np.array([r[0] for r in held]), np.array([r[1] for r in held]), unpacked([r[2] for r in held]))
            uid, vec, x = block
            s = products(unpacked([r[2] for r in asked]), x)
            cols = best(s, k + 1)
            top = np.take_along_axis(s, cols, axis=1)
            quid = np.array([r[0] for r in asked])[:, None]
            ok = (uid[cols] != quid) & (top >= np.array([r[3] for r in asked])[:, None])
            q, c = np.nonzero(ok)
            ids = np.array([r[1] for r in asked])
            asked_uid = quid[:, 0][q]
            asked.clear()
            yield pa.RecordBatch.from_arrays([pa.array(asked_uid), pa.array(ids[q]), pa.array(uid[cols[q, c]]),
                                              pa.array(vec[cols[q, c]]), pa.array(top[q, c])],
                                             ["quid", "query_id", "uid", "vec_id", "score"])

        for batch in batches:
            for cell, part, side, uid, vec, v, bound in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if (cell, part) != now:
                    yield from answer()
                    now, held, block = (cell, part), [], None
                if side == 0:
                    held.append((uid, vec, v))
                else:
                    asked.append((uid, vec, v, bound))
                    if len(asked) >= CHUNK:
                        yield from answer()
        yield from answer()

    cols = ["cell", "block", "side", "uid", "vec_id", "v", "bound"]
    rows = (data.withColumn("side", F.lit(0)).withColumn("bound", F.lit(None).cast("bigint")).select(cols)
            .unionByName(queries.withColumn("side", F.lit(1)).select(cols)))
    return (rows.repartition("cell", "block").sortWithinPartitions("cell", "block", "side")
            .mapInArrow(run, "quid bigint, query_id bigint, uid bigint, vec_id bigint, score bigint"))


LEAST = -(1 << 63)


def top_k(vectors: DataFrame, wanted: Column, k: int = 20, n_pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every row where ``wanted`` holds.

    Without ``n_pivots`` their number follows the rows; the answers are the same for any number.
    """
    rows = whole(vectors, wanted)
    spark = vectors.sparkSession
    if n_pivots is None:
        n_pivots = pivots_for(rows.count())
    sample = rows.select("v").orderBy(F.xxhash64("uid"), "uid").limit(4 * n_pivots).collect()
    pivots = unpacked(list(dict.fromkeys(bytes(r.v) for r in sample))[:n_pivots])
    if not len(pivots):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    rows = cut(assigned(rows, pivots))
    cells = {r.cell: (r.n, r.far) for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("far")).collect()}
    blocks = F.broadcast(spark.createDataFrame([(c, -(-n // block)) for c, (n, _) in cells.items()], "cell int, blocks bigint"))
    data = rows.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("uid"), "blocks"))
    queries = rows.filter("is_query")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    own = queries.join(blocks, "cell").withColumn("block", every).withColumn("bound", F.lit(LEAST))
    first = cut(solved(data, own, k))
    order = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id", "uid")
    near = first.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)
    bounds = near.groupBy("quid").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    bounded = (queries.join(bounds.withColumnRenamed("quid", "uid"), "uid", "left")
               .select("uid", "vec_id", "v", "cell", F.when(F.col("n") >= k, F.col("low")).otherwise(F.lit(LEAST)).alias("bound")))
    sent = spark.sparkContext.broadcast((pivots, np.array([cells.get(c, (0, -1.0))[1] for c in range(len(pivots))])))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, radius = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                q, pp = same_width(unpacked(part.column(2).to_pylist()), p)
                size = np.sqrt((q * q).sum(axis=1))
                most = q @ pp.T + size[:, None] * radius[None, :]
                most += 1e-9 * np.abs(most) + 1e-6  # the bound is rounded up
                low = part.column(4).to_numpy().astype(np.float64)
                need = (most >= low[:, None]) & (radius >= 0)[None, :]
                need[np.arange(len(q)), part.column(3).to_numpy()] = False
                at, cell = np.nonzero(need)
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(at) for i in (0, 1, 2)), pa.array(cell.astype(np.int32)),
                                                  part.column(4).take(at)], ["uid", "vec_id", "v", "cell", "bound"])

    others = (bounded.mapInArrow(reach, "uid bigint, vec_id bigint, v binary, cell int, bound bigint")
              .join(blocks, "cell").withColumn("block", every))
    second = solved(data, others, k)
    return (near.select("quid", "query_id", "uid", "vec_id", "score").unionByName(second)
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
