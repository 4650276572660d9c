"""Exact order statistics without gathering a group into one task.

``value_ranks`` turns long-form (group, value) rows into distinct values with
their count and the number of smaller values in the group.  Equal values
collapse in a map-side-combined aggregation, the distinct values are
range-partitioned (balanced, since they are unique), each partition computes
running counts on its own slice, and per-partition totals (as many rows as
partitions x groups, a fixed bound) give the offsets.  Quantiles with linear
interpolation (pandas / numpy default) and average ranks (Spearman) follow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legflow.session import ensure_checkpoint_dir

UNB = Window.unboundedPreceding


def value_ranks(long: DataFrame, group: str, value: str, weight: str | None = None) -> DataFrame:
    """(group, value, cnt, below, n): ``below`` = rows of the group with a smaller
    value, ``n`` = non-null rows of the group.  NULL values are ignored.
    ``weight`` names a column that says how many rows a row stands for."""
    n_rows = F.sum(weight) if weight else F.count(F.lit(1))
    counts = long.where(F.col(value).isNotNull()).groupBy(group, value).agg(n_rows.alias("cnt"))
    ensure_checkpoint_dir(long.sparkSession)
    # written once: two evaluations of a sampled range exchange need not agree on partition numbers
    ranged = counts.repartitionByRange(group, value).withColumn("__pid", F.spark_partition_id()).checkpoint()
    w_in = Window.partitionBy("__pid", group).orderBy(value).rowsBetween(UNB, 0)
    local = ranged.withColumn("__cum", F.sum("cnt").over(w_in))
    totals = local.groupBy("__pid", group).agg(F.max("__cum").alias("__tot"))
    w_off = Window.partitionBy(group).orderBy("__pid")
    offsets = totals.select("__pid", group,
                            F.coalesce(F.sum("__tot").over(w_off.rowsBetween(UNB, -1)), F.lit(0)).alias("__off"),
                            F.sum("__tot").over(Window.partitionBy(group)).alias("n"))
    out = local.join(F.broadcast(offsets), ["__pid", group])
    return out.select(group, value, "cnt", (F.col("__off") + F.col("__cum") - F.col("cnt")).alias("below"), "n")


def quantiles(long: DataFrame, group: str, value: str, probs: Sequence[float], weight: str | None = None) -> DataFrame:
    """(group, q, quantile): exact, linear interpolation between order statistics."""
    ranks = value_ranks(long, group, value, weight)
    # 0-based position h = (n - 1) q; need the values at floor(h) and floor(h) + 1.
    qs = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("q")
    cand = ranks.select("*", qs).withColumn("__h", (F.col("n") - 1) * F.col("q"))
    lo_pos = F.floor("__h")
    hi_pos = F.least(lo_pos + 1, F.col("n") - 1)
    covers = lambda pos: (F.col("below") <= pos) & (pos < F.col("below") + F.col("cnt"))
    picked = cand.where(covers(lo_pos) | covers(hi_pos))
    agg = picked.groupBy(group, "q").agg(
        F.max(F.when(covers(lo_pos), F.col(value))).alias("__lo"),
        F.max(F.when(covers(hi_pos), F.col(value))).alias("__hi"),
        F.first("__h").alias("__h"))
    frac = F.col("__h") - F.floor("__h")
    return agg.select(group, "q", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * frac).alias("quantile"))


def wide_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(column, q, quantile) for numeric ``cols`` of a wide frame."""
    long = df.select([F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
    return quantiles(long, "column", "value", probs)


#: A sketched rank is at most this share of the rows away from the true one.
SKETCH = 1e-4


def bracketed_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[tuple[str, float], float]:
    """{(column, q): quantile}, the values of ``wide_quantiles``, without a group for each distinct value.

    A sketch of bounded size gives two values around each quantile; the rows
    below them are counted and only those between them are ranked, which are
    some ten-thousandths of the rows beside the repeats of two values.
    """
    at = [f"__{i}" for i in range(len(cols))]
    x = df.select([F.col(c).cast("double").alias(n) for c, n in zip(cols, at)])
    marks = F.array(*[F.lit(float(min(1.0, max(0.0, p + 2 * s * SKETCH)))) for p in probs for s in (-1, 1)])
    r = x.agg(*[a for n in at for a in (F.count(n).alias(f"n{n}"), F.count_if(F.isnan(n)).alias(f"nan{n}"),
                                         F.percentile_approx(n, marks, round(1 / SKETCH)).alias(f"s{n}"))]).first()
    if any(r[f"nan{n}"] for n in at):  # sketches do not order NaN
        return {(g["column"], g["q"]): g["quantile"] for g in wide_quantiles(df, cols, probs).collect()}  # a row for each column and quantile
    brackets = {f"{i}:{j}": (n, r[f"s{n}"][2 * j], r[f"s{n}"][2 * j + 1], (r[f"n{n}"] - 1) * float(p))
                for i, n in enumerate(at) if r[f"n{n}"] for j, p in enumerate(probs)}
    if not brackets:
        return {}
    counted = x.agg(*[a for g, (n, low, high, _) in brackets.items()
                      for a in (F.count_if(F.col(n) < low).alias(f"b{g}"), F.count_if(F.col(n) <= high).alias(f"u{g}"))]).first()
    targets = []
    for g, (n, _, _, h) in brackets.items():
        low, high = int(h), min(int(h) + 1, r[f"n{n}"] - 1)
        if not counted[f"b{g}"] <= low <= high < counted[f"u{g}"]:  # the sketch missed
            return {(g["column"], g["q"]): g["quantile"] for g in wide_quantiles(df, cols, probs).collect()}
        targets.append((g, low - counted[f"b{g}"], high - counted[f"b{g}"]))
    inside = [F.when(F.col(n).between(low, high), F.struct(F.lit(g).alias("g"), F.col(n).alias("v"))) for g, (n, low, high, _) in brackets.items()]
    long = x.select(F.explode(F.filter(F.array(*inside), lambda v: v.isNotNull())).alias("v")).select("v.g", "v.v")
    ranks = value_ranks(long, "g", "v").join(F.broadcast(df.sparkSession.createDataFrame(targets, "g string, low bigint, high bigint")), "g")
    covers = lambda pos: (F.col("below") <= pos) & (pos < F.col("below") + F.col("cnt"))
    low, high = F.when(covers(F.col("low")), F.col("v")), F.when(covers(F.col("high")), F.col("v"))
    out = {}
    for row in ranks.where(low.isNotNull() | high.isNotNull()).groupBy("g").agg(F.max(low).alias("lo"), F.max(high).alias("hi")).collect():
        i, j = map(int, row["g"].split(":"))
        h = brackets[row["g"]][3]
        out[cols[i], probs[j]] = row["lo"] + (row["hi"] - row["lo"]) * (h - int(h))
    return out


def average_ranks(long: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, avg_rank): 1-based rank, ties get the mean of their ranks."""
    r = value_ranks(long, group, value)
    return r.select(group, value, (F.col("below") + (F.col("cnt") + 1) / 2.0).alias("avg_rank"))
