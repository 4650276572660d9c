"""Profiling and report tables (the tables behind the reference's charts).

Survey rows A1..A26.  Wide profiles are one aggregation over all columns, or
an ``unpivot`` to long form followed by one grouped aggregation; never a job
per column.  Top-k cuts always carry a key tie-break.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legflow.operators.clean import columns_of_kind, is_missing
from legflow.operators.graph import components
from legflow.operators.quantiles import average_ranks, wide_quantiles

UNB = Window.unboundedPreceding
# Haul segments by block minutes, half-open.
HAUL_SEGMENTS = [("30min-3h", 30, 180), ("3-6h", 180, 360), ("> 6h", 360, None)]
# Percentage-error bins (upper bounds) and the open last bin.
PERC_ERROR_EDGES = [2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 50, 100]


def _n() -> Column:
    return F.count(F.lit(1))


def as_text_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value) with every value as text (NULL kept)."""
    return df.select([F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")


def column_profile(df: DataFrame, sample_size: int = 5, salt_buckets: int = 64) -> DataFrame:
    """A1: per column its type, non-null count, distinct count (NULL counted as a
    value), missing percentage and the ``sample_size`` smallest distinct values.

    Distinct values come from one long-form aggregation; the sample is a
    two-level top-k (per value-hash bucket, then per column) so no task sorts
    all distinct values of a column."""
    cols = df.columns
    total = df.agg(_n().alias("n"), *[F.count(c).alias(c) for c in cols]).first().asDict()
    distinct = as_text_long(df, cols).groupBy("column", "value").agg(_n().alias("cnt"))
    stats = distinct.groupBy("column").agg(_n().alias("n_distinct"))
    w1 = Window.partitionBy("column", "__b").orderBy("value")
    w2 = Window.partitionBy("column").orderBy("value")
    sample = (distinct.where(F.col("value").isNotNull())
              .withColumn("__b", F.pmod(F.xxhash64("value"), F.lit(salt_buckets)))
              .withColumn("__r", F.row_number().over(w1)).where(F.col("__r") <= sample_size)
              .withColumn("__r", F.row_number().over(w2)).where(F.col("__r") <= sample_size)
              .groupBy("column").agg(F.array_join(F.sort_array(F.collect_list("value")), "|").alias("sample_values")))
    spark = df.sparkSession
    meta = spark.createDataFrame(
        [(c, df.schema[c].dataType.simpleString(), int(total[c]),
          float(total["n"] - total[c]) * 100.0 / total["n"] if total["n"] else None) for c in cols],
        "column string, type string, n_non_null long, missing_pct double")
    return meta.join(stats, "column", "left").join(sample, "column", "left")


def numeric_describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A2: transposed describe: count, mean, std (sample), min, 25/50/75 % (exact,
    linear), max per numeric column."""
    cols = list(cols) if cols is not None else columns_of_kind(df, "numeric")
    long = df.select([F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    base = long.groupBy("column").agg(F.count("value").alias("count"), F.avg("value").alias("mean"),
                                      F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                      F.max("value").alias("max"))
    q = wide_quantiles(df, cols, [0.25, 0.5, 0.75]).groupBy("column").pivot("q", [0.25, 0.5, 0.75]).agg(
        F.first("quantile"))
    q = q.withColumnsRenamed({"0.25": "p25", "0.5": "p50", "0.75": "p75"})
    return base.join(q, "column", "left")


def missing_percentages(df: DataFrame) -> DataFrame:
    """A3: (column, missing_pct) for columns with missing values, descending."""
    cols = df.columns
    wide = df.agg(*[(F.avg(is_missing(df, c).cast("double")) * 100).alias(c) for c in cols])
    long = wide.unpivot([], cols, "column", "missing_pct")
    return long.where(F.col("missing_pct") > 0).orderBy(F.col("missing_pct").desc(), "column")


def row_count(df: DataFrame) -> int:
    return df.count()


def top_value_shares(df: DataFrame, col: str, k: int = 5) -> DataFrame:
    """A4: the k most frequent values and their share of **all** rows (NULL is not a value)."""
    total = row_count(df)
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(_n().alias("n"))
    return (counts.orderBy(F.col("n").desc(), F.col(col)).limit(k)
            .select(F.col(col).alias("value"), "n", (F.col("n") * 100.0 / F.lit(total)).alias("pct")))


class RareCategoryBinner:
    """A5: categories with less than ``min_pct`` % of the non-null values become
    ``other``.  ``fit`` keeps the frequent list; it has at most 100 / min_pct
    entries, a proven bound, so it is applied as literals."""

    def __init__(self, col: str, min_pct: float = 1.0, other: str = "other"):
        self.col, self.min_pct, self.other = col, min_pct, other
        self.frequent: list | None = None

    def fit(self, df: DataFrame) -> RareCategoryBinner:
        present = df.where(F.col(self.col).isNotNull())
        total = present.count()
        counts = present.groupBy(self.col).agg(_n().alias("n"))
        # share >= min_pct: at most 100 / min_pct rows reach the driver
        rows = counts.where(F.col("n") * 100.0 >= F.lit(self.min_pct * total)).select(self.col).collect()
        self.frequent = sorted(r[0] for r in rows)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        c = F.col(self.col)
        keep = c.isin(*self.frequent) if self.frequent else F.lit(False)
        return df.withColumn(self.col, F.when(c.isNull() | keep, c).otherwise(F.lit(self.other)))


def delayed_counts(df: DataFrame, code: str = "delay_code") -> DataFrame:
    """A6."""
    return df.agg(F.count_if(F.col(code).isNotNull()).alias("delayed"),
                  F.count_if(F.col(code).isNull()).alias("not_delayed"))


def time_distribution(df: DataFrame, col: str = "flight_date") -> DataFrame:
    """Counts per year, per month and per weekday (Monday = 0), one pass
    (GROUPING SETS); long form (part, value, n)."""
    t = df.select(F.year(col).alias("year"), F.month(col).alias("month"), F.weekday(col).alias("weekday"))
    g = t.groupingSets([["year"], ["month"], ["weekday"]], "year", "month", "weekday").agg(
        _n().alias("n"), F.grouping_id().alias("__gid"))
    part = F.when(F.col("__gid") == 3, "year").when(F.col("__gid") == 5, "month").otherwise("weekday")
    value = F.coalesce(F.when(F.col("__gid") == 3, F.col("year")), F.when(F.col("__gid") == 5, F.col("month")),
                       F.col("weekday"))
    return g.select(part.alias("part"), value.alias("value"), "n")


def delay_by_hour(df: DataFrame, time_col: str = "scheduled_departure_date",
                  minutes_col: str = "delay_minutes") -> DataFrame:
    """Rows with delay minutes: count and mean per scheduled hour."""
    d = df.where(F.col(minutes_col).isNotNull())
    return d.groupBy(F.hour(time_col).alias("hour")).agg(F.count(minutes_col).alias("n_delays"),
                                                         F.avg(minutes_col).alias("mean_delay"))


def delay_weekday_month(df: DataFrame, date_col: str = "flight_date", code: str = "delay_code") -> DataFrame:
    """Delayed legs, weekday (rows) x month (columns 1..12), empty = 0."""
    d = df.where(F.col(code).isNotNull()).withColumn("__m", F.month(date_col))
    return (d.groupBy(F.weekday(date_col).alias("weekday"))
            .pivot("__m", list(range(1, 13))).agg(_n()).fillna(0))


def delay_code_proportions(df: DataFrame, origin: str = "origin_airport", code: str = "delay_code",
                           top_origins: int = 7, top_codes: int = 5) -> DataFrame:
    """A10: for the top origins by delayed legs, per code the delayed count
    divided by all of that origin's legs; then the codes with the largest
    summed proportion.  Long form (origin, code, proportion)."""
    per_origin = df.groupBy(origin).agg(_n().alias("__rows"), F.count(code).alias("__delays"))
    top_o = per_origin.orderBy(F.col("__delays").desc(), F.col(origin)).limit(top_origins)
    pairs = (df.where(F.col(code).isNotNull()).groupBy(origin, F.col(code).cast("string").alias("code"))
             .agg(_n().alias("__n")).join(F.broadcast(top_o), origin))
    prop = pairs.select(origin, "code", (F.col("__n") / F.col("__rows")).alias("proportion"))
    # summed shares are rounded before ranking so float summation order cannot flip ties
    top_c = prop.groupBy("code").agg(F.round(F.sum("proportion"), 9).alias("__s")).orderBy(
        F.col("__s").desc(), "code").limit(top_codes)
    return prop.join(F.broadcast(top_c.select("code")), "code", "left_semi")


def top_groups_with_first_attr(df: DataFrame, group: str, attr: str, k: int, order: str = "leg_id",
                               require_attr: bool = False) -> DataFrame:
    """The k largest groups, their share of rows and the ``attr`` of the
    group's first row in ``order`` (NULL allowed)."""
    base = df.where(F.col(attr).isNotNull()) if require_attr else df
    total = base.count()
    counts = base.groupBy(group).agg(_n().alias("n"))
    top = counts.where(F.col(group).isNotNull()).orderBy(F.col("n").desc(), F.col(group)).limit(k)
    first = (df.join(F.broadcast(top.select(group)), group, "left_semi").groupBy(group)
             .agg(F.min(F.struct(F.col(order), F.col(attr))).alias("__f")))
    return (top.join(first, group)
            .select(group, "n", (F.col("n") * 100.0 / F.lit(total)).alias("pct"), F.col(f"__f.{attr}").alias(attr)))


def haul_segment_fleets(df: DataFrame, minutes_col: str = "actual_block_time", fleet: str = "fleet") -> DataFrame:
    """Per haul segment the modal fleet (ties: smallest) and its share of the segment."""
    seg = F.lit(None).cast("string")
    for name, lo, hi in reversed(HAUL_SEGMENTS):
        cond = (F.col(minutes_col) >= lo) if hi is None else ((F.col(minutes_col) >= lo) & (F.col(minutes_col) < hi))
        seg = F.when(cond, F.lit(name)).otherwise(seg)
    counts = df.select(seg.alias("segment"), fleet).where(F.col("segment").isNotNull()).groupBy("segment", fleet).agg(
        _n().alias("n"))
    w = Window.partitionBy("segment")
    ranked = counts.withColumn("__tot", F.sum("n").over(w)).withColumn(
        "__r", F.row_number().over(w.orderBy(F.col("n").desc(), F.col(fleet).asc_nulls_last())))
    return ranked.where((F.col("__r") == 1)).select("segment", fleet, (F.col("n") * 100.0 / F.col("__tot")).alias("pct"))


def frequent_pairs(df: DataFrame, a: str = "origin_airport", b: str = "destination_airport", k: int = 16) -> DataFrame:
    """The k most frequent directed pairs, label 'A-B', share of all rows."""
    total = df.count()
    counts = df.groupBy(a, b).agg(_n().alias("n"))
    return (counts.orderBy(F.col("n").desc(), F.col(a), F.col(b)).limit(k)
            .select(F.concat_ws("-", a, b).alias("pair"), "n", (F.col("n") * 100.0 / F.lit(total)).alias("pct")))


def top_endpoints(df: DataFrame, k: int = 8) -> DataFrame:
    """Top-k origins and top-k destinations by legs, with a side label."""
    parts = []
    for side, col in (("origin", "origin_airport"), ("destination", "destination_airport")):
        c = df.groupBy(F.col(col).alias("airport")).agg(_n().alias("n"))
        parts.append(c.orderBy(F.col("n").desc(), "airport").limit(k).withColumn("side", F.lit(side)))
    return parts[0].unionByName(parts[1])


def level_shares(df: DataFrame, cols: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Share of each category per level column, denominator all rows (long form)."""
    long = df.select([F.col(c).alias(lab) for c, lab in zip(cols, labels)]).unpivot([], list(labels), "level",
                                                                                      "category")
    counts = long.groupBy("level", "category").agg(_n().alias("n"))
    w = Window.partitionBy("level")
    return counts.withColumn("share", F.col("n") / F.sum("n").over(w)).where(F.col("category").isNotNull()) \
        .select("level", "category", "share")


def undirected_edges(df: DataFrame, a: str = "origin_airport", b: str = "destination_airport") -> DataFrame:
    """Distinct undirected edges (u <= v) of the simple graph of pairs."""
    return df.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(
        F.col("u").isNotNull() & F.col("v").isNotNull()).distinct()


def graph_size(df: DataFrame, a: str = "origin_airport", b: str = "destination_airport") -> DataFrame:
    """Number of nodes and of distinct undirected connections, long form (metric, n)."""
    e = undirected_edges(df, a, b)
    nodes = e.select(F.col("u").alias("x")).unionByName(e.select(F.col("v").alias("x"))).distinct()
    return (nodes.agg(_n().alias("n")).withColumn("metric", F.lit("nodes"))
            .unionByName(e.agg(_n().alias("n")).withColumn("metric", F.lit("edges"))))


def node_degrees(df: DataFrame, a: str = "origin_airport", b: str = "destination_airport") -> DataFrame:
    """Degree in the undirected simple graph; a self-loop adds 2."""
    e = undirected_edges(df, a, b)
    ends = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node")))
    return ends.groupBy("node").agg(_n().alias("degree"))


def connected_components(df: DataFrame, a: str = "origin_airport", b: str = "destination_airport") -> DataFrame:
    """(node, component) where component = smallest node of its connected
    component, for graphs of any diameter.  A node with only a self-loop is its own."""
    e = undirected_edges(df, a, b)
    roots = components(e)
    nodes = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct()
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def correlation_long(df: DataFrame, cols: Sequence[str], pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Pearson for every ordered pair (or the given ones) in one aggregation, over
    pairwise-complete rows; each unordered pair is computed once."""
    pairs = [(x, y) for x in cols for y in cols] if pairs is None else list(pairs)
    place = {c: i for i, c in enumerate(cols)}
    once = sorted({tuple(sorted(p, key=place.get)) for p in pairs}, key=lambda p: (place[p[0]], place[p[1]]))
    wide = df.agg(*[F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias(f"c{i}") for i, (x, y) in enumerate(once)])
    number = {p: f"c{i}" for i, p in enumerate(once)}
    rows = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(number[tuple(sorted((x, y), key=place.get))]).alias("corr"))
                     for x, y in pairs])
    return wide.select(F.inline(rows))


# Rows that the broadcast rank tables of one matrix may have together (16 bytes each).
RANK_ROWS = 1 << 19


def spearman_long(df: DataFrame, cols: Sequence[str], key: str, pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Spearman = Pearson over average ranks.  A column is ranked over its
    own non-null rows; a pair is correlated over the rows where both are present.

    Ranks belong to distinct values, so they are looked up on the wide row: the
    rank tables of the columns of fewest values, ``RANK_ROWS`` rows together,
    are broadcast, and no row is shuffled.  Columns beyond that size are joined
    by (column, value) in long form and come back by ``key`` (unique, not null).
    """
    cols = list(dict.fromkeys(cols))
    wide = df.select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    long = wide.unpivot(key, cols, "column", "value")
    ranks = average_ranks(long, "column", "value").checkpoint()
    sizes = {r["column"]: r["n"] for r in ranks.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, looked_up = 0, []
    for c in sorted(cols, key=lambda c: sizes.get(c, 0)):
        total += sizes.get(c, 0)
        if total <= RANK_ROWS:
            looked_up.append(c)
    joined = [c for c in cols if c not in looked_up]
    out = wide.select(key, *looked_up)
    for c in looked_up:
        mine = ranks.where(F.col("column") == c).select(F.col("value").alias(c), F.col("avg_rank").alias("__rank"))
        out = out.join(F.broadcast(mine), c, "left").drop(c).withColumnRenamed("__rank", c)
    if joined:
        ranked = long.where(F.col("column").isin(joined)).join(ranks, ["column", "value"], "left")
        out = out.join(ranked.groupBy(key).pivot("column", joined).agg(F.first("avg_rank")), key, "left")
    return correlation_long(out, cols, pairs)


def encoded_spearman(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], targets: Sequence[str], label: str,
                     key: str) -> DataFrame:
    """(matrix, x, y, corr) of the three rank matrices: numeric columns; leave-one-out encoded
    categories with the targets; numeric columns and targets against encoded categories and targets."""
    from legflow.operators.encode import LeaveOneOutEncoder

    _, x = LeaveOneOutEncoder(categorical, label).fit_transform(df)
    num, cat = list(dict.fromkeys([*numeric, *targets])), list(dict.fromkeys([*categorical, *targets]))
    sides = {"numeric": [(a, b) for a in numeric for b in numeric], "categorical": [(a, b) for a in cat for b in cat],
             "mixed": [(a, b) for a in num for b in cat]}
    every = list(dict.fromkeys(p for pairs in sides.values() for p in pairs))
    corr = spearman_long(x, [*num, *categorical], key, every)
    parts = F.array(*[F.struct(F.lit(m).alias("matrix"), F.lit(a).alias("x"), F.lit(b).alias("y")) for m, pairs in sides.items() for a, b in pairs])
    wanted = df.sparkSession.range(1).select(F.inline(parts))
    return corr.join(F.broadcast(wanted), ["x", "y"]).select("matrix", "x", "y", "corr")


def delay_source_comparison(df: DataFrame, given: str = "delay_minutes") -> DataFrame:
    """Given vs computed (clamped) departure delay: mean / max / min of each,
    on all rows (the chart's 10 % sample is a drawing aid; ``sample`` below)."""
    from legflow.operators.derive import add_departure_delay

    d = add_departure_delay(df)
    return (d.select(F.lit("dataset").alias("series"), F.col(given).cast("double").alias("v"))
            .unionByName(d.select(F.lit("calculated").alias("series"), F.col("departure_delay").cast("double")
                                  .alias("v")))
            .groupBy("series").agg(F.avg("v").alias("mean"), F.max("v").alias("max"), F.min("v").alias("min")))


def day_schedule_series(df: DataFrame, year: int, month: int, day: int) -> DataFrame:
    """Scheduled vs actual times of one day, both ends, sorted by schedule."""
    from legflow.operators.clean import in_calendar_period

    dep = in_calendar_period(df, "scheduled_departure_date", year, month, day).select(
        F.lit("departure").alias("end"), F.col("scheduled_departure_date").alias("scheduled"),
        F.col("off_block_date").alias("actual"))
    arr = in_calendar_period(df, "scheduled_arrival_date", year, month, day).select(
        F.lit("arrival").alias("end"), F.col("scheduled_arrival_date").alias("scheduled"),
        F.col("on_block_date").alias("actual"))
    return dep.unionByName(arr).orderBy("end", "scheduled", "actual")


def paired_histogram(df: DataFrame, a: str, b: str, bins: int = 20) -> DataFrame:
    """Fixed-width histogram of two comparable columns over their common range, NULL dropped."""
    long = df.select(F.lit(a).alias("series"), F.col(a).cast("double").alias("v")).unionByName(
        df.select(F.lit(b).alias("series"), F.col(b).cast("double").alias("v"))).where(F.col("v").isNotNull())
    r = long.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    lo, hi = r["lo"], r["hi"]
    if lo is None:
        return long.select("series", F.lit(None).cast("int").alias("bin"), F.lit(0).alias("n")).limit(0)
    width = (hi - lo) / bins if hi > lo else 1.0
    bin_ = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    return long.groupBy("series", bin_.alias("bin")).agg(_n().alias("n")).withColumns(
        {"bin_lo": F.lit(lo) + F.col("bin") * F.lit(width), "bin_hi": F.lit(lo) + (F.col("bin") + 1) * F.lit(width)})


def airport_cloud_timeline(df: DataFrame, airport: str, year: int, month: int) -> DataFrame:
    """Origin-side (off-block) and destination-side (on-block) cloud rows at
    one airport and month, unified names, sorted by date."""
    from legflow.operators.clean import in_calendar_period

    ori = in_calendar_period(df.where(F.col("origin_airport") == airport), "off_block_date", year, month).select(
        F.col("off_block_date").alias("date"), F.col("origin_cloud_coverage").alias("coverage"),
        F.col("origin_cloud_height").alias("height"))
    dst = in_calendar_period(df.where(F.col("destination_airport") == airport), "on_block_date", year, month).select(
        F.col("on_block_date").alias("date"), F.col("destination_cloud_coverage").alias("coverage"),
        F.col("destination_cloud_height").alias("height"))
    return ori.unionByName(dst).orderBy("date", "coverage", "height")


def timeline_bounds(timeline: DataFrame) -> DataFrame:
    """A24 axis bounds: first - 1 h, last + 1 h, max height + 500."""
    return timeline.agg((F.min("date") - F.expr("INTERVAL 1 HOUR")).alias("x_min"),
                        (F.max("date") + F.expr("INTERVAL 1 HOUR")).alias("x_max"),
                        (F.max("height") + 500).alias("y_max"))


def skewed_columns(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Population skewness of positive numeric columns; keep |skew| > threshold."""
    cols = list(cols) if cols is not None else columns_of_kind(df, "numeric")
    long = df.select([F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    sk = long.groupBy("column").agg(F.skewness("value").alias("skew"), F.min("value").alias("__min"))
    return sk.where((F.col("__min") > 0) & (F.abs("skew") > threshold)).select("column", "skew")


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n) long form."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(_n().alias("n"))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class precision, recall, F1, support; plus macro and weighted averages."""
    cm = confusion_matrix(df, label, prediction)
    tp = cm.where(F.col("label") == F.col("prediction")).select(F.col("label").alias("cls"), F.col("n").alias("tp"))
    sup = cm.groupBy(F.col("label").alias("cls")).agg(F.sum("n").alias("support"))
    pred = cm.groupBy(F.col("prediction").alias("cls")).agg(F.sum("n").alias("predicted"))
    per = (sup.join(pred, "cls", "full").join(tp, "cls", "left").fillna(0, ["tp", "support", "predicted"])
           .withColumn("precision", F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0)))
           .withColumn("recall", F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))))
    per = per.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                        F.col("precision") + F.col("recall")), F.lit(0.0)))
    per = per.select(F.col("cls").cast("string").alias("cls"), "precision", "recall", "f1",
                     F.col("support").cast("long").alias("support"))
    macro = per.agg(F.lit("macro avg").alias("cls"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    tot = F.sum("support")
    weighted = per.agg(F.lit("weighted avg").alias("cls"),
                       (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
                       (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
                       (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"), tot.alias("support"))
    return per.unionByName(macro).unionByName(weighted)
