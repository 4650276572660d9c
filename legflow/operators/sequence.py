"""Skew-safe ordered operators: predecessor lookup and nearest-in-time match.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task, so
a hot key (one vehicle, one station, or NULL) becomes one huge task.  Both
operators here split each key by a time bucket and carry, into each bucket,
the one row from earlier (or later) buckets that the bucket may need.  The
carry rows come from a map-side-combined aggregation (one row per key and
bucket), so the big shuffle is keyed by (key, bucket) and no task holds
more than one bucket of one key.  Rows that cannot match (NULL key or time)
are spread over salted partitions instead of piling into one NULL group.

Running frames are always ``unboundedPreceding .. currentRow`` (incremental);
the forward direction uses a descending order instead of an
``unboundedFollowing`` frame, which Spark re-evaluates for every row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNB = Window.unboundedPreceding
# Partitions over which rows without a usable key are spread.
NULL_KEY_SALT = 4096


def _all_not_null(cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


def time_bucket(ts: Column, minutes: int) -> Column:
    """Integer bucket of ``minutes`` width counted from 1970-01-01 (NTZ safe)."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(F.timestamp_diff("MINUTE", epoch, ts.cast("timestamp_ntz")) / F.lit(minutes)).cast("bigint")


def bucket_of_day(ts: Column, minutes: int) -> Column:
    """Bucket of ``minutes`` width within the calendar day (0-based)."""
    return F.floor((F.hour(ts) * 60 + F.minute(ts)) / F.lit(minutes)).cast("bigint")


def _salt(col: str) -> Column:
    """Spread value for rows that can never match; one column keeps it cheap
    (hashing the whole row made constraint inference on the plan very slow)."""
    return F.pmod(F.xxhash64(F.col(col)), F.lit(NULL_KEY_SALT))


def previous_values(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str],
                    names: Sequence[str], bucket_minutes: int = 7 * 24 * 60,
                    drop_null_keys: bool = False) -> DataFrame:
    """For each row, ``values`` of the previous row of the same ``keys`` in
    ``order`` (first column a timestamp, the rest tie-breakers), as ``names``.

    Rows with a NULL key or NULL leading order value get NULL (no predecessor)
    and are never a predecessor; ``drop_null_keys`` removes rows with a NULL
    key instead (what a pandas group-apply does).
    """
    keys, order, values = list(keys), list(order), list(values)
    if drop_null_keys:
        df = df.where(_all_not_null(keys))
    cols = df.columns
    ok = _all_not_null(keys + [order[0]])
    bkt = F.when(ok, time_bucket(F.col(order[0]), bucket_minutes)).otherwise(-1 - _salt(order[-1]))
    carried = [f"__cv{i}" for i in range(len(values))]

    # Latest row of every (key, bucket); carry = latest of all earlier buckets.
    ord_fields = [F.col(c).alias(f"__o{i}") for i, c in enumerate(order)]
    val_fields = [F.col(v).alias(c) for v, c in zip(values, carried)]
    last_in_bucket = (df.where(ok).withColumn("__bkt", bkt).groupBy(*keys, "__bkt")
                      .agg(F.max(F.struct(*ord_fields, *val_fields)).alias("__last")))
    w_bkt = Window.partitionBy(*keys).orderBy("__bkt").rowsBetween(UNB, -1)
    carry = (last_in_bucket.select(*keys, "__bkt", F.max("__last").over(w_bkt).alias("__c"))
             .where(F.col("__c").isNotNull())
             .select(*keys, "__bkt", *[F.col(f"__c.__o{i}").alias(c) for i, c in enumerate(order)],
                     *[F.col(f"__c.{c}").alias(c) for c in carried],
                     F.lit(False).alias("__real"), F.lit(False).alias("__body")))

    others = [c for c in cols if c not in keys and c not in order]
    body = df.select(*keys, bkt.alias("__bkt"), *order, *[F.col(v).alias(c) for v, c in zip(values, carried)],
                     ok.alias("__real"), F.lit(True).alias("__body"),
                     F.struct(F.lit(0).alias("__pad"), *[F.col(c) for c in others]).alias("__row"))
    carry = carry.withColumn("__row", F.lit(None).cast(body.schema["__row"].dataType))
    u = body.unionByName(carry)
    w = Window.partitionBy(*keys, "__bkt").orderBy(*order)
    lagged = u.withColumns({n: F.when(F.col("__real"), F.lag(c).over(w)) for n, c in zip(names, carried)})
    return lagged.where(F.col("__body")).select(
        *[F.col(c) if c in keys or c in order else F.col(f"__row.{c}").alias(c) for c in cols], *names)


def nearest_in_time(left: DataFrame, right: DataFrame, left_key: str, left_time: str, right_key: str,
                    right_time: str, right_seq: str, payload: Sequence[str], prefix: str = "",
                    bucket_minutes: int = 60, parts: int | None = None) -> DataFrame:
    """Attach to each left row the right row of the same key whose time is
    nearest to the left time **within the left time's calendar day**
    ([day, day + 1)).  Ties (equal gap, or equal right time) go to the
    smallest ``right_seq`` (first in feed).  A left row without key, time or
    candidate gets NULL payload.  Output: all left columns + ``prefix`` + payload.

    Plan: one shuffle of (left rows + right rows + carry rows) keyed by
    (key, day, bucket-of-day), two running windows (backward ascending,
    forward descending) in the same partitioning.  Carry rows hold, per
    bucket, the latest observation of the day's earlier buckets and the
    earliest of its later buckets; they are derived from the right side only
    (at most ``2 * 1440 / bucket_minutes`` per key and day).  ``parts``: the
    number of partitions of that shuffle instead of the session's.
    """
    if 1440 % bucket_minutes:
        raise ValueError("bucket_minutes must divide a day")
    n_bkt = 1440 // bucket_minutes
    lcols = left.columns
    out_names = [prefix + p for p in payload]

    lt = F.col(left_time).cast("timestamp_ntz")
    ok = F.coalesce(F.col(left_key).isNotNull() & (F.col(left_key) != "") & lt.isNotNull(), F.lit(False))
    rgt = right.where(F.col(right_key).isNotNull() & F.col(right_time).isNotNull())
    rt = F.col(right_time).cast("timestamp_ntz")
    pay = F.struct(*[F.col(p) for p in payload])
    obs = rgt.select(F.col(right_key).alias("__k"), F.to_date(rt).alias("__day"),
                     bucket_of_day(rt, bucket_minutes).alias("__bkt"), rt.alias("__t"),
                     F.col(right_seq).cast("bigint").alias("__s"), pay.alias("__p"))

    # Per (key, day): bucket summaries (<= n_bkt, a fixed bound), then for every
    # bucket of the day the nearest observation before it and after it.
    back_s = F.struct(F.col("__t"), (-F.col("__s")).alias("__ns"), F.col("__p"))
    fwd_s = F.struct(F.col("__t"), F.col("__s"), F.col("__p"))
    per_bucket = obs.groupBy("__k", "__day", "__bkt").agg(F.max(back_s).alias("__last"), F.min(fwd_s).alias("__first"))
    per_day = per_bucket.groupBy("__k", "__day").agg(
        F.collect_list(F.struct("__bkt", "__last", "__first")).alias("__bs"))
    b = F.col("__b")
    carries = (per_day.select("__k", "__day", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                                  F.lit(n_bkt - 1).cast("bigint"))).alias("__b"),
                              "__bs")
               .select("__k", "__day", b.alias("__bkt"),
                       F.array_max(F.transform(F.filter("__bs", lambda x: x["__bkt"] < b), lambda x: x["__last"])).alias("__pl"),
                       F.array_min(F.transform(F.filter("__bs", lambda x: x["__bkt"] > b), lambda x: x["__first"])).alias("__nf")))
    carry_rows = (carries.select("__k", "__day", "__bkt", F.explode(F.array(
        F.when(F.col("__pl").isNotNull(), F.struct(F.col("__pl.__t").alias("t"), (-F.col("__pl.__ns")).alias("s"),
                                                    F.col("__pl.__p").alias("p"))),
        F.when(F.col("__nf").isNotNull(), F.struct(F.col("__nf.__t").alias("t"), F.col("__nf.__s").alias("s"),
                                                    F.col("__nf.__p").alias("p"))))).alias("__c"))
        .where(F.col("__c").isNotNull())
        .select("__k", "__day", "__bkt", F.col("__c.t").alias("__t"), F.col("__c.s").alias("__s"),
                F.col("__c.p").alias("__p")))

    legs = left.select(F.when(ok, F.col(left_key)).alias("__k"), F.when(ok, F.to_date(lt)).alias("__day"),
                       F.when(ok, bucket_of_day(lt, bucket_minutes)).otherwise(-1 - _salt(lcols[0])).alias("__bkt"),
                       lt.alias("__t"), F.lit(None).cast("bigint").alias("__s"),
                       F.lit(None).cast(obs.schema["__p"].dataType).alias("__p"),
                       F.lit(1).alias("__kind"), F.struct(*[F.col(c) for c in lcols]).alias("__row"))
    no_row = F.lit(None).cast(legs.schema["__row"].dataType)
    u = legs.unionByName(obs.unionByName(carry_rows).withColumns({"__kind": F.lit(0), "__row": no_row}))

    part = ["__k", "__day", "__bkt"]
    u = u.repartition(parts, *part) if parts else u
    is_obs = F.col("__kind") == 0
    w_back = Window.partitionBy(*part).orderBy(F.col("__t").asc(), F.col("__kind").asc()).rowsBetween(UNB, 0)
    w_fwd = Window.partitionBy(*part).orderBy(F.col("__t").desc(), F.col("__kind").asc()).rowsBetween(UNB, 0)
    back = F.max(F.when(is_obs, F.struct(F.col("__t"), (-F.col("__s")).alias("ns"), F.col("__p")))).over(w_back)
    fwd = F.min(F.when(is_obs, F.struct(F.col("__t"), F.col("__s"), F.col("__p")))).over(w_fwd)
    cand = u.withColumns({"__b": back, "__f": fwd}).where(F.col("__kind") == 1)
    gap_b = F.timestamp_diff("MICROSECOND", F.col("__b.__t"), F.col("__t"))
    gap_f = F.timestamp_diff("MICROSECOND", F.col("__t"), F.col("__f.__t"))
    best = F.least(
        F.when(F.col("__b").isNotNull(),
               F.struct(gap_b.alias("g"), (-F.col("__b.ns")).alias("s"), F.col("__b.__p").alias("p"))),
        F.when(F.col("__f").isNotNull(),
               F.struct(gap_f.alias("g"), F.col("__f.__s").alias("s"), F.col("__f.__p").alias("p"))),
    )
    return cand.select(*[F.col(f"__row.{c}").alias(c) for c in lcols],
                       *[best["p"][p].alias(n) for p, n in zip(payload, out_names)])
