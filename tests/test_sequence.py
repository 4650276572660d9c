"""Nearest-in-time join and predecessor lookup against brute force."""

import datetime as dt
import random

import pandas as pd
import pytest

from legflow.operators.sequence import nearest_in_time, previous_values


def _brute_nearest(legs, obs):
    out = {}
    for lid, st, t in legs:
        best = None
        if st and t is not None:
            for seq, ost, ot, val in obs:
                if ost == st and ot.date() == t.date():
                    key = (abs((ot - t).total_seconds()), seq)
                    if best is None or key < best[0]:
                        best = (key, val)
        out[lid] = best[1] if best else None
    return out


@pytest.mark.parametrize("bucket", [60, 15, 1440])
def test_nearest_matches_brute_force(spark, bucket):
    rnd = random.Random(7)
    t0 = dt.datetime(2024, 1, 1)
    obs = []
    for seq in range(400):
        t = t0 + dt.timedelta(minutes=rnd.randrange(0, 3 * 1440))
        obs.append((seq, rnd.choice(["S1", "S2", "S3"]), t, f"v{seq}"))
    obs.append((1000, "S1", obs[0][2], "dup-late"))       # same time, later in feed: loses
    legs = []
    for i in range(300):
        t = t0 + dt.timedelta(minutes=rnd.randrange(0, 3 * 1440), seconds=rnd.choice([0, 30]))
        legs.append((i, rnd.choice(["S1", "S2", "S3", "S9", "", None]), t if i % 17 else None))
    legs.append((999, "S1", obs[0][2]))                    # exact hit on a duplicated time
    L = spark.createDataFrame(legs, "leg_id long, st string, t timestamp_ntz")
    O = spark.createDataFrame(obs, "feed_seq long, station string, time timestamp_ntz, val string")
    got = {r.leg_id: r.w_val for r in nearest_in_time(L, O, "st", "t", "station", "time", "feed_seq", ["val"],
                                                      prefix="w_", bucket_minutes=bucket).collect()}
    assert got == _brute_nearest(legs, obs)
    assert got[999] == obs[0][3]


def test_nearest_tie_goes_to_first_in_feed(spark):
    t = dt.datetime(2024, 1, 1, 12)
    obs = [(5, "S", t - dt.timedelta(minutes=10), "before"), (3, "S", t + dt.timedelta(minutes=10), "after")]
    L = spark.createDataFrame([(1, "S", t)], "leg_id long, st string, t timestamp_ntz")
    O = spark.createDataFrame(obs, "feed_seq long, station string, time timestamp_ntz, val string")
    r = nearest_in_time(L, O, "st", "t", "station", "time", "feed_seq", ["val"]).collect()[0]
    assert r.val == "after"


def test_previous_values_matches_pandas(spark):
    rnd = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, rnd.choice(["A", "B", None]), t0 + dt.timedelta(hours=rnd.randrange(0, 24 * 40)), i * 10)
            for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, t timestamp_ntz, v long")
    got = {r.id: r.prev for r in previous_values(df, ["k"], ["t", "id"], ["v"], ["prev"], bucket_minutes=24 * 60)
           .collect()}
    pdf = pd.DataFrame(rows, columns=["id", "k", "t", "v"]).sort_values(["t", "id"])
    expect = {}
    for k, g in pdf[pdf.k.notna()].groupby("k"):
        prev = g.v.shift(1)
        for i, p in zip(g.id, prev):
            expect[i] = None if pd.isna(p) else int(p)
    for i in pdf[pdf.k.isna()].id:
        expect[i] = None
    assert got == expect
