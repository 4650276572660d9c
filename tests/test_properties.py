"""Property test: the nearest-time join equals brute force on generated feeds."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from legflow.operators.sequence import nearest_in_time

T0 = dt.datetime(2024, 3, 1)
minutes = st.integers(min_value=0, max_value=2 * 1440 - 1)
obs_st = st.lists(st.tuples(st.sampled_from(["S1", "S2"]), minutes), min_size=0, max_size=40)
legs_st = st.lists(st.tuples(st.sampled_from(["S1", "S2", None]), st.one_of(st.none(), minutes)), min_size=1,
                   max_size=30)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(obs=obs_st, legs=legs_st, bucket=st.sampled_from([30, 60, 240]))
def test_nearest_equals_brute_force(spark, obs, legs, bucket):
    o = [(i, s, T0 + dt.timedelta(minutes=m), f"v{i}") for i, (s, m) in enumerate(obs)]
    lg = [(i, s, None if m is None else T0 + dt.timedelta(minutes=m, seconds=20)) for i, (s, m) in enumerate(legs)]
    O = spark.createDataFrame(o, "feed_seq long, station string, time timestamp_ntz, val string")
    L = spark.createDataFrame(lg, "leg_id long, st string, t timestamp_ntz")
    got = {r.leg_id: r.val for r in nearest_in_time(L, O, "st", "t", "station", "time", "feed_seq", ["val"],
                                                    bucket_minutes=bucket).collect()}
    for lid, s, t in lg:
        cands = [(abs((ot - t).total_seconds()), seq, v) for seq, os_, ot, v in o
                 if s is not None and t is not None and os_ == s and ot.date() == t.date()]
        assert got[lid] == (min(cands)[2] if cands else None)
