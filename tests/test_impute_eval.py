"""Imputation, scoring, neighbours and evaluation tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from legflow.operators import evaluate, impute


def test_masked_scores_literal(spark):
    truth = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0)], "k long, a double, b double")
    inc = spark.createDataFrame([(1, None, 2.0), (2, 3.0, None)], "k long, a double, b double")
    pred = spark.createDataFrame([(1, 2.0, 2.0), (2, 3.0, 1.0)], "k long, a double, b double")
    r = impute.masked_scores(truth, pred, inc, ["a", "b"], "k").collect()[0]
    assert r.mse == pytest.approx((1 + 9) / 2) and r.mae == pytest.approx(2.0) and r.n_cells == 2


def test_imputers_beat_mean_on_correlated_data(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=1500)
    rows = [(i, float(z[i]), float(2 * z[i] + 0.05 * rng.normal()), float(-z[i] + 0.05 * rng.normal()))
            for i in range(1500)]
    full = spark.createDataFrame(rows, "k long, a double, b double, c double")
    cols = ["a", "b", "c"]
    inc = impute.inject_nulls(full, cols, 0.2, "k", seed=3)
    base = impute.masked_scores(full, impute.MeanFill(cols).fit(inc).transform(inc), inc, cols, "k").collect()[0]
    it = impute.IterativeImputer(cols, "k", max_iter=2).fit_transform(inc)
    s_it = impute.masked_scores(full, it, inc, cols, "k").collect()[0]
    rec = impute.ReconstructImputer(cols, "k", k=1, max_iter=4).fit(inc).transform(inc)
    s_rec = impute.masked_scores(full, rec, inc, cols, "k").collect()[0]
    assert s_it.mae < base.mae / 2 and s_rec.mae < base.mae / 2
    # only missing cells change
    joined = inc.join(it.select("k", *[F.col(c).alias(c + "_i") for c in cols]), "k")
    assert joined.where("a IS NOT NULL AND abs(a - a_i) > 1e-9").count() == 0


def test_knn_matches_numpy(spark):
    rng = np.random.default_rng(5)
    tr = rng.normal(size=(120, 4))
    q = rng.normal(size=(30, 4))
    lab = rng.integers(0, 3, size=120)
    T = spark.createDataFrame([(i, [float(v) for v in tr[i]], int(lab[i])) for i in range(120)],
                              "id long, features array<double>, label int")
    Q = spark.createDataFrame([(1000 + i, [float(v) for v in q[i]]) for i in range(30)], "id long, features array<double>")
    for block in (1 << 20, 1000):
        nb = impute.nearest_neighbours(T, Q, 3, block_bytes=block)
        got = {(r.query_id, r.rank): r.neighbour_id for r in nb.collect()}
        for i in range(30):
            order = np.argsort(((tr - q[i]) ** 2).sum(1), kind="stable")[:3]
            assert [got[(1000 + i, r + 1)] for r in range(3)] == list(order)


def test_percentage_error_bins_widen_after_empty(spark):
    df = spark.createDataFrame([(100.0, 101.0), (100.0, 105.0), (100.0, 300.0), (100.0, 100.0)],
                               "label double, prediction double")
    rows = {r.bin: r.n for r in evaluate.percentage_error_bins(df).collect()}
    assert rows == {"0-2": 1, "2-6": 1, "> 100": 1}


def test_request_validation(spark):
    fields = {f: "1" for f in evaluate.REQUEST_FIELDS}
    good = dict(fields, request_id=1)
    bad = dict(fields, request_id=2, scheduled_block_time="3.5")
    df = spark.createDataFrame([good, bad])
    v, r = evaluate.validate_requests(df)
    assert v.count() == 1 and r.collect()[0].reason.startswith("scheduled_block_time")
    assert v.columns[1:] == evaluate.REQUEST_FIELDS


def test_neighbours_by_blocks_and_slots_are_the_same(spark):
    rng = np.random.default_rng(3)
    x, q = rng.integers(0, 4, (90, 3)).astype(float), rng.integers(0, 4, (40, 3)).astype(float)
    T = spark.createDataFrame([(i, r.tolist(), int(i % 3)) for i, r in enumerate(x)], "id long, features array<double>, label int")
    Q = spark.createDataFrame([(1000 + i, r.tolist()) for i, r in enumerate(q)], "id long, features array<double>")
    runs = [sorted(map(tuple, impute.nearest_neighbours(T, Q, 5, block_bytes=b, slot_queries=s).collect()))
            for b, s in ((1 << 20, 1 << 14), (500, 7), (500, 1 << 14), (1 << 20, 9))]
    assert runs[0] == runs[1] == runs[2] == runs[3] and len(runs[0]) == 200
    assert impute.nearest_neighbours(T, Q.limit(0), 5).count() == 0 and impute.nearest_neighbours(T.limit(0), Q, 5).count() == 0


def test_a_task_holds_few_distances():
    """Distances of a block are worked out for as many queries as fit a fixed number, so memory does not follow the block."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    n, m = 30_000, 300
    x = rng.integers(0, 50, (n + m, 2)).astype(float)
    frame = pd.DataFrame({"task": 0, "side": [0] * n + [1] * m, "id": range(n + m), "features": list(x), "label": 0})
    tracemalloc.start()
    got = pd.concat(impute._knn_block(3)(iter([frame.iloc[:n], frame.iloc[n:]])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    for q in (n, n + m - 1):
        d2 = ((x[:n] - x[q]) ** 2).sum(axis=1)
        assert got[got["query_id"] == q]["neighbour_id"].tolist() == np.lexsort((np.arange(n), d2))[:3].tolist()
