"""Histogram trees against plain numpy growth, hand-worked leaves, resumed runs, saved models."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from legflow.operators import boost, evaluate, model
from legflow.sources import io


def frame(spark, n=300, seed=1, parts=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 20, n), rng.normal(size=n).round(2), rng.integers(0, 2, n)]).astype(float)
    y = np.where(x[:, 0] > 9, 5.0, 0.0) + x[:, 1] + rng.normal(size=n) * 0.1
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id bigint, a double, b double, c double, label double")
    return df.repartition(parts), ["a", "b", "c"], x, y


def test_hand_worked_tree_with_leaf_penalties(spark):
    """Labels 1, 2, 9, 10 at 1..4, base 0.5: gradients -0.5, -1.5, -8.5, -9.5; L1 0.5, L2 1."""
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 9.0), (4.0, 10.0)], "x double, label double")
    m = boost.boosted(df, ["x"], rounds=1, rate=0.1, growth=boost.Growth(depth=2, l1=0.5, l2=1.0), base=0.5)
    t = m.trees[0]
    # root: G -20, score 19.5**2 / 5 = 76.05; after 2: (1.5**2 / 3) + (17.5**2 / 3) = 102.8, the best cut
    assert (t.feature[1], t.threshold[1]) == (0, 2.0) and t.value[1] == pytest.approx(0.1 * 19.5 / 5)
    # left: 1.5**2 / 3 = 0.75 against 0 / 2 + 1**2 / 2 = 0.5: no split; right: 17.5**2 / 3 = 102.1 against 8**2 / 2 + 9**2 / 2 = 72.5: none
    assert t.feature[2] == t.feature[3] == -1
    assert [round(r.prediction, 9) for r in m.transform(df).orderBy("x").collect()] == [round(v, 9) for v in (0.5 + 0.05, 0.5 + 0.05, 0.5 + 0.1 * 17.5 / 3, 0.5 + 0.1 * 17.5 / 3)]


def plain_tree(x, g, w, p, depth, columns, at=1):
    """{heap place: (feature, threshold, value)} grown on all thresholds by direct sums."""
    sc = lambda a, b: max(abs(a) - p.l1, 0) ** 2 / (b + p.l2) if b + p.l2 > 0 else 0.0
    G, H = (g * w).sum(), w.sum()
    out = {at: (-1, 0.0, -np.sign(G) * max(abs(G) - p.l1, 0) / (H + p.l2) if H + p.l2 else 0.0)}
    if depth == 0:
        return out
    best = (1e-9, None)
    for f in columns:
        for t in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= t
            gl, hl = (g * w)[left].sum(), w[left].sum()
            if hl < p.min_child or H - hl < p.min_child:
                continue
            gain = sc(gl, hl) + sc(G - gl, H - hl) - sc(G, H)
            if gain > best[0] + 1e-9:
                best = (gain, (f, t))
    if best[1]:
        f, t = best[1]
        left = x[:, f] <= t
        out[at] = (f, t, out[at][2])
        out |= plain_tree(x[left], g[left], w[left], p, depth - 1, columns, 2 * at)
        out |= plain_tree(x[~left], g[~left], w[~left], p, depth - 1, columns, 2 * at + 1)
    return out


def plain_value(tree, row):
    at = 1
    while tree[at][0] >= 0:
        at = 2 * at + int(row[tree[at][0]] > tree[at][1])
    return tree[at][2]


def test_rounds_equal_plain_growth(spark):
    """Columns of up to 20 values keep every threshold, so the bins lose nothing."""
    df, cols, x, y = frame(spark)
    x[:, 1] = np.clip(np.round(x[:, 1] * 4), -9, 9)
    df = df.withColumn("b", F.greatest(F.lit(-9.0), F.least(F.lit(9.0), F.bround(F.col("b") * 4))))
    p = boost.Growth(depth=3, l1=0.2, l2=0.5, min_child=2.0)
    m = boost.boosted(df, cols, rounds=3, rate=0.3, growth=p, key="id")
    margin = np.full(len(y), y.mean())
    for tree in m.trees:
        want = plain_tree(x, margin - y, np.ones(len(y)), p, 3, range(3))
        for at, (f, t, v) in want.items():
            assert tree.feature[at] == f and tree.value[at] == pytest.approx(0.3 * v, abs=1e-9)
            assert f < 0 or tree.threshold[at] == t
        margin = margin + 0.3 * np.array([plain_value(want, r) for r in x])
    got = np.array([r.prediction for r in m.transform(df).orderBy("id").collect()])
    assert np.allclose(got, margin) and sum(m.importances) == pytest.approx(1)


def test_a_run_in_two_halves_equals_one(spark, tmp_path):
    df, cols, _, _ = frame(spark)
    whole = model.regularised_boosted_trees(df, cols, rounds=9, key="id")
    folder = str(tmp_path / "run")
    growth = boost.Growth(l1=1e-3, l2=0.1, row_share=0.8, tree_columns=0.7)
    for rounds in (5, 9):
        half = boost.boosted(df, cols, rounds=rounds, rate=0.1, growth=growth, base=0.5, key="id", folder=folder, every=2)
        if rounds == 5:  # stopped after round 5: the state of round 4 is there
            assert spark.read.parquet(f"{folder}/trees").agg(F.max("round")).first()[0] == 4
    assert len(half.trees) == 9
    for a, b in zip(whole.trees, half.trees):
        assert a.feature == b.feature and np.allclose(a.value, b.value) and a.threshold == b.threshold
    drawn = [{f for f in t.feature if f >= 0} for t in whole.trees]
    assert all(len(d) <= 2 for d in drawn) and len(set().union(*drawn)) == 3  # two of three columns a tree
    again = model.regularised_boosted_trees(df.repartition(7), cols, rounds=2, key="id")
    assert [t.feature for t in again.trees] == [t.feature for t in whole.trees[:2]]


def test_row_samples_are_shares_and_poisson_counts():
    h = np.random.default_rng(1).integers(-2**62, 2**62, 40_000)
    w = boost.row_weights(h, boost.Growth(row_share=0.8), 3)
    assert abs(w.mean() - 0.8) < 0.01 and set(w) == {0.0, 1.0}
    b = boost.row_weights(h, boost.Growth(bootstrap=True), 3)
    assert abs(b.mean() - 1) < 0.02 and abs(b.var() - 1) < 0.04 and abs((b == 0).mean() - np.exp(-1)) < 0.01
    assert (w != boost.row_weights(h, boost.Growth(row_share=0.8), 4)).any()


def test_forest_learns_and_is_saved(spark, tmp_path):
    df, cols, x, y = frame(spark)
    chain = model.fit_chain(df, "rf", cols, scaler=None, rounds=70, key="id")
    assert len(chain.model.trees) == 70
    scored = chain.transform(df)
    assert evaluate.test_metrics(scored).first()["r2"] > 90
    imp = {r.feature: r.importance for r in evaluate.feature_importances(spark, chain.model.stages[-1], chain.assembler_cols).collect()}
    assert max(imp, key=imp.get) == "a" and sum(imp.values()) == pytest.approx(1, abs=2e-3)
    chain.save(str(tmp_path / "rf"))
    again = io.load_chain(str(tmp_path / "rf"))
    a, b = ([r.prediction for r in c.transform(df).orderBy("id").collect()] for c in (chain, again))
    assert np.allclose(a, b)
    stacked = model.fit_chain(df, "stacking", cols, rounds=3, key="id")
    stacked.save(str(tmp_path / "st"))
    a, b = ([r.prediction for r in c.transform(df).orderBy("id").collect()] for c in (stacked, io.load_chain(str(tmp_path / "st"))))
    assert np.allclose(a, b) and json.dumps(stacked.model.state())


def test_gaps_constant_columns_and_no_rows(spark):
    df, cols, _, _ = frame(spark)
    odd = df.withColumns({"a": F.when(F.col("id") % 3 > 0, F.col("a")), "b": F.lit(float("nan")), "label": F.when(F.col("id") % 7 > 0, F.col("label"))})
    m = model.boosted_trees(odd, cols, rounds=4, key="id")
    assert m.transform(odd).filter("prediction is null or isnan(prediction)").count() == 0 and m.importances[1] == 0
    none = model.boosted_trees(df.limit(0), cols, rounds=4)
    assert none.trees == [] and none.transform(df).select("prediction").distinct().count() == 1
    assert model.random_forest(df.limit(0), cols, trees=4).trees == []


def plain_landed(tree, bins, levels):
    """Row by row; ``bins`` has a line for each column."""
    out = []
    for row in bins.T:
        at = 1
        for _ in range(levels):
            at = 2 * at + int(row[tree.feature[at]] > tree.cut[at]) if tree.feature[at] >= 0 else at
        out.append(at)
    return out


def test_places_are_those_of_a_walk_row_by_row():
    rng = np.random.default_rng(2)
    for depth in (1, 3, 4, 7, 9):
        bins = rng.integers(0, 65, (3, 400)).astype(np.uint8)
        tree = boost.Tree.empty(depth)
        for q in range(1, 1 << depth):
            if q == 1 or (tree.feature[q // 2] >= 0 and rng.random() < 0.8):
                tree.feature[q], tree.cut[q] = int(rng.integers(3)), int(rng.integers(1, 64))
        for levels in range(depth + 1):
            assert boost.landed(tree, bins, levels).tolist() == plain_landed(tree, bins, levels)


def test_counts_by_table_are_those_by_search():
    h = np.random.default_rng(3).integers(-2**62, 2**62, 200_000)
    g = boost.Growth(bootstrap=True, seed=2)
    want = np.searchsorted(boost.POISSON, boost.mixed(h, 2 * 1_000_003 + 5), "right")
    assert (boost.row_weights(h, g, 5) == want).all()


def same_trees(a, b):
    assert len(a.trees) == len(b.trees)
    for s, t in zip(a.trees, b.trees):
        assert s.feature == t.feature and s.threshold == t.threshold and np.allclose(s.value, t.value, rtol=1e-9, atol=1e-9)


def test_sums_by_cell_give_the_trees_of_the_rows(spark, monkeypatch, tmp_path):
    """Few cells: the levels read sums by cell instead of every row, and the trees stay; so they do over several blocks and a resumed run."""
    df, cols, _, _ = frame(spark, n=900)
    df = df.withColumn("b", F.bround(F.col("b"), 0)).withColumn("a", F.when(F.col("id") % 11 > 0, F.floor(F.col("a") / 4).cast("double")))
    growth = boost.Growth(l1=1e-3, l2=0.1, row_share=0.8, tree_columns=0.7)

    def fitted(folder=None):
        return [model.random_forest(df, cols, trees=7, key="id"), model.boosted_trees(df, cols, rounds=5, key="id"),
                boost.boosted(df, cols, rounds=7, growth=growth, base=0.5, key="id", folder=folder, every=2)]

    by_row = fitted()
    read = []
    plain = boost.sums_of
    monkeypatch.setattr(boost, "sums_of", lambda rows, run, size: (read.append(rows.count()), plain(rows, run, size))[1])
    monkeypatch.setattr(boost, "cell_tasks", lambda rows: 2)
    monkeypatch.setattr(boost, "CELL_ROWS", 1)
    monkeypatch.setattr(boost, "CELL_TREES", 3)  # seven trees are three blocks
    folder = str(tmp_path / "run")
    boost.boosted(df, cols, rounds=5, growth=growth, base=0.5, key="id", folder=folder, every=2)
    by_cell = fitted(folder)
    for a, b in zip(by_row, by_cell):
        same_trees(a, b)
    assert read and max(read) < 450  # every level read fewer rows than half of the table's


def test_scores_are_those_of_the_thresholds(spark):
    df, cols, x, _ = frame(spark)
    m = model.random_forest(df, cols, trees=9, key="id")
    odd = df.withColumn("a", F.when(F.col("id") % 5 == 1, None).when(F.col("id") % 5 == 2, float("nan")).otherwise(F.col("a")))
    x[:, 0] = np.where(np.isin(np.arange(len(x)) % 5, (1, 2)), np.nan, x[:, 0])

    def plain(row):
        out = m.base
        for t in m.trees:
            at = 1
            while t.feature[at] >= 0:
                at = 2 * at + int(row[t.feature[at]] > t.threshold[at])
            out += t.value[at]
        return out

    got = [r.prediction for r in m.transform(odd).orderBy("id").collect()]
    assert np.allclose(got, [plain(r) for r in x])


def test_rounds_in_one_task_are_those_of_a_job_a_level(spark, monkeypatch, tmp_path):
    """A task that holds the rows, or the cells, grows what jobs over the rows grow: with gaps, columns drawn for trees and nodes,
    rows drawn, and where a run stops in between."""
    df, cols, _, _ = frame(spark, n=900)
    df = df.withColumn("a", F.when(F.col("id") % 11 > 0, F.col("a")))
    few = df.withColumns({"b": F.bround(F.col("b"), 0), "a": F.floor(F.col("a") / 4).cast("double")})
    drawn = boost.Growth(l1=1e-3, l2=0.1, row_share=0.8, tree_columns=0.7, node_columns=1)

    def fitted(x, folder=None):
        return [model.boosted_trees(x, cols, rounds=6, key="id"), boost.boosted(x, cols, rounds=7, growth=drawn, base=0.5, key="id", folder=folder, every=3)]

    read = []
    plain = boost.sums_of
    monkeypatch.setattr(boost, "sums_of", lambda rows, run, size: (read.append(rows.count()), plain(rows, run, size))[1])
    held = [fitted(x) for x in (df, few)]
    assert not read  # no level was a job
    monkeypatch.setattr(boost, "TASK_BYTES", 0)
    jobs = [fitted(x) for x in (df, few)]
    assert len(read) > 40
    monkeypatch.setattr(boost, "cell_tasks", lambda rows: 2)
    monkeypatch.setattr(boost, "CELL_ROWS", 1)
    monkeypatch.setattr(boost, "CELL_TREES", 3)
    monkeypatch.setattr(boost, "TASK_BYTES", 450 * (3 + boost.ROW_BYTES))  # the cells fit, the rows do not
    del read[:]
    folder = str(tmp_path / "run")
    boost.boosted(few, cols, rounds=5, growth=drawn, base=0.5, key="id", folder=folder, every=3)
    assert spark.read.parquet(f"{folder}/trees").agg(F.max("round")).first()[0] == 3
    by_cell = fitted(few, folder)
    assert not read
    for a, b in ((held[0], jobs[0]), (held[1], jobs[1]), (by_cell, jobs[1])):
        for s, t in zip(a, b):
            same_trees(s, t)
            assert np.allclose(s.importances, t.importances)


def test_merged_cells_are_one_row_each(spark):
    """Sums of several tasks meet in one row a cell, with the weights and labels of all rows."""
    df, cols, _, _ = frame(spark, n=900, parts=5)
    few = df.withColumns({"b": F.bround(F.col("b"), 0), "a": F.floor(F.col("a") / 4).cast("double")})
    rows, _ = boost.binned(few, cols, "label", "id")
    rows = rows.repartition(5, "h")
    p = boost.Growth(row_share=0.8)
    got, apart = (boost.summed(rows, range(2, 4), [], 0.5, 1.0, 3, p, merged=m).rows.collect() for m in (True, False))
    assert len({bytes(r.bins) for r in got}) == len(got) < len(apart)
    for i in range(2):
        assert sum(r.w[i] for r in got) == sum(r.w[i] for r in apart) and sum(r.y[i] for r in got) == pytest.approx(sum(r.y[i] for r in apart))
    want = {}
    for r in rows.collect():
        w = boost.row_weights(np.array([r.h]), p, 3)[0]
        s = want.setdefault(bytes(r.bins), [0.0, 0.0])
        s[0], s[1] = s[0] + w, s[1] + w * (r.label - 1.0)
    assert want.keys() == {bytes(r.bins) for r in got}
    assert all(r.w[1] == want[bytes(r.bins)][0] and r.y[1] == pytest.approx(want[bytes(r.bins)][1]) for r in got)
