"""Results that only show above one partition, with rare levels, repeated keys, null labels or large keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from legflow.functions.nulls import uniform, uniform_sql
from legflow.operators import clean, encode, evaluate, impute, model, quantiles, report
from legflow.session import ensure_checkpoint_dir
from legflow.sources import io
from legflow.streaming import resumable


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_dense_key_keeps_every_wide_row(spark, adaptive):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 3_000_000 if adaptive == "true" else 400_000
        df = spark.range(0, n, 1, 24).select("id", ((F.col("id") * 7919) % 1_000_003).alias("t"),
                                             F.sha2(F.col("id").cast("string"), 256).alias("wide"), F.lit(1.5).alias("x"))
        k = clean.with_dense_key(df, ["t", "id"], "rk")
        r = k.agg(F.count("*").alias("n"), F.countDistinct("rk").alias("d"), F.min("rk").alias("lo"), F.max("rk").alias("hi"),
                  F.count_if(F.sha2(F.col("id").cast("string"), 256) != F.col("wide")).alias("bad")).first()
        assert (r.n, r.d, r.lo, r.hi, r.bad) == (n, n, 0, n - 1, 0)
        j = k.alias("a").join(k.select((F.col("rk") - 1).alias("rk"), F.col("t").alias("t2"), F.col("id").alias("id2")), "rk")
        assert j.filter("t2 < t or (t2 = t and id2 < id)").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_value_ranks_above_one_partition(spark):
    n = 600_000
    df = spark.range(0, n, 1, 16).select((F.col("id") % 3).alias("g"), ((F.col("id") * 31) % 200_003).cast("double").alias("v"))
    r = quantiles.value_ranks(df, "g", "v")
    assert r.agg(F.sum("cnt")).first()[0] == n
    got = {x.g: (x.hi, x.n) for x in r.groupBy("g").agg(F.max(F.col("below") + F.col("cnt")).alias("hi"), F.max("n").alias("n")).collect()}
    assert got == {g: (200_000, 200_000) for g in range(3)}


def test_components_of_a_long_path(spark):
    e = spark.range(0, 400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(
        spark.createDataFrame([(900, 900), (950, 940)], "a long, b long"))
    got = {r.node: r.component for r in report.connected_components(e, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(401)}, 900: 900, 940: 940, 950: 940}


def test_folds_keep_rows_without_a_label(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(20)], "id long, label string")
    f = model.stratified_folds(df, "label", "id")
    assert f.columns == ["id", "label", "fold"]
    got = f.groupBy("label", "fold").count().collect()
    assert sum(r["count"] for r in got) == 20 and {r["count"] for r in got} == {2}


def test_uniform_takes_any_key(spark):
    import duckdb

    keys = [0, 1, 4_000_000_000, 2 ** 62, -5, -2 ** 40]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = [r.u for r in df.select(uniform("k", 7, 3812015801).alias("u")).collect()]
    values = ", ".join(f"({k})" for k in keys)
    want = [r[0] for r in duckdb.sql(f"SELECT {uniform_sql('k', 7, 3812015801)} FROM (VALUES {values}) t(k)").fetchall()]
    assert got == want and all(0 <= u < 1 for u in got)


def test_chained_equations_go_by_column_not_by_position(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(0, 1, 600)
    full = [(i, float(x), float(5 * x + 2), float(x - 1)) for i, x in enumerate(a)]

    def gaps(rate_a, rate_b, seed):
        r = np.random.default_rng(seed)
        return spark.createDataFrame([(i, None if r.random() < rate_a else x, None if r.random() < rate_b else y, z) for i, x, y, z in full],
                                     "k long, a double, b double, c double")

    imp = impute.IterativeImputer(["a", "b", "c"], "k", max_iter=3).fit(gaps(0.05, 0.3, 1))
    out = {r.k: r for r in imp.transform(gaps(0.3, 0.05, 2)).collect()}
    assert max(abs(out[i].a - x) for i, x, _, _ in full) < 1e-3 and max(abs(out[i].b - y) for i, _, y, _ in full) < 1e-3


def test_reconstruction_keeps_repeated_keys_single(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, None), (2, 3.0, 6.0), (2, 4.0, 8.1), (3, None, 10.0)], "k long, a double, b double")
    out = impute.ReconstructImputer(["a", "b"], "k", k=1, max_iter=3).fit(df).transform(df)
    assert out.count() == 5 and out.filter("a is null or b is null").count() == 0


def test_singleton_level_scores_as_the_global_mean(spark):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0)], "c string, label double")
    m = encode.LeaveOneOutEncoder(["c"], "label", "_e").fit(train)
    got = {r.c: r.c_e for r in m.transform(spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string")).collect()}
    assert got == {"a": 2.0, "b": pytest.approx(14 / 3), "z": pytest.approx(14 / 3), None: pytest.approx(14 / 3)}


def test_one_hot_vector_has_no_level_bound(spark):
    df = spark.createDataFrame([(i, f"v{i:03}") for i in range(50)] + [(99, None)], "id long, c string")
    with pytest.raises(ValueError):
        encode.OneHotEncoder(["c"], max_levels=10).fit(df)
    got = {r.id: r for r in encode.one_hot_vector(df, ["c"]).collect()}
    assert got[7].c == "v007" and got[7].c_vec.size == 50 and list(got[7].c_vec.indices) == [7] and got[99].c_vec is None


def test_permutation_deals_every_value_once(spark):
    df = spark.range(0, 5000).select("id", (F.col("id") % 13).cast("double").alias("v"))
    out = evaluate.permuted(df, "v", "id")
    assert out.count() == 5000 and sorted(r.v for r in out.collect()) == sorted(r.v for r in df.collect())
    assert out.filter("v <> id % 13").count() > 3000


def test_stacking_does_not_follow_partitioning(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, float(x), float(y), float(3 * x - y + e)) for i, (x, y, e) in enumerate(rng.normal(size=(200, 3)))],
                               "id long, x double, y double, label double")
    runs = [{r.id: round(r.prediction, 9) for r in model.fit_chain(d, "stacking", ["x", "y"], rounds=3, key="id").transform(df).collect()}
            for d in (df.coalesce(1).orderBy("id"), df.repartition(5).sortWithinPartitions("id"))]
    assert max(abs(runs[0][i] - runs[1][i]) for i in runs[0]) < 0.2
    assert "SortMergeJoin" not in model.fit_chain(df, "stacking", ["x", "y"], rounds=2).transform(df)._jdf.queryExecution().toString()


def test_best_grid_point_is_refitted(spark):
    from pyspark.ml.feature import VectorAssembler

    df = spark.range(60).select((F.col("id") % 5).cast("int").alias("fold"), F.col("id").cast("double").alias("x"), (F.col("id") * 2.0 + 1).alias("label"))
    v = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    make = lambda p: (lambda d: model.ridge(d, alpha=p["alpha"]).fit(d))
    grid = {"alpha": [1e6, 1e-6]}
    params, fitted = model.refit_best(v, make, grid, model.grid_search(v, make, grid))
    assert params == {"alpha": 1e-6} and fitted.coefficients[0] == pytest.approx(2.0, abs=1e-4)


def test_grids_and_named_chains():
    assert {len(model.model_grid(n, 12)) for n in ("xgb", "rf")} == {10} and len(model.model_grid("gb", 12)) == 40
    assert len(model.model_grid("ridge", 12)) == 2 * 6 * 2 * 5 + 6 * 3
    assert model.chain_of("ridge", 5)["chi2_k"] == 5 and model.chain_of("gb", 40) == dict(scaler="robust", pca_k=31, whiten=True)
    with pytest.raises(ValueError):
        model.chain_of("svm", 3)


def test_reload_fails_on_a_missing_part(spark, tmp_path):
    import shutil

    df = spark.createDataFrame([(float(i), float(2 * i)) for i in range(30)], "a double, label double")
    path = str(tmp_path / "chain")
    model.fit_chain(df, "ridge", ["a"]).save(path)
    assert io.load_chain(path).transform(df).count() == 30
    shutil.move(f"{path}/scaler", f"{path}/gone")
    with pytest.raises(Exception):
        io.load_chain(path)


def test_only_a_missing_output_counts_as_empty(spark, tmp_path):
    assert resumable._output_keys(spark, str(tmp_path / "none"), "leg_id") is None
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        resumable._output_keys(spark, str(bad), "leg_id").count()


def test_feed_order_does_not_follow_packing(spark, tmp_path):
    head = "station," + ",".join(io.FEED_FIELDS)
    rest = ",".join(["M"] * (len(io.FEED_FIELDS) - 1))
    for f in range(6):
        (tmp_path / f"f{f}.csv").write_text(head + "\n" + "".join(f"S{f},2024-01-01 {h:02}:00,{rest}\n" for h in range(5)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    try:
        for size in ("200", "134217728"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            seen.append([(r.feed_seq, r.station, r.time.hour) for r in io.read_station_feed(spark, str(tmp_path)).orderBy("feed_seq").collect()])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert seen[0] == seen[1] == [(5 * f + h, f"S{f}", h) for f in range(6) for h in range(5)]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_partitions_of_the_enrichment_follow_the_tables(spark, monkeypatch, tmp_path):
    from legflow.operators import enrich

    spark.range(500).selectExpr(
        "id as leg_id", "concat('A', id % 3) as origin_airport", "concat('A', id % 4) as destination_airport",
        "case when id % 9 > 0 then timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 7 % 2880) end as off_block_date",
        "timestamp_ntz'2024-01-01 01:00:00' + make_interval(0, 0, 0, 0, 0, id * 11 % 2880) as on_block_date").write.parquet(str(tmp_path / "legs"))
    spark.range(400).selectExpr("id as feed_seq", "concat('S', id % 3) as station", "cast(id as string) as wind_speed",
                                "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 13 % 2880) as time").write.parquet(str(tmp_path / "obs"))
    legs, obs = spark.read.parquet(str(tmp_path / "legs")), spark.read.parquet(str(tmp_path / "obs"))
    codes = spark.createDataFrame([("A0", "S0"), ("A1", "S1"), ("A2", "S2")], "iata string, icao string")
    few = enrich.enrich_both_ends(legs, obs, codes)
    monkeypatch.setattr(enrich, "PART_BYTES", 1 + enrich.plan_bytes(legs) // 40)
    many = enrich.enrich_both_ends(legs, obs, codes)
    parts = enrich.parts_for(legs, obs)
    assert parts > 40 and few.where("origin_wind_speed is not null").count() > 100
    assert many.rdd.getNumPartitions() == parts
    assert few.exceptAll(many).count() == many.exceptAll(few).count() == 0


def test_reloaded_scores_are_compared_without_a_join(spark, tmp_path):
    """Rows that share an id count once for every pair, as in a join of the two scorings."""
    import __spark_entry__ as entry

    rows = spark.range(400).selectExpr(
        "id div 2 as l_orderkey", "id div 2 as l_partkey", "1L as l_suppkey", "1 as l_linenumber", "cast(id div 2 % 50 as double) as l_quantity",
        "cast((id div 2) * 7 % 1000 as double) as l_extendedprice", "cast(id div 2 % 11 as double) / 100 as l_discount", "cast(id div 2 % 9 as double) / 100 as l_tax",
        "case when id div 2 % 3 = 0 then 'R' else 'N' end as l_returnflag", "'F' as l_linestatus", "timestamp_ntz'2024-01-01 00:00:00' as l_shipdate")
    rows.write.parquet(str(tmp_path / "lineitem.parquet"))
    from legflow.operators import model
    from legflow.plans.q_ml import li_row_id

    _, test = model.train_test_split(rows.select(li_row_id().alias("row_id")), "row_id")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = entry.queries()["s7_model_save_and_reload"](spark, str(tmp_path))
        assert "SortMergeJoin" not in out._jdf.queryExecution().sparkPlan().toString()
        got = out.first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert got["n_scored"] == 2 * test.count() > 0 and got["max_abs_diff"] == 0
