"""Readers: explicit schemas, bad values to NULL, blank lines skipped, feed order kept."""

import os

from legflow.sources import io


def test_delimited_bad_values_become_null(spark, tmp_path):
    p = tmp_path / "legs.tsv"
    p.write_text("leg_id\toff_block_date\tdelay_minutes\n1\t2024-01-01 10:00:00\t5\n2\tnot a time\tM\n")
    df = io.read_delimited(spark, str(p), ["leg_id", "off_block_date", "delay_minutes"], sep="\t",
                           date_cols=["off_block_date"], types={"leg_id": "bigint", "delay_minutes": "double"})
    rows = sorted(df.collect(), key=lambda r: r.leg_id)
    assert rows[0].delay_minutes == 5.0 and rows[0].off_block_date is not None
    assert rows[1].off_block_date is None and rows[1].delay_minutes is None


def test_station_feed_skips_blank_lines_and_keeps_order(spark, tmp_path):
    header = "station," + ",".join(io.FEED_FIELDS)
    filler = ",".join(["M"] * (len(io.FEED_FIELDS) - 1))
    lines = [header, f"LPPT,2024-01-01 00:30,{filler}", "", f"LPPT,2024-01-01 01:30,{filler}", "",
             f"LPPT,2024-01-01 02:30,{filler}"]
    p = tmp_path / "feed.txt"
    p.write_text("\n".join(lines) + "\n")
    df = io.read_station_feed(spark, str(p)).orderBy("feed_seq").collect()
    assert [r.time.hour for r in df] == [0, 1, 2]
    assert all(r.station == "LPPT" for r in df)


def test_partitioned_sets_prune_by_folder(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "CAST(id AS DOUBLE) AS label",
                                    "CASE WHEN id < 3 THEN 'test' ELSE 'train' END AS split")
    path = str(tmp_path / "sets")
    io.store_model_sets(df, path, "air_time", "nb")
    folder = os.path.join(path, "target=air_time", "fleet_type=nb", "imputed=false", "encoding=none")
    assert sorted(os.listdir(folder)) == ["split=test", "split=train"]
    io.store_model_sets(df.limit(4), path, "air_time", "nb", encoding="one_hot")
    io.store_model_sets(df, path, "air_time", "nb")  # a rerun replaces the set
    got = io.load_model_set(spark, path, "air_time", "nb", "test")
    assert got.count() == 3
    assert io.load_model_set(spark, path, "air_time", "nb", "test", encoding="one_hot").count() == 3
    assert "PartitionFilters: [isnotnull(target" in got._jdf.queryExecution().executedPlan().toString()


def test_mixed_folder_is_one_scan_a_layout(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"a {i}%.tsv").write_text(f"id\tx\n{i}\tv{i}\n")
    (tmp_path / "b[1].tsv").write_text("x\tid\nw\t7\n")
    (tmp_path / "c.tsv").write_text("id\ty\n8\t\"two words\"\n9\t\n")
    (tmp_path / "empty.tsv").write_text("")
    df = io.read_mixed_folder(spark, [str(tmp_path)])
    got = sorted((r.id, r.x, r.y) for r in df.collect())
    assert got == [(str(i), f"v{i}", None) for i in range(6)] + [("7", "w", None), ("8", None, "two words"), ("9", None, None)]
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 3
    few = io.read_mixed_folder(spark, [str(tmp_path / "c.tsv"), str(tmp_path / "a 0%.tsv")])
    assert few.count() == 3 and set(few.columns) == {"id", "x", "y"}


def test_mixed_folder_without_lines(spark, tmp_path):
    (tmp_path / "empty.tsv").write_text("")
    assert io.read_mixed_folder(spark, [str(tmp_path)]).count() == 0
