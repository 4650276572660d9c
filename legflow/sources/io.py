"""Readers and writers (S1..S7).

Delimited text is read with an explicit schema (no inference); every value
arrives as text and is typed with ``try_cast`` so bad values become NULL
instead of failing the job (ANSI mode).  Written tables are parquet or
tab-separated text; split sets are partitioned folders so readers prune.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from legflow.functions.nulls import to_double
from legflow.operators.clean import with_dense_key
from legflow.session import checkpoint_path

# Station-feed fields after the leading station field, in feed order.
FEED_FIELDS = [
    "time", "air_temperature", "wind_direction", "wind_speed", "visibility", "wind_gust",
    "cloud_coverage_lvl_1", "cloud_coverage_lvl_2", "cloud_coverage_lvl_3", "cloud_height_lvl_1",
    "cloud_height_lvl_2", "cloud_height_lvl_3", "ice_accretion_1h", "ice_accretion_3h", "ice_accretion_6h",
    "peak_wind_gust", "peak_wind_direction",
]


def text_schema(cols: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in cols])


def read_delimited(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str], sep: str = "\t",
                   encoding: str = "UTF-8", date_cols: Sequence[str] = (),
                   types: Mapping[str, str] | None = None) -> DataFrame:
    """Delimited text with a header; dates to timestamp-without-zone,
    ``types`` (column -> Spark type) by ``try_cast``; bad values to NULL."""
    df = (spark.read.schema(text_schema(columns)).option("header", True).option("sep", sep)
          .option("encoding", encoding).option("mode", "PERMISSIVE").csv(path))
    casts = {c: F.col(c).try_cast("timestamp_ntz") for c in date_cols}
    for c, t in (types or {}).items():
        casts[c] = to_double(c) if t == "double" else F.col(c).try_cast(t)
    return df.withColumns(casts)


def read_mixed_folder(spark: SparkSession, paths: Sequence[str], sep: str = "\t", encoding: str = "UTF-8") -> DataFrame:
    """Files whose headers differ; each read with its own header, unioned by name.

    One job reads the header lines of all paths (the first line of each file's
    first block), and the files that share a header are one scan, so the plan
    grows with the number of layouts and not with the number of files.  A path
    may be a folder or a pattern.  Empty files add nothing.
    """
    lines = (spark.read.schema("line string").option("sep", "\u0001").option("quote", "").option("encoding", encoding).csv(list(paths))
             .where("_metadata.file_block_start = 0")
             .select(F.col("_metadata.file_path").alias("path"), "line", F.monotonically_increasing_id().alias("nth")))
    first = lines.groupBy("path").agg(F.min_by("line", "nth").alias("line"))
    layouts = first.groupBy("line").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy(F.col("paths")[0]).collect()
    if not layouts:
        return spark.read.option("header", True).option("sep", sep).option("encoding", encoding).csv(list(paths))
    out = None
    for layout in layouts:
        # file paths come as URIs, and the reader takes patterns: undo the one's escapes, add the other's
        files = [re.sub(r"([\[\]{}*?])", r"\\\1", unquote(p)) for p in layout["paths"]]
        part = spark.read.option("header", True).option("sep", sep).option("encoding", encoding) \
            .option("inferSchema", False).csv(files)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def merge_sources(*frames: DataFrame) -> DataFrame:
    """S3: one leg table from several sources with the same meaning."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_station_feed(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Comma text, header line, first field the station; blank lines skipped by
    the reader.  ``feed_seq`` is the row's place in the feed: by file name, then
    by split, then by line.  It does not change with how splits are packed."""
    df = (spark.read.schema(text_schema(["station", *FEED_FIELDS])).option("header", True)
          .option("mode", "PERMISSIVE").csv(path))
    df = (df.withColumn("time", F.col("time").try_cast("timestamp_ntz"))
          .select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"),
                  F.monotonically_increasing_id().alias("__line")))
    return with_dense_key(df, ["__file", "__start", "__line"], "feed_seq").drop("__file", "__start", "__line")


def write_tab(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tab-separated text with a header, no index."""
    df.write.mode(mode).option("sep", "\t").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def store_model_sets(df: DataFrame, path: str, target: str, fleet_type: str, split_col: str = "split",
                     imputed: bool = False, encoding: str = "none") -> None:
    """Model sets keyed by target, fleet type, imputed flag, encoding and split, as
    partition folders.  Writing a set again replaces it and leaves the others."""
    x = df.withColumns({"target": F.lit(target), "fleet_type": F.lit(fleet_type), "imputed": F.lit(imputed),
                        "encoding": F.lit(encoding)})
    (x.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("target", "fleet_type", "imputed", "encoding", split_col).parquet(path))


def load_model_set(spark: SparkSession, path: str, target: str, fleet_type: str, split: str,
                   split_col: str = "split", imputed: bool = False, encoding: str = "none") -> DataFrame:
    """One set; the filter prunes partition folders at planning time."""
    return spark.read.parquet(path).where(
        (F.col("target") == target) & (F.col("fleet_type") == fleet_type) & (F.col("imputed") == imputed)
        & (F.col("encoding") == encoding) & (F.col(split_col) == split))


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (``spark.checkpoint.dir``)."""
    return checkpoint_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def load_chain(path: str):
    """Reload a fitted chain written by ``FittedChain.save``: exactly the parts its manifest
    lists; a part that cannot be read is an error."""
    import json

    from pyspark.ml import PipelineModel

    from legflow.operators import boost, encode
    from legflow.operators.model import FittedChain

    spark = SparkSession.getActiveSession()
    manifest = json.loads(spark.read.parquet(os.path.join(path, "manifest")).first()["manifest"])
    kind = manifest.get("model", "pipeline")
    if kind == "pipeline":
        model = PipelineModel.load(os.path.join(path, "model"))
    else:
        state = json.loads(spark.read.parquet(os.path.join(path, "model", "state")).first()["state"])
        model = {"trees": boost.EnsembleModel, "stacked": boost.StackedModel}[kind].of(state)
    parts = {}
    for name in manifest["parts"]:
        row = spark.read.parquet(os.path.join(path, name, "state")).first()
        st = json.loads(row["state"])
        if row["kind"] == "scaler":
            parts[name] = encode.ScalerModel(st["cols"], st["center"], st["scale"])
        elif row["kind"] == "pca":
            parts[name] = encode.PCAModel(**st)
        elif row["kind"] == "leave_one_out":
            levels = spark.read.parquet(os.path.join(path, name, "levels"))
            parts[name] = encode.LeaveOneOutModel(st["cols"], st["label"], st["suffix"], st["prior"], levels, st["min_count"])
        else:
            raise ValueError(f"unknown part {row['kind']!r} in {path}")
    return FittedChain(parts.get("encoder"), parts.get("scaler"), parts.get("pca"), manifest["columns"], model, manifest["label"])
