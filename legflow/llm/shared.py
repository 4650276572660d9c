"""Session helpers of the llm operators: shared folder, lineage cuts, digests, bounded bitmaps."""

from __future__ import annotations

import pickle
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Whole texts make large Arrow batches: where the session has Spark's default of 10,000 rows, take 2,000."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "2000")


def ensure_shared_folder(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable: the cluster's ``spark.checkpoint.dir``, or a scratch folder in local mode only."""
    small_batches(spark)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="llm-checkpoint-")
    sc.setCheckpointDir(folder)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``checkpoint()`` writes to."""
    ensure_shared_folder(spark)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    ensure_shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read again: computed one time, and columns are pruned."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str = "text") -> list[Column]:
    """Two 64-bit digests that stand for a text (null counts as empty)."""
    t = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(t).alias("k1"), F.xxhash64(t, F.lit(1)).alias("k2")]


def is_empty(df: DataFrame) -> bool:
    return len(df.take(1)) == 0


class Sent:
    """A value on its way to tasks: a broadcast of its pickle by value, so executors need not import the package to open it."""

    def __init__(self, spark: SparkSession, value):
        self.bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        return pickle.loads(self.bytes.value)

    def unpersist(self) -> None:
        self.bytes.unpersist()


BITMAP_BITS = 1 << 25


def hash_bitmap(rows: DataFrame, column: str, bits: int = BITMAP_BITS):
    """A Bloom bitmap of a column of 64-bit hashes as a numpy array of ``bits`` bits, whatever the number of rows.

    Built by a distributed ``bit_or`` over at most ``bits / 64`` words, so what
    reaches the driver is bounded by the parameter.  False positives only cost
    work: callers join exactly afterwards.
    """
    import numpy as np

    h = F.col(column)
    spots = F.explode(F.array(F.pmod(h, F.lit(bits)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(bits)))).alias("bit")
    words = (rows.select(spots).select((F.col("bit") / 64).cast("int").alias("word"),
                                       F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("mask"))
             .groupBy("word").agg(F.expr("bit_or(mask)").alias("mask")).toPandas())
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).astype(np.uint64)
    return out


def id_bitmap(ids: DataFrame, column: str, bits: int = BITMAP_BITS):
    """The bitmap of the xxhash64 digests of an id column."""
    return hash_bitmap(ids.select(F.xxhash64(column).alias("digest")), "digest", bits)


def bitmap_has(bitmap, digest):
    """Which int64 hashes may be in ``bitmap``."""
    import numpy as np

    bits = len(bitmap) * 64
    digest = np.asarray(digest, np.int64)
    hit = np.ones(len(digest), bool)
    for spot in (digest % bits, (digest.view(np.uint64) >> np.uint64(32)).astype(np.int64) % bits):
        hit &= ((bitmap[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
    return hit


def extended(schema, extra: str):
    """A schema with the columns of the DDL text ``extra`` appended."""
    from pyspark.sql import types as T

    return T.StructType([*schema.fields, *T._parse_datatype_string(extra).fields])
