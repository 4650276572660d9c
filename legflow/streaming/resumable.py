"""Resumable enrichment.

The reference cuts the leg table into chunks, skips chunks already written
and writes one file per finished chunk.  Two Spark forms keep that contract:

* ``enrich_missing`` (batch): legs whose key is not yet in the output table
  (``left_anti``) are enriched and appended; rerunning after a failure does
  only the remainder, and the output equals a one-shot run.
* ``start_enrichment_stream`` (Structured Streaming): new leg files in a
  folder are enriched per micro-batch in ``foreachBatch`` (the window form
  of the nearest join does not run on a stream directly) and appended; the
  query's checkpoint beside the output records finished files, so a
  restarted query resumes where it stopped, in a new session too.  ``availableNow`` processes
  what is there and stops.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from legflow.operators import enrich
from legflow.session import ensure_checkpoint_dir


def _output_keys(spark: SparkSession, out_path: str, key: str) -> DataFrame | None:
    """Keys written so far, or None before the first write; any other failure is raised."""
    try:
        return spark.read.parquet(out_path).select(key)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # no folder, or a folder without files
            return None
        raise


def enrich_missing(legs: DataFrame, weather: DataFrame, codes: DataFrame, out_path: str,
                   key: str = "leg_id", bucket_minutes: int = 60) -> int:
    """Enrich the legs not yet present in ``out_path`` and append them; returns rows appended."""
    spark = legs.sparkSession
    ensure_checkpoint_dir(spark)
    done = _output_keys(spark, out_path, key)
    todo = legs if done is None else legs.join(done, key, "left_anti")
    enriched = enrich.enrich_both_ends(todo, weather, codes, bucket_minutes=bucket_minutes)
    seen = Observation("appended")
    enriched.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(out_path)
    return seen.get["n"]


def start_enrichment_stream(spark: SparkSession, legs_dir: str, legs_schema, weather: DataFrame,
                            codes: DataFrame, out_path: str, name: str = "enrichment",
                            available_now: bool = True, max_files_per_trigger: int = 8) -> StreamingQuery:
    """Stream leg files from ``legs_dir`` through the two-ended enrichment into ``out_path``."""
    # the query's state lies beside its output (readers skip underscore folders), so a restart in any session finds it
    checkpoint = os.path.join(out_path, f"_state-{name}")
    stream = (spark.readStream.schema(legs_schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(legs_dir))

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        # one folder per micro-batch, overwritten on a retry: a replayed batch
        # never duplicates rows (foreachBatch itself is at-least-once)
        out = enrich.enrich_both_ends(batch, weather, codes)
        out.write.mode("overwrite").parquet(os.path.join(out_path, f"epoch={epoch_id}"))

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
