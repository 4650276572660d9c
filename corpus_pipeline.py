"""Corpus pipeline: five stages, each written as Parquet and read again before the next.

A stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept.  All but the last return the columns of ``docs``.  Null or empty texts
pass the first four stages unchanged (they hold no evidence of anything);
the last takes only documents with words.  Empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legflow.llm import decontaminate, neardup, queries, secrets, toxicity
from legflow.llm.shared import cut, is_empty, shared_folder, table


#: Ids (8 bytes each) that a join may send to every executor.
BROADCAST_IDS = 1_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), prefix="__llm_")
    return scored.filter("__llm_predicted = 0").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity 0.8 or more: that of smallest doc_id.

    Rows that share a doc_id are one document; of these the row of least text
    digest stays.  Rows without an id all stay.
    """
    groups = cut(neardup.near_duplicates(docs.select("doc_id", "text"), k=5, percent=80).select("doc_id", "kept"))
    losers = cut(groups.filter(~F.col("kept")).select("doc_id").distinct())
    # up to a counted size the ids go to the texts; beyond it both are shuffled
    stay = docs.join(F.broadcast(losers) if losers.count() <= BROADCAST_IDS else losers, "doc_id", "left_anti").select(docs.columns)
    repeated = cut(groups.filter("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    if is_empty(repeated):
        return stay
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    once = stay.join(repeated, "doc_id", "left_semi").withColumn("__llm_nth", nth).filter("__llm_nth = 1").select(docs.columns)
    return stay.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lie in benchmark windows."""
    marked = decontaminate.mark(docs, table(spark, sf_dir, "benchmark"), prefix="__llm_")
    return marked.filter("not __llm_contaminated").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret span of their text replaced."""
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the target mixture takes: words of each document, its text for whole epochs, and its prefix in the last one."""
    return queries.mixed(docs, texts=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
]

#: The toxicity model and the near-duplicate groups have no SQL form; tests/llm checks run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
