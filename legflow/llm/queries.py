"""Registered queries of the llm operators: one over each operator's whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from pyspark.sql import functions as F

from legflow.llm import (
    chat, decontaminate, license, mixing, neardup, oracle, quality, ranked, repair, secrets, spans, toxicity, urls, voronoi)
from legflow.llm.shared import table

#: Production mixture: sources by domain, and integer weights by tree level (1 where none is given).
DOMAINS = {"web": [f"src{i}" for i in range(8)], "books": [f"src{i}" for i in range(8, 14)], "news": [f"src{i}" for i in range(14, 18)]}
MIX_WEIGHTS = {"domain": {"web": 50, "books": 30, "news": 15, "other": 5}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
               "source": {"src0": 3, "src9": 2}}
MIX_EPOCHS, MIX_SEED = 3, 17
#: Budget: nine tenths of the corpus' words.
MIX_BUDGET = "sum(words) * 9 div 10"


def domain() -> Column:
    out = F.lit("other")
    for name, sources in DOMAINS.items():
        out = F.when(F.col("source").isin(sources), F.lit(name)).otherwise(out)
    return out


def mixed(docs: DataFrame, texts: bool = False) -> DataFrame:
    return mixing.mix(docs, domain(), F.expr(MIX_BUDGET), MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED, texts=texts)


def op1_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def op2_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op3_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup(table(spark, sf_dir, "documents"))


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_segment_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.mark(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op8_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_license_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.licenses(table(spark, sf_dir, "documents"))


def op10_fingerprinted_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], rows.schema)
    records = chat.as_records(rows.unionByName(extra))
    return chat.digests(chat.formatted(chat.canonical(records)))


def op11_lightest_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired_conversations(table(spark, sf_dir, "conversations"))


#: Rule list of the url filter: (host and path prefix, verdict).
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op12_url_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules, keep=["page_id"])


def op13_bag_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_source_mixture, op2_hyperminhash, op3_linked_secrets, op4_sentence_spans, op5_pu_quality, op6_segment_toxicity,
    op7_prefix_join, op8_voronoi_knn, op9_license_alignment, op10_fingerprinted_chat,
    op11_lightest_repair, op12_url_expressions, op13_bag_ranking, pipeline)}
#: The other queries have no SQL form (look-around patterns, word hashes, fitted models, alignments); tests/llm checks them.
ORACLE_SQL = {
    "op1_source_mixture": oracle.mixture(DOMAINS, MIX_WEIGHTS, MIX_EPOCHS, MIX_SEED, MIX_BUDGET),
    "op2_hyperminhash": oracle.near_duplicates(2, 80),
    "op7_prefix_join": oracle.decontaminated(decontaminate.WINDOW),
    "op8_voronoi_knn": oracle.nearest(20, voronoi.SCALE),
    "op10_fingerprinted_chat": oracle.conversations(),
    "op11_lightest_repair": oracle.repaired(),
    "op12_url_expressions": oracle.filtered_urls(URL_RULES),
    "op13_bag_ranking": oracle.ranked(ranked.TOP, ranked.NORM),
}
