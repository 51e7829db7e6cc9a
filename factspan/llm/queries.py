"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factspan.llm.alignment import tokenizer_alignment
from factspan.llm.centroids import centroid_clusters
from factspan.llm.chat import perspectives
from factspan.llm.decontaminate import leaks
from factspan.llm.hmm import language_scores
from factspan.llm.mixture import mixed_to_weights
from factspan.llm.neardup import near_duplicates
from factspan.llm.quality import quality_scores
from factspan.llm.runindex import without_repeats
from factspan.llm.substring import without_passages
from factspan.llm.topk import top_k
from factspan.llm.toxicity import severities
from factspan.llm.warc import read_archives, write_archives


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_block_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=20, scale=64, every=20)


def op2_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_scores(docs, labels, folds=5, fold=0, threshold=0.3)


def op3_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"), folds=5, fold=1)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op5_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_seed_extend_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_passages(table(spark, sf_dir, "documents"), length=50)
    digest = F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    return rows.select("doc_id", "n_words", "n_removed", digest)


def op8_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed_to_weights(table(spark, sf_dir, "documents"), (5, 2, 1), percent=150, most=2)
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op9_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = perspectives(table(spark, sf_dir, "conversations"))
    shown = F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["stop"]))
    mask = F.array_join(shown, ",").alias("mask")
    return views.select("conv_id", "speaker", "piece", "n_turns", "rendered", mask)


def op10_run_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(table(spark, sf_dir, "documents"), length=400)
    digest = F.sha2("kept", 256).alias("kept_sha256")
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", digest)


def op11_table_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = centroid_clusters(
        table(spark, sf_dir, "embeddings"), k=8, rounds=10, width=64, scale=1024, seed=3
    )
    digest = F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256")
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest)


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokenizer_alignment(table(spark, sf_dir, "documents"))
    digest = F.coalesce(F.lower(F.hex("groups")), F.lit("")).alias("groups_sha256")
    return rows.select(*[c for c in rows.columns if c != "groups"], digest)


def op13_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = write_archives(table(spark, sf_dir, "pages"), least_bytes=0)
    rows = read_archives(index, folder)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    f.__name__: f
    for f in (
        op1_block_top_k,
        op2_additive_quality,
        op3_hidden_markov_scores,
        op4_minhash_near_dedup,
        op5_ordinal_toxicity,
        op6_benchmark_leaks,
        op7_seed_extend_dedup,
        op8_source_mixture,
        op9_chat_perspectives,
        op10_run_index_dedup,
        op11_table_centroids,
        op12_tokenizer_alignment,
        op13_warc_archives,
    )
}
