"""Registered queries of the training-data operators, over whole tables, and their oracles in SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, classifier, clusters, ctw, fim, langid, mainblocks, neardup, packing, quality, sharding, treepack, vectors
from tidemark.llm.common import fold, table
from tidemark.session import scratch_path


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainblocks.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, keep=["doc_id"]), path)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classifier.score(docs, classifier.fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", (fold(F.col("doc_id"), classifier.FOLDS) == 0).alias("held_out"), "score", "predicted")


def op7_context_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 7) == 2
    found = ctw.score(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = sharding.reshard(docs.select("doc_id", "text"), sharding.old_shards_of_files(docs), scratch_path(spark, "llm-shards"))
    crc = F.crc32(F.coalesce(F.col("row.text"), F.lit("")).cast("binary"))
    return found.select("row.doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 5) == 0
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs, ~held_out), keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "component_id", "kept")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents"), keep=["doc_id"])
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treepack.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.summary(*clusters.cluster(table(spark, sf_dir, "embeddings")))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_main_text": op3_main_text,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op6_quality_classifier": op6_quality_classifier,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op7_context_tree_score": op7_context_tree_score,
    "op8_flow_resharding": op8_flow_resharding,
    "op9_language_id": op9_language_id,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_first_fit_packing": op12_first_fit_packing,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": quality.ORACLE,
    "op2_embedding_near_dedup": vectors.ORACLE,
    "op11_fill_in_middle": fim.ORACLE,
    "op13_centroid_clustering": clusters.oracle(),
}
