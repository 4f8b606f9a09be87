"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import conversations, importance, oracles, packing, quality, secrets, simhash, substrings, suffix_tree, templates, tiling, token_counts, warc, weak_rules
from ravelin.llm._scratch import Scratch

TOKEN_LIMIT = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(quality.fold(F.col("doc_id")) != 1))
    held = F.coalesce(quality.fold(F.col("doc_id")) == 1, F.lit(False))
    scored = quality.score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_and_read(table(spark, sf_dir, "pages"), Scratch(spark, "warc"))
    key = F.col("metadata.notes")["captureId"].cast("long")
    return found.select(key.alias("page_id"), "payload_bytes", F.col("main.digest").alias("payload_digest"), "main.record_type", "refers_to", F.col("main.target_uri").alias("url"))


def op3_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = weak_rules.judge(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("p_quality"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = templates.main_text(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumnRenamed("id", "doc_id")


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(suffix_tree.fold(F.col("doc_id")) == 2, F.lit(False))
    found = suffix_tree.score_texts(table(spark, sf_dir, "documents"), ~held)
    return found.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    counts = [secrets.count_of("spans", kind).alias(f"n_{kind}") for kind in secrets.BASE]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(secrets.span_list("spans", secrets.BASE), 256).alias("base_sha256"), secrets.span_list("spans").alias("spans"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tiling.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "coverage", "tiles", "words")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "resampling"))
    return found.withColumnRenamed("id", "doc_id")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_reports(conversations.damage(table(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumnRenamed("id", "doc_id").withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


QUERIES = {"op1_quality": op1_quality, "op2_warc": op2_warc, "op3_weak_rules": op3_weak_rules, "op4_substrings": op4_substrings, "op5_templates": op5_templates, "op6_packing": op6_packing, "op7_suffix_tree": op7_suffix_tree, "op8_secrets": op8_secrets, "op9_simhash": op9_simhash, "op10_tiling": op10_tiling, "op11_resampling": op11_resampling, "op12_conversations": op12_conversations, "op13_token_counts": op13_token_counts}
ORACLE_SQL = {"op2_warc": oracles.WARC, "op3_weak_rules": oracles.WEAK_RULES, "op4_substrings": oracles.SUBSTRINGS, "op8_secrets": oracles.SECRETS, "op11_resampling": oracles.RESAMPLING, "op12_conversations": oracles.CONVERSATIONS}
