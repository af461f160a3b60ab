"""One query for each operator of this folder, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, decontaminate, language_id, media_png, minhash_dedup, ngram_lm, periodic_runs, prefix_trie, quality_crf, substring_dedup, token_counts, token_files


def tokenizer_path(spark: SparkSession) -> str:
    """The vocabulary file: spark.ledgerloom.tokenizer, or that of the installed public tokenizers."""
    path = spark.conf.get("spark.ledgerloom.tokenizer", None)
    if path:
        return path
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.lm_scores(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.preference_pairs(chat_format.against_echoes(table(spark, sf_dir, "conversations")))


def op5_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_crf.score(docs, quality_crf.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality_crf.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs.select("doc_id", "text"), language_id.train(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(spark))


def op8_media_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_png.media_features(media_png.store_media(table(spark, sf_dir, "documents")))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(spark)))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(spark))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(periodic_runs.with_repeats(table(spark, sf_dir, "documents")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.with_shared_heads(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_dedup, op2_substring_dedup, op3_lm_scoring, op4_chat_format, op5_quality_crf, op6_language_id, op7_bpe, op8_media_png, op9_token_files, op10_decontaminate, op11_token_counts, op12_periodic_runs, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": minhash_dedup.ORACLE, "op2_substring_dedup": substring_dedup.ORACLE, "op4_chat_format": chat_format.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
