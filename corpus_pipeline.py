"""Documents of a training corpus in five stages. Each stage's rows are written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontaminate, language_id, minhash_dedup, substring_dedup
from ledgerloom.llm.common import free_name, with_place, written
from ledgerloom.llm.queries import tokenizer_path


#: Least mean share of the likeliest language. A text that reads as all of four languages alike has 0.25.
LEAST_SCORE = 0.35


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network recognises: the score of its label is LEAST_SCORE or more, so those without
    any letter go, null and empty texts among them. All documents if there was no language to learn."""
    network = language_id.train(docs)
    if network is None:
        return docs
    label, score = (free_name(docs.columns, x) for x in ("lang_pred", "score"))
    return language_id.predict(docs, network, label, score).filter(F.col(score) >= LEAST_SCORE).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, linked from a similarity of 0.8 on: that with the smallest doc_id, and of
    rows that repeat it the first one of the files. Rows are judged, not ids, so a row stays whose id another row shares.
    Rows without words or doc_id stay."""
    placed, place = with_place(docs)
    others = minhash_dedup.near_duplicates(placed, similarity=80, key=place).filter("not first").select(*place)
    return placed.join(others, list(place), "left_anti").select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words that start in an earlier document; a document with no words left goes."""
    left = substring_dedup.without_passages(docs)
    cut = left.columns[-1]
    left = left.filter(f"not {cut} or text <> ''")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col(cut), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item. Null and empty texts hold none and stay, as do all rows with an empty benchmark; rows that repeat an id are judged by
    their own texts; columns of any name are kept."""
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of the text decoded from them. A row for each row; null texts count as empty, null ids stay null, other
    columns go."""
    return bpe.round_trip(docs, tokenizer_path(spark))


STAGES = [("language ID", known_language), ("MinHash near-dedup", one_of_each_group), ("substring dedup", without_repeats), ("benchmark decontamination", without_benchmark), ("BPE", tokens)]

#: SQL has neither the network of the first stage nor the encoder of the last one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return written(STAGES[-1][1](spark, docs, sf_dir), "stage")
