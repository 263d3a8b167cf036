"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylark.llm import bpe, language, near_duplicates, packing, pii, quality, token_counts, token_files, url_filter, winnowing
from querylark.llm.common import documents

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PLAIN = public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), MULTI)


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_with_next(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.find(documents(spark, sf_dir)))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7 % 366).cast("int")))
    judged = url_filter.judge(captures, url_filter.sample_entries(pages))
    return judged.withColumn("fetched", F.col("fetched").cast("string"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.deduplicate(documents(spark, sf_dir), k=4)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    predicted = language.predict(docs, language.train(docs, ~language.held_out()))
    return predicted.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), PLAIN)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.limits(token_counts.length_histogram(documents(spark, sf_dir), PLAIN))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(documents(spark, sf_dir), PLAIN)


def queries() -> dict:
    return {f.__name__: f for f in (op1_bpe, op2_winnowing, op3_quality, op4_pii, op5_url_filter, op6_near_duplicates, op7_language, op8_packing, op9_token_counts, op10_token_files)}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": url_filter.SQL}
