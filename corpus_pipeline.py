"""Documents to packed training sequences: language, quality, near-duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querylark.llm import language, near_duplicates, packing, pii, quality
from querylark.llm.common import chunks, materialize, semi, settled, small_arrow_batches, texts
from querylark.llm.entry import PLAIN


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; lang becomes the recognised language. A null or empty text, or one without a letter, has
    none and goes; rows of null or repeated doc_id are judged each; an empty table stays empty, as does one without labels, from which nothing
    is learned."""
    small_arrow_batches(spark)
    model = language.train(docs)
    at = docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, most=language.CHUNK):
                lang, _, rejected = language.columns(texts(part), model)
                columns = part.columns
                columns[at] = pa.array(lang, pa.string())
                yield pa.RecordBatch.from_arrays(columns, part.schema.names).filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)


def numbered(docs: DataFrame) -> DataFrame:
    """With a number of each row, written with the rows: doc_id may be null or repeated."""
    return materialize(docs.withColumn("_row", F.monotonically_increasing_id()))


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band. A null or empty text fails; a null lang is a
    language of its own; rows of null or repeated doc_id are judged each; an empty table stays empty."""
    rows = numbered(docs)
    judged = settled(lambda: quality.judge(rows, id_col="_row").filter("not kept").select(F.col("doc_id").alias("_row")))
    return semi(rows, judged, "_row", "left_anti").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id (null comes last) of each group of near-duplicates: five words, similarity 0.8. Texts that are null
    or without words are like none and stay; of equal rows one stays; an empty table stays empty."""
    rows = numbered(docs)

    def others() -> DataFrame:
        found = near_duplicates.deduplicate(rows, k=5, percent=80, id_col="_row").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("component"))
        place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
        groups = materialize(found.join(rows.select("_row", "doc_id"), "_row"))
        first = groups.groupBy("component").agg(F.min(place)["_row"].alias("first"), F.count("*").alias("size")).filter("size > 1")
        return groups.join(first, "component").filter("_row <> first").select("_row")

    dropped = settled(others)
    return semi(rows, dropped, "_row", "left_anti").select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and secrets replaced by their kinds; n_chars follows. A null text stays null; rows of null or
    repeated doc_id are redacted each; an empty table stays empty."""
    marked = pii.with_spans(docs, "text", "_spans").withColumn("text", F.when(F.col("text").isNotNull(), pii.redacted(F.col("text"), F.col("_spans"))))
    return marked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its sequence of at most 1024 tokens and its place there. A null text is its end token
    alone; rows of null or repeated doc_id are packed each; an empty table gives no rows."""
    return packing.pack(docs, PLAIN)


STAGES = [("language", identify_language), ("quality", filter_quality), ("near_duplicates", drop_near_duplicates), ("pii", redact), ("packing", pack)]
#: Subword models, perplexities and tokens have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
