"""Exact token counts from a histogram of encoded lengths: totals, quantiles and truncated totals for every context limit are
suffix sums over it, so the documents are read once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querylark.llm.bpe import vocabulary
from querylark.llm.common import narrow, per_chunk, small_arrow_batches, texts


def length_histogram(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """n_tokens, n_docs: documents by their length in tokens of the vocabulary at path, counted in each task before the shuffle.

    A null text is empty and has length 0. Repeated documents count each time; an empty table gives an empty histogram."""
    small_arrow_batches(docs.sparkSession)
    schema = pa.schema([("n_tokens", pa.int64()), ("n_docs", pa.int64())])

    def run(part: pa.RecordBatch) -> dict:
        value, n = np.unique([len(x) for x in vocabulary(path).encode_with_added(texts(part))], return_counts=True)
        return {"n_tokens": value, "n_docs": n}

    counted = docs.select(docs[text_col].alias("text")).mapInArrow(per_chunk(run, schema), "n_tokens long, n_docs long")
    return counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def limits(histogram: DataFrame) -> DataFrame:
    """One row for each length that occurs, taken as a context limit L: context_limit, n_docs (of that length), docs_within (of at
    most L tokens), docs_cut, total_tokens, tokens_within (of documents within L), tokens_kept (each document cut to L),
    tokens_cut, quantile (share of documents within L).

    The windows see one row for each distinct length, not the documents. An empty histogram gives no rows; a length that comes in
    several rows counts as one only after length_histogram() has added them up."""
    down = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    longer = F.coalesce(F.sum("n_docs").over(down), F.lit(0))
    tokens_longer = F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(down), F.lit(0))
    h = histogram.select("n_tokens", "n_docs", longer.alias("docs_cut"), tokens_longer.alias("longer_tokens"), F.sum(F.col("n_docs") * F.col("n_tokens")).over(every).alias("total_tokens"), F.sum("n_docs").over(every).alias("docs"))
    kept = F.col("total_tokens") - F.col("longer_tokens") + F.col("docs_cut") * F.col("n_tokens")
    return h.select(
        F.col("n_tokens").alias("context_limit"), "n_docs", (F.col("docs") - F.col("docs_cut")).alias("docs_within"), "docs_cut", "total_tokens",
        (F.col("total_tokens") - F.col("longer_tokens")).alias("tokens_within"), kept.alias("tokens_kept"), (F.col("total_tokens") - kept).alias("tokens_cut"),
        ((F.col("docs") - F.col("docs_cut")) / F.col("docs")).alias("quantile"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: tokens_kept when every document is cut to limit tokens; 0 for an empty histogram."""
    return histogram.agg(F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("tokens_kept"))


def length_quantile(histogram: DataFrame, q: float) -> DataFrame:
    """One row: the least length that at least a share q of the documents don't exceed; null for an empty histogram."""
    return limits(histogram).filter(F.col("quantile") >= q).agg(F.min("context_limit").alias("length"))
