"""Token counts from an exact length histogram.

Documents are encoded once and aggregated by encoded length, map side first. The histogram has a row for
each distinct length, so its size follows the longest document and not the corpus; suffix sums over it answer
for every context limit: documents and tokens at or over it, the total when each document is truncated to
it, and (as a rank) quantiles. Between two lengths all of these are linear in the limit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlework.llm.common import read
from candlework.llm.tokens import encoded, public_path

TOKENIZER = "byte_bpe_50k.json"


def lengths(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = None) -> DataFrame:
    """doc_id and n_tokens of every whole text; null is empty and has 0 tokens (1 with an end id)."""
    path = tokenizer or public_path(TOKENIZER)

    def count(batches):
        for batch, ids in encoded(batches, path, end_id):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    return counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """One row per length that occurs, as a context limit.

    n_docs documents have just this length; docs_over and tokens_over count this length and longer ones;
    truncated_tokens is the total when every document is cut to this length; rank is the share of documents
    of at most this length (so the q-quantile is the least context_limit whose rank is q or more).
    An empty table gives no row.
    """
    up = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        hist.withColumn("docs_over", F.sum("n_docs").over(up))
        .withColumn("tokens_over", F.sum(F.col("n_docs") * F.col("n_tokens")).over(up))
        .withColumn("all_docs", F.max("docs_over").over(Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("all_tokens", F.max("tokens_over").over(Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select(
            F.col("n_tokens").alias("context_limit"),
            "n_docs",
            "docs_over",
            "tokens_over",
            (F.col("all_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")).alias("truncated_tokens"),
            ((F.col("all_docs") - F.col("docs_over") + F.col("n_docs")) / F.col("all_docs")).alias("rank"),
        )
    )


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """Totals for any limit, also one that no document has: one row, of docs over it and tokens after truncation."""
    over = F.col("context_limit") > limit
    return sums.agg(
        F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("docs_over"),
        F.coalesce(F.sum(F.col("n_docs") * F.least("context_limit", F.lit(limit))), F.lit(0)).alias("truncated_tokens"),
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    return sums.where(F.col("rank") >= q - np.finfo(float).eps).agg(F.min("context_limit").alias("n_tokens"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(histogram(lengths(read(spark, sf_dir, "documents"))))
