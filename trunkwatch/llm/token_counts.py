"""Token counts: an exact histogram of encoded lengths and its suffix sums.

Documents are aggregated by encoded length. From the histogram, sums over all
longer lengths answer totals, quantiles and truncated totals for every context
limit without another look at the texts: cutting documents at L tokens keeps
``tokens of documents up to L  +  L * documents longer than L``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trunkwatch.llm.common import stored, table, text_of
from trunkwatch.llm.tokens import encoder, vocabulary_path

#: Lengths that are summed together first, so that no task sees all lengths.
_BLOCK = 1024


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``n_tokens, n_docs``: how many documents have each encoded length.

    A null or empty text has length 0; repeated rows count each; an empty table
    gives no row. Other columns are not read. The histogram is written once, as
    every question reads it again.
    """
    path = vocabulary or vocabulary_path()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, "library")
        for batch in batches:
            for _, offsets, _ in own.encode(batch.column(0)):
                n, count = np.unique(np.diff(offsets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(count, pa.int64())],
                                                 names=["n_tokens", "n_docs"])

    counted = docs.select(text_of(text).alias("t")).mapInArrow(lengths, "n_tokens long, n_docs long")
    return stored(counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "length-histogram")


def length_report(histogram: DataFrame) -> DataFrame:
    """One row per length L that occurs, read as a context limit.

    ``n_docs`` documents have it, ``docs_longer`` exceed it, ``tokens_longer`` is
    what those hold, ``total_tokens`` what all hold, ``truncated_tokens`` what is
    left of all when cut at L, ``share_upto`` the share of documents up to L.
    Every quantile of the lengths is the least L whose share reaches it.
    """
    own = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("_tokens"),
                           F.floor(F.col("n_tokens") / _BLOCK).alias("_block"))
    blocks = own.groupBy("_block").agg(F.sum("n_docs").alias("_docs_in"), F.sum("_tokens").alias("_tokens_in"))
    # one row per block of lengths: few, however many documents there are
    later = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "_block", F.coalesce(F.sum("_docs_in").over(later), F.lit(0)).alias("_docs_after"),
        F.coalesce(F.sum("_tokens_in").over(later), F.lit(0)).alias("_tokens_after"),
        F.sum("_docs_in").over(Window.partitionBy()).alias("_docs"),
        F.sum("_tokens_in").over(Window.partitionBy()).alias("total_tokens"))
    above = Window.partitionBy("_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    sums = own.select(
        "n_tokens", "n_docs", "_block",
        F.coalesce(F.sum("n_docs").over(above), F.lit(0)).alias("_docs_above"),
        F.coalesce(F.sum("_tokens").over(above), F.lit(0)).alias("_tokens_above"))
    longer = F.col("_docs_above") + F.col("_docs_after")
    kept = F.col("_tokens_above") + F.col("_tokens_after")
    return sums.join(blocks, "_block").select(
        "n_tokens", "n_docs", longer.alias("docs_longer"), kept.alias("tokens_longer"), "total_tokens",
        (F.col("total_tokens") - kept + F.col("n_tokens") * longer).alias("truncated_tokens"),
        ((F.col("_docs") - longer) / F.col("_docs")).alias("share_upto"))


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """``context_limit, n_docs, n_cut, total_tokens, kept_tokens`` for any limit, also between lengths."""
    n, longer = F.col("n_tokens"), F.col("n_tokens") > limit
    return histogram.agg(
        F.lit(limit).cast("long").alias("context_limit"),
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"),
        F.coalesce(F.sum(F.when(longer, F.col("n_docs"))), F.lit(0)).alias("n_cut"),
        F.coalesce(F.sum(n * F.col("n_docs")), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum(F.least(n, F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("kept_tokens"))


def quantiles(report: DataFrame, shares: list[float]) -> DataFrame:
    """``share, n_tokens``: the least length that ``share`` of the documents do not exceed."""
    each = [F.struct(F.lit(float(s)).alias("share"),
                     F.min(F.when(F.col("share_upto") >= s, F.col("n_tokens"))).alias("n_tokens")) for s in shares]
    return report.agg(F.array(*each).alias("q")).select(F.inline("q"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_report(length_histogram(table(spark, sf_dir, "documents")))
