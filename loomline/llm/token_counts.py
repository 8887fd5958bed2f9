"""Exact length histogram of encoded documents, and everything that suffix sums over it answer.

The histogram has one row per distinct encoded length, whatever the number of documents. Suffix sums run in two
levels: within blocks of lengths, and over the few blocks. For a context limit L the truncated total is the tokens of
the shorter documents plus L for each of the others.

Null texts count as empty (length 0), repeated rows count each, an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Lengths in one block of the two-level sums.
BLOCK = 128


def histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """length, n_docs. Partial sums before the shuffle: at most one row per length and task is sent. The result is written, so that its several readers do not encode
    the documents again."""
    return written(lengths.groupBy(F.col(column).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n_docs")), "histogram")


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per length: n_docs, docs_at_least, tokens_at_least, docs_share (share of documents no longer), truncated_tokens (all documents cut at this length), total_docs, total_tokens."""
    rows = hist.withColumn("_block", F.expr(f"length div {block}")).withColumn("_tokens", F.col("length") * F.col("n_docs"))
    blocks = rows.groupBy("_block").agg(F.sum("n_docs").alias("_block_docs"), F.sum("_tokens").alias("_block_tokens"))
    later = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "_block",
        F.coalesce(F.sum("_block_docs").over(later), F.lit(0)).alias("_later_docs"),
        F.coalesce(F.sum("_block_tokens").over(later), F.lit(0)).alias("_later_tokens"),
        F.sum("_block_docs").over(everything).alias("total_docs"),
        F.sum("_block_tokens").over(everything).alias("total_tokens"),
    )
    down = Window.partitionBy("_block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    docs = F.col("_later_docs") + F.sum("n_docs").over(down)
    tokens = F.col("_later_tokens") + F.sum("_tokens").over(down)
    return (
        rows.join(blocks, "_block")
        .withColumn("docs_at_least", docs)
        .withColumn("tokens_at_least", tokens)
        .select(
            "length",
            "n_docs",
            "docs_at_least",
            "tokens_at_least",
            (1 - (F.col("docs_at_least") - F.col("n_docs")) / F.col("total_docs")).alias("docs_share"),
            (F.col("total_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
            "total_docs",
            "total_tokens",
        )
    )


def truncated(sums: DataFrame, limit: int) -> DataFrame:
    """Totals for any context limit, from the suffix sums of the first length above it: one row with docs, tokens, tokens left after cutting at the limit, and documents cut."""
    above = F.min(F.when(F.col("length") > limit, F.struct("length", "docs_at_least", "tokens_at_least")))
    none = F.lit(0).cast("long")
    row = sums.agg(above.alias("above"), F.max("total_docs").alias("docs"), F.max("total_tokens").alias("tokens"))
    row = row.select(F.coalesce("docs", none).alias("n_docs"), F.coalesce("tokens", none).alias("n_tokens"), F.coalesce("above.docs_at_least", none).alias("cut_docs"), F.coalesce("above.tokens_at_least", none).alias("cut_tokens"))
    return row.select("n_docs", "n_tokens", (F.col("n_tokens") - F.col("cut_tokens") + limit * F.col("cut_docs")).alias("kept_tokens"), "cut_docs")


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """Smallest length that at least a share q of the documents does not exceed, from the suffix sums: the documents above it are docs_at_least - n_docs; exact."""
    return sums.where(F.col("docs_at_least") - F.col("n_docs") <= (1 - F.lit(q)) * F.col("total_docs")).agg(F.min("length").alias("length"))
