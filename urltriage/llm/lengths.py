"""Token counts from an exact histogram of encoded lengths.

Documents are counted by their number of tokens. Sums over the longer lengths then
answer, for each limit of the context, how many documents and tokens fit, how many
tokens remain after cutting, and where the quantiles lie; no document is read again.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urltriage.llm.common import col, stored
from urltriage.llm.tokens import ByteBpe, encoder

#: Lengths whose sums are formed together before the sums of such blocks.
BLOCK = 1024


def token_lengths(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``n_tokens`` of every row and whole text; null is empty."""
    source = docs.select(F.coalesce(col(text_col), F.lit("")).alias("text"))

    def run(batches):
        words = encoder(ByteBpe, tokenizer)
        for batch in batches:
            counts = [len(words.encode(t)) // 4 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["n_tokens"])

    return source.mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row for each length that occurs, with sums over it, the shorter and the longer ones.

    ``lengths`` has ``n_tokens``. Columns: ``n_tokens``; ``n_docs`` of that length;
    ``docs_within``, ``tokens_within`` (not longer); ``docs_beyond``,
    ``tokens_beyond`` (longer); ``truncated_tokens`` (left if every document is cut
    to this length); ``quantile`` (share of documents not longer). The sums are formed
    within blocks of lengths and then over the blocks, so that no task holds all
    lengths of a long tail.
    """
    counted = stored(
        lengths.groupBy("n_tokens")
        .agg(F.count(F.lit(1)).alias("n_docs"))
        .withColumn("block", F.floor(F.col("n_tokens") / BLOCK)),
        "length-histogram",
    )
    blocks = counted.groupBy("block").agg(
        F.sum("n_docs").alias("block_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("block_tokens")
    )
    # A row for each BLOCK lengths; ordered blocks are few even for very long texts.
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = stored(
        blocks.select(
            "block",
            F.coalesce(F.sum("block_docs").over(later), F.lit(0)).alias("later_docs"),
            F.coalesce(F.sum("block_tokens").over(later), F.lit(0)).alias("later_tokens"),
        ),
        "length-blocks",
    )
    whole = counted.agg(F.sum("n_docs"), F.sum(F.col("n_docs") * F.col("n_tokens"))).first()
    docs, tokens = whole[0] or 0, whole[1] or 0
    longer = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    own_docs = F.coalesce(F.sum("n_docs").over(longer), F.lit(0))
    own_tokens = F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(longer), F.lit(0))
    return (
        counted.withColumn("own_docs", own_docs)
        .withColumn("own_tokens", own_tokens)
        .join(blocks, "block")
        .select(
            "n_tokens",
            "n_docs",
            (F.col("own_docs") + F.col("later_docs")).alias("docs_beyond"),
            (F.col("own_tokens") + F.col("later_tokens")).alias("tokens_beyond"),
        )
        .withColumn("docs_within", F.lit(docs) - F.col("docs_beyond"))
        .withColumn("tokens_within", F.lit(tokens) - F.col("tokens_beyond"))
        .withColumn(
            "truncated_tokens", F.col("tokens_within") + F.col("n_tokens") * F.col("docs_beyond")
        )
        .withColumn("quantile", F.col("docs_within") / F.lit(docs))
    )


def token_counts(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """``length_histogram`` of all rows of ``docs``.

    Null and empty texts have length 0; repeated rows all count; an empty table gives
    no row. Other columns are ignored.
    """
    return length_histogram(token_lengths(docs, tokenizer, text_col))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Totals for given context limits, lengths that don't occur included.

    Columns: ``context``, ``docs_within``, ``tokens_within``, ``docs_beyond``,
    ``truncated_tokens``.
    """
    spark = histogram.sparkSession
    if not limits:
        raise ValueError("no limit is given")
    asked = spark.createDataFrame([(n,) for n in sorted(set(limits))], "context long")
    marked = histogram.withColumn("context", F.explode(F.array(*(F.lit(n) for n in sorted(set(limits))))))
    within, size = F.col("n_tokens") <= F.col("context"), F.col("n_docs") * F.col("n_tokens")
    sums = marked.groupBy("context").agg(
        F.sum(F.when(within, F.col("n_docs")).otherwise(0)).alias("docs_within"),
        F.sum(F.when(within, size).otherwise(0)).alias("tokens_within"),
        F.sum(F.when(within, 0).otherwise(F.col("n_docs"))).alias("docs_beyond"),
    )
    filled = asked.join(sums, "context", "left").na.fill(0)
    return filled.withColumn(
        "truncated_tokens", F.col("tokens_within") + F.col("context") * F.col("docs_beyond")
    )
