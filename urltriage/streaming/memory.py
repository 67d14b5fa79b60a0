"""Memory of a stream's results: key buckets and a Bloom filter per bucket and batch.

Every batch writes its results partitioned by ``key_bucket`` (a hash of the
normalized URL) and, beside them, a Bloom filter of its keys per bucket: rows of
64-bit words, built by a grouped ``bit_or``. The next batch hashes its own keys,
joins them with the filters' words of earlier batches in the same buckets and
keeps the (stream, batch, bucket) folders where all bits of some key are set.
Only those folders, and only their key column, are read to drop sites seen
before; a false positive costs a read, never a result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of the key; a batch reads at most these folders of each earlier batch.
BUCKETS = 64
#: Hash functions of a filter.
HASHES = 4
#: Bits per key in a filter (about 0.24 % false positives with 4 hashes).
BITS_PER_KEY = 16
MEMORY = "_memory"  # Spark's readers skip folders that begin with '_'.
BLOOM_SCHEMA = "key_bucket int, size long, word long, bits long"


def key_bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _positions(keys: DataFrame, key: str) -> DataFrame:
    """One row per key and hash: the word and the bit within it, for a filter of ``size`` bits."""
    return keys.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(HASHES - 1))).alias("h")
    ).select(
        "*", F.pmod(F.xxhash64(F.col("h"), F.col(key)), F.col("size")).alias("pos")
    ).select(
        "*", F.floor(F.col("pos") / 64).alias("word"), F.expr("shiftleft(1L, cast(pos % 64 as int))").alias("bit")
    )


def bloom_filters(keys: DataFrame, key: str = "normalized_url") -> DataFrame:
    """Bloom filter words of the distinct keys, per bucket: key_bucket, size (bits), word, bits."""
    distinct = keys.select(key).where(F.col(key).isNotNull()).distinct().withColumn("key_bucket", key_bucket(F.col(key)))
    sizes = distinct.groupBy("key_bucket").agg(
        (F.ceil(F.count(F.lit(1)) * BITS_PER_KEY / 64) * 64).cast("long").alias("size")
    )
    placed = _positions(distinct.join(sizes, "key_bucket"), key)
    return placed.groupBy("key_bucket", "size", "word").agg(F.bit_or("bit").alias("bits"))


def empty_memory(spark: SparkSession, out_dir: str) -> None:
    spark.createDataFrame([], BLOOM_SCHEMA).write.mode("append").parquet(f"{out_dir.rstrip('/')}/{MEMORY}")


def remember(results: DataFrame, out_dir: str, own: str) -> None:
    """Writes the filters of a batch's keys; overwriting makes a repeated batch harmless."""
    bloom_filters(results).write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/{MEMORY}/{own}")


def filters(spark: SparkSession, out_dir: str) -> DataFrame:
    schema = f"{BLOOM_SCHEMA}, stream string, batch_id int"
    try:
        return spark.read.schema(schema).parquet(f"{out_dir.rstrip('/')}/{MEMORY}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def maybe_seen(keys: DataFrame, earlier: DataFrame, key: str = "normalized_url") -> DataFrame:
    """(stream, batch_id, key_bucket) of earlier filters that may hold one of the keys."""
    distinct = keys.select(key).where(F.col(key).isNotNull()).distinct().withColumn("key_bucket", key_bucket(F.col(key)))
    shapes = earlier.select("stream", "batch_id", "key_bucket", "size").distinct()
    placed = _positions(distinct.join(shapes, "key_bucket"), key)
    hits = placed.join(earlier, ["stream", "batch_id", "key_bucket", "size", "word"]).where(
        F.col("bits").bitwiseAND(F.col("bit")) != 0
    )
    per_key = hits.groupBy("stream", "batch_id", "key_bucket", key).agg(F.countDistinct("h").alias("set"))
    return per_key.where(F.col("set") == HASHES).select("stream", "batch_id", "key_bucket").distinct()


def folder_tag(stream: Column | str, batch_id: Column | str, bucket: Column | str) -> Column:
    """'stream/batch_id/key_bucket' of a result folder."""
    return F.concat_ws("/", *(F.col(c) if isinstance(c, str) else c for c in (stream, batch_id, bucket)))


def pruned(results: DataFrame, candidates: list[str]) -> DataFrame:
    """Key column of the result folders named by ``candidates``, a filter on partition columns only."""
    tag = folder_tag(F.col("stream"), F.col("batch_id"), F.col("key_bucket"))
    return results.where(tag.isin(candidates) if candidates else F.lit(False)).select("normalized_url")
