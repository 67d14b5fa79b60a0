"""Readers for the input tables."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urltriage import schemas
from urltriage.operators.facts import read_payload
from urltriage.operators.page_features import with_fetch_status


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when the input has fewer splits than the cluster has cores.

    Text work dominates these jobs, so a single small file would otherwise keep
    one core busy.  Inputs with enough splits are returned as they are: large
    tables are never shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _read(spark: SparkSession, path: str, schema, fmt: str, **options) -> DataFrame:
    reader = spark.read.schema(schema).options(**options)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.format(fmt).load(path)


def read_serp(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Search hits: keyword, rank, original_url, title, snippet."""
    return _read(spark, path, schemas.SERP_ITEMS, fmt, **options)


def read_serp_pages(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return _read(spark, path, schemas.SERP_PAGES, fmt, **options)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Page snapshots with ``ok``: status 200 and nonblank text, else an error."""
    return with_fetch_status(spread(_read(spark, path, schemas.PAGE_SNAPSHOTS, fmt, **options)))


def read_domain_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts kept as (domain, data JSON, last_updated); bad JSON is dropped."""
    return read_payload(spark.read.parquet(path))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RESULTS).parquet(path)


def read_images(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """Image files as (src, content).

    ``manifest`` (src, path) gives each image's absolute URL and its file below
    ``path``; pages refer to images by that URL. Without one, src is the file's
    location.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if manifest is None:
        return files.select(F.col("path").alias("src"), "content")
    folder = urlsplit(path).path.rstrip("/") + "/"
    below = F.substring_index("path", folder, -1)
    named = manifest.select("src", F.ltrim(F.col("path"), F.lit("/")).alias("_below"))
    return files.withColumn("_below", below).join(named, "_below").select("src", "content")
