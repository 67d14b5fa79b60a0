"""Incremental domain triage over a folder of arriving search-hit files."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from urltriage import config, schemas
from urltriage.functions.urls import with_normalized_url
from urltriage.operators.domain_risk import verdict_facts
from urltriage.operators.results import result_rows, storable
from urltriage.plans.domain_triage import score_sites
from urltriage.sources.writers import export_suspicious_csv
from urltriage.streaming import memory

#: Files a batch takes at most.
FILES_PER_BATCH = 64


def results_so_far(spark: SparkSession, out_dir: str) -> DataFrame:
    """Results of all finished batches (with their stream, batch number and key bucket)."""
    schema = schemas.table("stream string, batch_id int, key_bucket int")
    for field in schemas.RESULTS.fields:
        schema = schema.add(field)
    return spark.read.schema(schema).parquet(out_dir)


def stream_id(spark: SparkSession, checkpoint_dir: str) -> str:
    """Name of the stream that has this checkpoint; kept beside it, so a restart finds it."""
    path = f"{checkpoint_dir.rstrip('/')}-stream-id"
    try:
        return spark.read.text(path).first()["value"]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    name = uuid.uuid4().hex
    spark.createDataFrame([(name,)], "value string").coalesce(1).write.text(path)
    return name


def run_batches(
    hits: DataFrame,
    facts: DataFrame,
    out_dir: str,
    checkpoint_dir: str,
    as_of,
    report_dir: str | None = None,
    facts_dir: str | None = None,
    min_score: int = config.SUSPICIOUS_THRESHOLD,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Triage each micro-batch of a streaming hits table against earlier results.

    Every batch of a stream writes its own folder in overwrite mode, so a batch
    repeated after a failure does not store its rows twice; it is compared with the
    results of all other batches, those of other streams and of streams with another
    checkpoint included.  The results table itself is the memory of what was
    seen; no streaming state grows in the executors.  Results are written by key
    bucket with a Bloom filter per bucket (:mod:`urltriage.streaming.memory`): a
    batch reads only the key column of the earlier folders its keys may be in.
    Report parts and, with ``facts_dir``, updated facts are written by batch as well.
    """
    spark = hits.sparkSession
    name = stream_id(spark, checkpoint_dir)
    # An empty table to start from.
    spark.createDataFrame([], schemas.RESULTS).write.mode("append").parquet(out_dir)
    memory.empty_memory(spark, out_dir)

    def triage(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        own = f"stream={name}/batch_id={batch_id}"
        this_one = F.col("stream").eqNullSafe(F.lit(name)) & F.col("batch_id").eqNullSafe(F.lit(batch_id))
        keys = with_normalized_url(batch, "original_url", options.get("keep_query", False)).where(
            F.coalesce("original_url", F.lit("")) != ""
        )
        # Folders of earlier batches whose filters may hold a key of this one: at most
        # batches times buckets names, like the file listing Spark makes anyway.
        seen = memory.maybe_seen(keys, memory.filters(session, out_dir).filter(~this_one))
        tags = [r[0] for r in seen.select(memory.folder_tag(*seen.columns)).collect()]
        earlier = memory.pruned(results_so_far(session, out_dir).filter(~this_one), tags)
        scored = score_sites(batch, facts, as_of, prior=earlier, **options)
        folder = f"{out_dir.rstrip('/')}/{own}"
        rows = storable(result_rows(scored), as_of)
        rows.withColumn("key_bucket", memory.key_bucket(F.col("normalized_url"))).write.partitionBy(
            "key_bucket"
        ).mode("overwrite").parquet(folder)
        written = session.read.schema(StructType([*schemas.RESULTS.fields, StructField("key_bucket", IntegerType())]))
        written = written.parquet(folder)
        memory.remember(written.select("normalized_url"), out_dir, own)
        if facts_dir is not None:
            verdict_facts(scored, as_of).write.mode("overwrite").parquet(f"{facts_dir.rstrip('/')}/{own}")
        if report_dir is not None:
            done = written.select(*schemas.RESULTS.names)
            export_suspicious_csv(done, f"{report_dir.rstrip('/')}/{own}", min_score)

    return (
        hits.writeStream.foreachBatch(triage)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def triage_stream(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint_dir: str,
    facts: DataFrame,
    as_of,
    files_per_batch: int = FILES_PER_BATCH,
    fmt: str = "parquet",
    **options,
) -> StreamingQuery:
    """Watch a folder; each batch takes the files that have arrived, up to a number."""
    hits = (
        spark.readStream.schema(schemas.SERP_ITEMS)
        .option("maxFilesPerTrigger", files_per_batch)
        .format(fmt)
        .load(in_dir)
    )
    return run_batches(hits, facts, out_dir, checkpoint_dir, as_of, **options)
