"""Sinks: results, CSV and JSON reports, analysis history."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urltriage import config, schemas
from urltriage.functions.text import list_to_json
from urltriage.operators.keyed import latest_per_key
from urltriage.operators.results import suspicious

#: One page may be analyzed for several brands at one instant.
HISTORY_KEY = ["url", "brand", "analyzed_at"]


def lists_as_json(df: DataFrame) -> DataFrame:
    """Array columns as JSON text, for formats without nested values."""
    lists = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    return df.withColumns({c: list_to_json(F.col(c)) for c in lists}) if lists else df


def write_results(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Results table.  To update one, write the upsert to a new path and swap."""
    results.write.mode(mode).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """All rows with a header; one part file per partition."""
    lists_as_json(df).write.mode("overwrite").options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def export_suspicious_csv(
    results: DataFrame, path: str, min_score: int = config.SUSPICIOUS_THRESHOLD
) -> bool:
    """Flagged rows, highest first; writes nothing when there are none."""
    flagged = suspicious(results, min_score)
    if flagged.isEmpty():
        return False
    export_csv(flagged, path)
    return True


def export_json(df: DataFrame, path: str) -> None:
    """JSON Lines, one analysis per line."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def analysis_rows(analyzed: DataFrame, analysis_time_s: float | None = None) -> DataFrame:
    """Analyses in the layout of the history table."""
    return analyzed.select(
        "url",
        "brand",
        "base_domain",
        "score",
        "category",
        "reasons",
        "analyzed_at",
        F.lit(analysis_time_s).cast("double").alias("analysis_time_s"),
        F.to_json("content_analysis").alias("content_analysis"),
    )


def upgrade_history(old: DataFrame) -> DataFrame:
    """Older rows lack brand or content_analysis; these become null."""
    empty = old.sparkSession.createDataFrame([], schemas.ANALYSIS_HISTORY)
    return empty.unionByName(old, allowMissingColumns=True).select(*schemas.ANALYSIS_HISTORY.names)


def merge_history(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union in which a new row replaces the old one of the same key."""
    both = (
        upgrade_history(old)
        .withColumn("_new", F.lit(0))
        .unionByName(upgrade_history(new).withColumn("_new", F.lit(1)))
    )
    return latest_per_key(both, HISTORY_KEY, ["_new"]).drop("_new")


def append_analysis(rows: DataFrame, path: str, run_id: str) -> None:
    """Append a run's rows, each (url, brand, analyzed_at) once.

    ``run_id`` names the run; the caller gives every run its own, and the same one
    when it repeats a run after a failure. A run has its own folder, so a repeated
    one replaces its rows, and runs at the same instant don't touch each other.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run_id):
        raise ValueError("a run id has letters, digits, dots, dashes and underscores")
    once = latest_per_key(rows.select(*schemas.ANALYSIS_HISTORY.names), HISTORY_KEY, ["score"])
    once.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={run_id}")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All runs; if runs share a key, the one with the greatest id counts."""
    stored = _in_layout(spark.read.option("mergeSchema", True).parquet(path))
    return latest_per_key(stored, HISTORY_KEY, ["run"]).select(*schemas.ANALYSIS_HISTORY.names)


def _in_layout(stored: DataFrame) -> DataFrame:
    """Rows of all runs in the present layout, with ``run`` as text."""
    names = schemas.ANALYSIS_HISTORY.names
    known = [F.col(c) if c in stored.columns else F.lit(None).cast(schemas.ANALYSIS_HISTORY[c].dataType).alias(c) for c in names]
    return stored.select(*known, F.col("run").cast("string").alias("run"))
