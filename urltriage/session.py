"""Session settings the jobs are designed for, and the shared scratch folder."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Splits the partition of a hot host, domain or image in every join below.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # The JVM never compiles a method above this size; such a stage runs faster
    # as separate operators whose code is split into small methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where it lies; a scratch folder if none is set.

    Only on one machine the folder is a local one. On a cluster the package is
    installed or sent with the job, and ``spark.checkpoint.dir`` is set.
    """
    context = spark.sparkContext
    home = str(Path(__file__).resolve().parent.parent)
    known = context.environment.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (known, home)))
    if _shared_root(spark) is None and context.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="urltriage-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(f"file://{folder}")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """The recommended settings, for the jobs on search hits and pages."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return prepare(spark)


def local_session(
    cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g", **settings: str
) -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("urltriage")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.host", "localhost")
    )
    for key, value in {**RECOMMENDED, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _shared_root(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


@functools.cache
def _application_folder(spark: SparkSession, root: str, application: str) -> str:
    """A folder below ``root`` that is removed when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/urltriage-{application}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that all executors can reach, gone after the application.

    It lies below ``spark.checkpoint.dir``, or the checkpoint folder set in the session.
    """
    root = _shared_root(spark)
    if root is None:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = _application_folder(spark, root, spark.sparkContext.applicationId)
    return f"{folder}/{purpose}-{uuid.uuid4().hex}"
