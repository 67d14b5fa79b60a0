"""Pipeline from raw documents to packed training sequences."""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urltriage.llm.common import stored, table
from urltriage.llm.exact_dedup import drop_exact_copies
from urltriage.llm.packing import pack
from urltriage.llm.pii import redact
from urltriage.llm.quality import drop_low_quality
from urltriage.llm.simhash import drop_near_copies
from urltriage.session import prepare


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of identical texts."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return drop_near_copies(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced; ``n_chars`` follows the text."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows."""
    return pack(docs, tokenizers.path("word_bpe_49k.json"))


def _prepared(stage):
    return lambda spark, docs, sf_dir: stage(prepare(spark), docs, sf_dir)


STAGES = [
    ("quality", _prepared(quality)),
    ("exact_dedup", _prepared(exact)),
    ("near_dedup", _prepared(near)),
    ("pii", _prepared(private)),
    ("packing", _prepared(packed)),
]

#: The classifier, the fingerprints and the packing can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each written and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
