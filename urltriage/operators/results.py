"""Life cycle of results: skip, first-wins, project, upsert, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urltriage import config
from urltriage.functions.text import as_timestamp
from urltriage.operators.keyed import first_per_key, latest_per_key
from urltriage.schemas import RESULTS

RESULT_FIELDS = [
    "keyword", "url", "normalized_url", "domain", "title", "snippet", "suspicious", "reasons",
    "score", "whitelisted", "is_legit_subdomain", "registrar", "creation_date",
    "expiration_date", "country", "emails", "mx_records", "mx_count", "ip", "ttl",
    "ns_records", "ns_count",
]


def first_per_url(sites: DataFrame) -> DataFrame:
    """First hit of each normalized URL in (keyword, rank) order; blanks dropped."""
    usable = sites.filter(F.coalesce("original_url", F.lit("")) != "")
    return first_per_key(usable, "normalized_url", ["keyword_seq", "rank", "original_url"])


def skip_processed(sites: DataFrame, prior: DataFrame) -> DataFrame:
    """Drop sites whose key is already among earlier results.

    Run after :func:`first_per_url`: its output is already partitioned by the
    key, so only the narrow key column of ``prior`` moves.
    """
    return sites.join(prior.select("normalized_url"), "normalized_url", "left_anti")


def result_rows(scored: DataFrame) -> DataFrame:
    """The 22 result fields; the domain of a result is the registrable one."""
    typed = scored.withColumns(
        {
            "domain": F.coalesce("base_domain", F.lit("")),
            "score": F.coalesce("score", F.lit(0)).cast("int"),
            "whitelisted": F.coalesce("whitelisted", F.lit(False)),
            "is_legit_subdomain": F.coalesce("is_legit_subdomain", F.lit(False)),
            "mx_count": F.coalesce("mx_count", F.lit(0)).cast("int"),
            "ns_count": F.coalesce("ns_count", F.lit(0)).cast("int"),
        }
    )
    return typed.select(*RESULT_FIELDS, *(["filtered"] if "filtered" in scored.columns else []))


def storable(results: DataFrame, as_of) -> DataFrame:
    """Rows valid for the results table, in its schema."""
    columns = set(results.columns)
    usable = results.filter(
        (F.coalesce("keyword", F.lit("")) != "") & (F.coalesce("normalized_url", F.lit("")) != "")
    ).withColumns(
        {
            "score": F.greatest(F.coalesce("score", F.lit(0)), F.lit(0)),
            "last_checked": as_timestamp(as_of),
        }
    )
    return usable.select(
        *[
            (F.col(f.name) if f.name in columns | {"last_checked"} else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in RESULTS.fields
        ]
    )


def upsert_results(prior: DataFrame, new: DataFrame, as_of) -> DataFrame:
    """Union of both with the newer row winning per normalized URL."""
    both = (
        prior.select(*RESULTS.names)
        .withColumn("_new", F.lit(0))
        .unionByName(storable(new, as_of).withColumn("_new", F.lit(1)))
    )
    return latest_per_key(both, "normalized_url", ["_new", "last_checked"]).drop("_new")


def suspicious(results: DataFrame, min_score: int = config.SUSPICIOUS_THRESHOLD) -> DataFrame:
    """Flagged rows of at least ``min_score``, highest first."""
    return results.filter(F.col("suspicious") & (F.col("score") >= min_score)).orderBy(
        F.desc("score"), "normalized_url"
    )
