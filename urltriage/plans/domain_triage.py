"""Domain triage end to end: search hits and facts to result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urltriage import config
from urltriage.functions.text import text_array
from urltriage.functions.urls import url_host, with_normalized_url
from urltriage.operators.domain_risk import score_domain, verdict_facts
from urltriage.operators.facts import canonical_facts, fresh_facts, prefilter, update_facts
from urltriage.operators.results import first_per_url, result_rows, skip_processed
from urltriage.operators.suffix import with_registrable_domain


UNLISTED = 2**31 - 1


def with_keyword_order(serp: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """Add keyword_seq, the position of the keyword in the run.

    Without a keyword table, keywords run in alphabetical order.
    """
    if keywords is None:
        return serp.withColumn("keyword_seq", F.col("keyword"))
    return serp.join(keywords.select("keyword", F.col("seq").alias("keyword_seq")), "keyword", "left").withColumn(
        # Keywords that the table does not list come last.
        "keyword_seq",
        F.coalesce("keyword_seq", F.lit(UNLISTED)),
    )


def locate(sites: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Add url, domain (host) and the registrable-domain columns."""
    hosted = sites.withColumns(
        {"url": F.col("original_url"), "domain": url_host(F.coalesce("original_url", F.lit("")))}
    )
    return with_registrable_domain(hosted, "domain", suffixes)


def attach_facts(
    sites: DataFrame,
    facts: DataFrame,
    as_of,
    lookups: DataFrame | None = None,
    max_age_days: int = config.FACTS_MAX_AGE_DAYS,
    strict_suffix: bool = False,
) -> DataFrame:
    """Join facts and settle which sites need no scoring.

    A fresh cached fact takes precedence over the prefilter.
    """
    known = fresh_facts(sites, facts, as_of, max_age_days, lookups)
    marked = prefilter(known, strict_suffix)
    screened = ~F.col("cache_hit") & F.col("prefilter_reason").isNotNull()
    cached = {c: F.col(c) for c in ("filtered", "reasons", "whitelisted") if c in known.columns}
    settled = marked.withColumns(
        {
            "filtered": screened | F.coalesce(cached.get("filtered", F.lit(False)), F.lit(False)),
            "reasons": F.when(screened, F.array("prefilter_reason")).otherwise(
                cached.get("reasons", text_array([]))
            ),
            "whitelisted": screened | F.coalesce(cached.get("whitelisted", F.lit(False)), F.lit(False)),
            # A site settled by the prefilter carries no looked-up facts.
            **{
                c: F.when(~screened, F.col(c))
                for c in (
                    "registrar", "creation_date", "expiration_date", "country", "emails",
                    "mx_records", "mx_count", "ip", "ttl", "ns_records", "ns_count", "error",
                )
            },
        }
    )
    return canonical_facts(settled)


def score_sites(
    serp: DataFrame,
    facts: DataFrame,
    as_of,
    prior: DataFrame | None = None,
    lookups: DataFrame | None = None,
    keywords: DataFrame | None = None,
    suffixes: DataFrame | None = None,
    brands: Sequence[str] | None = None,
    threshold: int = config.SUSPICIOUS_THRESHOLD,
    max_age_days: int = config.FACTS_MAX_AGE_DAYS,
    strict_suffix: bool = False,
    keep_query: bool = False,
) -> DataFrame:
    """All columns of the scored sites; see :func:`triage_domains`."""
    keyed = with_normalized_url(with_keyword_order(serp, keywords), "original_url", keep_query)
    sites = first_per_url(keyed)
    if prior is not None:
        sites = skip_processed(sites, prior)
    known = attach_facts(locate(sites, suffixes), facts, as_of, lookups, max_age_days, strict_suffix)
    return score_domain(known, as_of, brands, threshold)


def triage_domains(serp: DataFrame, facts: DataFrame, as_of, **options) -> DataFrame:
    """Result rows for the new sites among the search hits.

    Shuffles: one on normalized_url (first-wins and, co-partitioned with it,
    the skip of earlier results) and one on base_domain for the facts.  Rules
    and suffix lookup are narrow.
    """
    return result_rows(score_sites(serp, facts, as_of, **options))


def update_domain_facts(facts: DataFrame, scored: DataFrame, as_of) -> DataFrame:
    """The facts table after a run: verdicts of ``score_sites`` added, facts kept."""
    return update_facts(facts, verdict_facts(scored, as_of))
