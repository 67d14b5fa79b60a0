"""Domain facts: cache lookup, upsert, extraction from raw answers, prefilter."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urltriage import config
from urltriage.functions.text import (
    as_timestamp,
    clean_list,
    contains_any,
    normalize_date,
    text_array,
    whole_days,
)
from urltriage.functions.urls import url_host, url_scheme
from urltriage.operators.keyed import latest_per_key
from urltriage.schemas import FACTS_PAYLOAD

_EMPTY = "array<string>"

# Canonical record: field -> (type, default); null default means SQL NULL.
CANONICAL = {
    "url": ("string", None),
    "domain": ("string", None),
    "base_domain": ("string", None),
    "title": ("string", ""),
    "snippet": ("string", ""),
    "filtered": ("boolean", False),
    "reasons": (_EMPTY, []),
    "score": ("int", 0),
    "whitelisted": ("boolean", False),
    "is_legit_subdomain": ("boolean", False),
    "cached_at": ("timestamp", None),
    "registrar": ("string", None),
    "creation_date": ("timestamp", None),
    "expiration_date": ("timestamp", None),
    "country": ("string", None),
    "emails": (_EMPTY, []),
    "mx_records": (_EMPTY, []),
    "mx_count": ("int", 0),
    "ip": (_EMPTY, []),
    "ttl": ("int", None),
    "ns_records": (_EMPTY, []),
    "ns_count": ("int", 0),
    "error": ("string", None),
}


def read_payload(df: DataFrame) -> DataFrame:
    """(domain, data JSON, last_updated) to typed facts; bad JSON is a miss."""
    parsed = F.from_json("data", FACTS_PAYLOAD, {"mode": "PERMISSIVE"})
    is_object = F.get_json_object("data", "$").isNotNull() & F.startswith(
        F.ltrim("data"), F.lit("{")
    )
    fields = [
        normalize_date(F.col(f"_p.{f.name}")).alias(f.name)
        if f.name in ("creation_date", "expiration_date")
        else F.col(f"_p.{f.name}").alias(f.name)
        for f in FACTS_PAYLOAD.fields
    ]
    return df.filter(is_object).withColumn("_p", parsed).select(
        F.lower("domain").alias("base_domain"), *fields, "last_updated"
    )


def is_fresh(as_of, max_age_days: int = config.FACTS_MAX_AGE_DAYS) -> Column:
    """Completed days since the last update, not calendar days."""
    return whole_days(as_timestamp(as_of), F.col("last_updated")) <= max_age_days


def fresh_facts(
    sites: DataFrame,
    facts: DataFrame,
    as_of,
    max_age_days: int = config.FACTS_MAX_AGE_DAYS,
    lookups: DataFrame | None = None,
) -> DataFrame:
    """Attach the facts of each site's domain.

    ``facts`` (one row per base_domain) counts only where fresh and marks
    ``cache_hit``; ``lookups`` holds newly acquired facts and serves domains
    without a fresh entry.  Both go through one join on base_domain.
    """
    fresh = facts.filter(is_fresh(as_of, max_age_days)).withColumn("cache_hit", F.lit(True))
    if lookups is not None:
        missing = lookups.join(fresh.select("base_domain"), "base_domain", "left_anti")
        fresh = fresh.unionByName(
            missing.withColumn("cache_hit", F.lit(False)), allowMissingColumns=True
        )
    joined = sites.join(fresh, "base_domain", "left")
    return joined.withColumn("cache_hit", F.coalesce("cache_hit", F.lit(False)))


def domains_to_look_up(
    sites: DataFrame, facts: DataFrame, as_of, max_age_days: int = config.FACTS_MAX_AGE_DAYS
) -> DataFrame:
    """Each domain without fresh facts exactly once."""
    fresh = facts.filter(is_fresh(as_of, max_age_days)).select("base_domain")
    wanted = sites.select("base_domain").filter(F.col("base_domain") != "").distinct()
    return wanted.join(fresh, "base_domain", "left_anti")


def upsert_facts(old: DataFrame, new: DataFrame, as_of) -> DataFrame:
    """Merge by base_domain; a new row replaces the old and is stamped ``as_of``."""
    stamped = new.withColumn("last_updated", as_timestamp(as_of)).withColumn("_new", F.lit(1))
    both = old.withColumn("_new", F.lit(0)).unionByName(stamped, allowMissingColumns=True)
    keyed = both.filter(F.coalesce("base_domain", F.lit("")) != "")
    return latest_per_key(keyed, "base_domain", ["_new", "last_updated"]).drop("_new")


def update_facts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge by base_domain; a new row replaces only the columns that it has.

    For verdicts, which leave the looked-up facts and their age as they are.
    Domains without an old row are added; ``new`` has each domain once.
    """
    marked = new.filter(F.coalesce("base_domain", F.lit("")) != "").withColumn("_new", F.lit(True))
    changed = [c for c in new.columns if c != "base_domain"]
    joined = old.alias("o").join(marked.alias("n"), "base_domain", "full_outer")

    def merged(name: str) -> Column:
        mine = F.col(f"o.{name}") if name in old.columns else F.lit(None)
        if name not in changed:
            return mine.alias(name)
        return F.when(F.col("_new"), F.col(f"n.{name}")).otherwise(mine).alias(name)

    names = [c for c in old.columns if c != "base_domain"]
    return joined.select("base_domain", *map(merged, names + [c for c in changed if c not in names]))


def extract_whois(whois_raw: DataFrame, as_of) -> DataFrame:
    """Creation date, age, warning flag and referral server from WHOIS text."""
    text = F.coalesce("response_text", F.lit(""))
    created = F.regexp_extract(
        text, r"(?i)(Creation Date|Created On|Registered on):\s*(\d{4}-\d{2}-\d{2})", 2
    )
    low = F.lower(text)
    return (
        whois_raw.withColumn("creation_date", F.try_to_timestamp(F.nullif(created, F.lit("")), F.lit("yyyy-MM-dd")))
        .withColumns(
            {
                "age_days": whole_days(as_timestamp(as_of), F.col("creation_date")),
                "whois_suspicious": contains_any(low, ("private", "redacted", "china", "russia")),
                "raw": F.substring(text, 1, 500),
                "referral": F.trim(F.nullif(F.regexp_extract(text, r"whois:[ \t]+([^\r\n]+)", 1), F.lit(""))),
            }
        )
        .drop("response_text")
    )


def _certificate_time(c: Column) -> Column:
    text = F.regexp_replace(F.trim(c), r"\s+", " ")
    return F.try_to_timestamp(text, F.lit("MMM d HH:mm:ss yyyy z"))


def parse_certificates(df: DataFrame) -> DataFrame:
    """Certificate table whose dates are text like ``Jan  5 09:00:00 2025 GMT``."""
    return df.withColumns(
        {"not_before": _certificate_time(F.col("not_before")), "not_after": _certificate_time(F.col("not_after"))}
    )


def tls_status(sites: DataFrame, tls_facts: DataFrame, as_of, url_col: str = "url") -> DataFrame:
    """Add ssl_valid, ssl_issuer and ssl_age_days (joined on the URL's host)."""
    at = as_timestamp(as_of)
    url = F.col(url_col)
    certs = tls_facts.select(
        F.lower("host").alias("_host"),
        "issuer_org",
        "not_before",
        "not_after",
        F.col("error").alias("_tls_error"),
    )
    https = url_scheme(url) == "https"
    dated = (
        F.col("not_before").isNotNull() & F.col("not_after").isNotNull() & F.col("_tls_error").isNull()
    )
    valid = F.when(dated, (at > F.col("not_before")) & (at < F.col("not_after"))).otherwise(F.lit(True))
    issuer = F.when(F.col("_tls_error").isNotNull(), F.lit("Unknown")).otherwise(
        F.coalesce("issuer_org", F.lit("Unknown"))
    )
    # Other schemes get keys of their own that match nothing: as nulls they
    # would all meet in one partition.
    key = F.when(https, url_host(url)).otherwise(F.concat(F.lit("#"), url))
    joined = sites.withColumn("_tls_key", key).join(
        certs, F.col("_tls_key") == F.col("_host"), "left"
    )
    return joined.withColumns(
        {
            # Without a host there is nothing to connect to.
            "ssl_valid": https & (F.coalesce(url_host(url), F.lit("")) != "") & valid,
            "ssl_issuer": F.when(https, issuer),
            "ssl_age_days": F.when(https & dated, whole_days(at, F.col("not_before"))),
        }
    ).drop("_tls_key", "_host", "issuer_org", "not_before", "not_after", "_tls_error")


def rollup_dns(dns_answers: DataFrame) -> DataFrame:
    """One row per domain: records of the first resolver that answered, by type.

    Answers are reduced by type and resolver before they meet, so a domain never
    holds the answers of all its resolvers at once, nor repeated ones.
    """
    ok = F.col("status") == "ok"
    value = F.regexp_replace("value", r"[.]+$", "")
    by_resolver = (
        dns_answers.select(
            F.lower("domain").alias("base_domain"),
            "rrtype",
            F.when(ok, F.col("resolver_rank")).alias("rank"),
            F.when(ok, value).alias("value"),
            F.when(ok, F.col("ttl")).alias("ttl"),
        )
        .groupBy("base_domain", "rrtype", "rank")
        .agg(F.array_sort(F.collect_set("value")).alias("values"), F.min("ttl").alias("ttl"))
    )
    first = by_resolver.groupBy("base_domain", "rrtype").agg(
        F.min_by(F.struct("values", "ttl"), "rank").alias("first")
    )

    def of_type(kind: str) -> Column:
        return F.max(F.when(F.col("rrtype") == kind, F.col("first"))).alias(kind)

    def values(kind: str) -> Column:
        return F.coalesce(F.col(f"{kind}.values"), F.array().cast(_EMPTY))

    return (
        first.groupBy("base_domain")
        .agg(*map(of_type, ("MX", "A", "NS")))
        .select("base_domain", values("MX").alias("mx_records"), values("A").alias("ip"), F.col("A.ttl").alias("ttl"), values("NS").alias("ns_records"))
        .withColumns({"mx_count": F.size("mx_records"), "ns_count": F.size("ns_records")})
        .select("base_domain", "mx_records", "mx_count", "ip", "ttl", "ns_records", "ns_count")
    )


def prefilter(sites: DataFrame, strict_suffix: bool = False, url_col: str = "url") -> DataFrame:
    """Mark sites that need no facts: educational text, known or trusted domains.

    The first matching reason wins.  The tests are substring and suffix
    patterns, evaluated before anything expensive.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    base = F.coalesce("base_domain", F.lit(""))
    text = F.lower(F.concat_ws(" ", url, F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))))
    domains = "|".join(re.escape(d) for d in config.IRRELEVANT_DOMAINS)
    irrelevant = base.rlike(rf"{'(^|[.])' if strict_suffix else ''}(?:{domains})\z")
    trusted_url = url.rlike("(?i)" + "|".join(config.TRUSTED_URL_PATTERNS))
    reason = (
        F.when(
            contains_any(text, config.ANTI_PHISHING_WORDS + config.IRRELEVANT_WORDS),
            F.lit("Irrelevant or educational content"),
        )
        .when(irrelevant, F.lit("Irrelevant domain"))
        .when((base != "") & (base.isin(*config.TRUSTED_DOMAINS) | trusted_url), F.lit("Whitelist match"))
    )
    legit = url.rlike("(?i)" + config.LEGIT_SUBDOMAIN_PATTERN)
    return sites.withColumn("prefilter_reason", reason).withColumn(
        "is_legit_subdomain",
        F.coalesce(F.col("prefilter_reason") == "Whitelist match", F.lit(True)) & legit,
    )


def _default(kind: str, value) -> Column:
    if isinstance(value, list):
        return text_array(value)
    return F.lit(value).cast(kind)


def canonical_facts(df: DataFrame) -> DataFrame:
    """All 23 fields of a record, typed, with defaults for absent values.

    A record that carries a lookup error counts as filtered with no reasons.
    """
    present = set(df.columns)
    columns = {}
    for name, (kind, default) in CANONICAL.items():
        value = F.col(name).cast(kind) if name in present else F.lit(None).cast(kind)
        columns[name] = value if default is None else F.coalesce(value, _default(kind, default))
    if "error" in present:
        failed = F.col("error").isNotNull()
        columns["filtered"] = failed | columns["filtered"]
        columns["score"] = F.when(failed, F.lit(50)).otherwise(columns["score"])
        columns["reasons"] = F.when(failed, text_array([])).otherwise(columns["reasons"])
        columns["whitelisted"] = ~failed & columns["whitelisted"]
        columns["is_legit_subdomain"] = ~failed & columns["is_legit_subdomain"]
    for name in ("emails", "mx_records", "ip", "ns_records"):
        columns[name] = clean_list(columns[name])
    return df.withColumns(columns)
