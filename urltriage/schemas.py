"""Schemas of the tables that go in and out."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "binary": T.BinaryType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def table(columns: str) -> T.StructType:
    """Flat schema from text; unlike a DDL string it needs no running session."""
    pairs = (c.split() for c in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SERP_ITEMS = table(
    "keyword string, rank int, original_url string, title string, snippet string"
)
SERP_PAGES = table("brand string, query string, query_seq int, html string")
PAGE_SNAPSHOTS = table(
    "url string, status int, final_url string, html string, error string"
)
DOMAIN_FACTS = table(
    "base_domain string, registrar string, creation_date timestamp, expiration_date timestamp, "
    "country string, emails array<string>, mx_records array<string>, mx_count int, "
    "ip array<string>, ttl int, ns_records array<string>, ns_count int, error string, "
    "last_updated timestamp"
)
# Payload of the JSON column of a facts table kept as (domain, data, last_updated).
FACTS_PAYLOAD = table(
    "registrar string, creation_date string, expiration_date string, country string, "
    "emails array<string>, mx_records array<string>, mx_count int, ip array<string>, ttl int, "
    "ns_records array<string>, ns_count int, error string"
)
TLS_FACTS = table(
    "host string, issuer_org string, not_before timestamp, not_after timestamp, error string"
)
DNS_ANSWERS = table(
    "domain string, rrtype string, resolver_rank int, value string, ttl int, status string"
)
WHOIS_RAW = table("domain string, response_text string")
IMAGES = table("src string, content binary")
PUBLIC_SUFFIX = table("suffix string, rule_type string")
RESULTS = table(
    "url string, normalized_url string, domain string, keyword string, title string, "
    "snippet string, reasons array<string>, score int, suspicious boolean, filtered boolean, "
    "whitelisted boolean, registrar string, creation_date timestamp, expiration_date timestamp, "
    "ns_records array<string>, mx_records array<string>, last_checked timestamp"
)
CONTENT_ANALYSIS = (
    "struct<text_snippets:array<string>,"
    "forms_details:array<struct<action:string,action_domain:string,method:string,"
    "has_password:boolean,has_email:boolean,suspicious_inputs:boolean,"
    "inputs:array<struct<type:string,name:string>>,inputs_count:int>>,"
    "logo_matches:array<struct<src:string,alt:string,title:string>>>"
)
ANALYSIS_HISTORY = table(
    "url string, brand string, base_domain string, score double, category string, "
    "reasons array<string>, analyzed_at timestamp, analysis_time_s double, content_analysis string"
)
