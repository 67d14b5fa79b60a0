"""Domain-side queries with their comparison SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urltriage import config as C
from urltriage.functions import text as X
from urltriage.functions.similarity import typosquat_score
from urltriage.functions.urls import with_normalized_url, with_url_parts
from urltriage.operators import facts as D
from urltriage.operators import results as K
from urltriage.operators.domain_risk import score_domain
from urltriage.operators.mentions import similar_pairs
from urltriage.operators.suffix import inline_table, with_registrable_domain
from urltriage.plans import fixtures as fx
from urltriage.plans.domain_triage import (
    locate,
    score_sites,
    triage_domains,
    update_domain_facts,
    with_keyword_order,
)
from urltriage.plans.registry import query, sql_list, with_tables
from urltriage.schemas import SERP_ITEMS
from urltriage.session import shared_folder
from urltriage.sources.readers import read_results
from urltriage.sources.writers import export_csv, export_suspicious_csv, write_results
from urltriage.streaming.incremental import results_so_far, triage_stream

AT = f"timestamp '{fx.AS_OF}'"

# --- shared comparison steps ----------------------------------------------
NORMAL = (
    "lower(regexp_extract({u}, '^[a-zA-Z]+://[^/?#]*')) || "
    "rtrim(regexp_extract({u}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/')"
)
HOST = "regexp_extract({u}, '^[a-z]+://([^/?#:]*)', 1)"
SUFFIX_ROWS = ", ".join(f"('{s}')" for s in fx.SUFFIXES)
O_SUFFIX = ("o_suffix", f"select * from (values {SUFFIX_ROWS}) v(suffix)")


def located(source: str, url: str = "original_url") -> list[tuple[str, str]]:
    """Host, suffix and registrable domain per row of ``source``."""
    return [
        O_SUFFIX,
        ("o_hosted", f"select *, {HOST.format(u=url)} as host from {source}"),
        (
            "o_best",
            """select h.host, max_by(s.suffix, length(s.suffix)) as suffix
               from (select distinct host from o_hosted) h
               left join o_suffix s on h.host = s.suffix or ends_with(h.host, '.' || s.suffix)
               group by h.host""",
        ),
        (
            "o_located",
            """select o.*, coalesce(b.suffix, '') as suffix,
               regexp_extract(o.host, '([^.]*)[.]' || replace(b.suffix, '.', '[.]') || '$', 1) as domain_core,
               case when b.suffix is null then o.host
                 else regexp_extract(o.host, '([^.]*)[.]' || replace(b.suffix, '.', '[.]') || '$', 1) || '.' || b.suffix end as base_domain
               from o_hosted o join o_best b on o.host = b.host""",
        ),
    ]


O_FACTS = (
    "o_facts",
    f"""select base_domain, registrar, {AT} - to_days(cast(age_days as integer)) as creation_date,
      list_filter(string_split(emails_csv, ','), lambda x: x <> '') as emails, mx_count,
      list_filter(string_split(ip_csv, ','), lambda x: x <> '') as ip, ttl, ns_count,
      list_filter(string_split(ns_csv, ','), lambda x: x <> '') as ns_records, error, stale_days
      from fx_facts""",
)


def scored(source: str, brands=()) -> list[tuple[str, str]]:
    """Rule evaluation; ``source`` has url, host, base_domain, suffix, title,
    snippet, filtered, stored and the fact columns."""
    present = " or ".join(
        f"contains(base_domain, '{b}') or contains(t, '{b}') or contains(s, '{b}') or contains(p, '{b}')"
        f" or list_contains(toks, '{b}')"
        for b in brands
    ) or "false"

    def hits(words):
        return f"list_sort(list_intersect(toks, {sql_list(words)}))"

    low_ns = " or ".join(f"contains(lower(n), '{w}')" for w in C.TRUSTED_NAMESERVER_WORDS)
    return [
        (
            "s1",
            f"""select *, lower(coalesce(title, '')) as t, lower(coalesce(snippet, '')) as s,
            lower(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')) as p,
            datediff('second', creation_date, {AT}) // 86400 as age from {source}""",
        ),
        (
            "s2",
            r"""select *, list_distinct(list_filter(regexp_split_to_array(base_domain || ' ' || p || ' ' || t || ' ' || s,
            '[\s\-/?&=_.,:;!]+'), lambda x: x <> '')) as toks from s1""",
        ),
        (
            "s3",
            f"""select *, ({present}) as brand, {hits(C.HIGH_CONFIDENCE_WORDS)} as hc,
            {hits(C.PROMO_WORDS)} as promo, {hits(C.SITE_URGENCY_WORDS)} as urg,
            list_filter({sql_list(C.KNOWN_DOMAINS)}, lambda k: abs(length(base_domain) - length(k)) <= 6
              and (1 - levenshtein(base_domain, k) / greatest(length(base_domain), length(k)) > 0.9
                or jaro_winkler_similarity(base_domain, k) > 0.95)) as sim,
            case when len(string_split(host, '.')) > 3
              then array_to_string(list_slice(string_split(host, '.'), 1, -3), '.') else '' end as sub,
            coalesce(age < 180, false) as r2, len(coalesce(emails, [])) = 0 as r3,
            trim(coalesce(registrar, '')) = '' as r4,
            suffix in ('xyz', 'top', 'tk', 'ga', 'ml', 'cf') as r5h,
            suffix in ('cn', 'ru', 'info', 'io', 'cc', 'im', 'ai') as r5l,
            coalesce(mx_count, 0) = 0 as r6, coalesce(ttl < 300, false) as r7,
            len(coalesce(ip, [])) = 0 as r8a, len(coalesce(ip, [])) > 5 as r8b,
            coalesce(ns_count, 0) <= 1 as r9a,
            len(coalesce(ns_records, [])) > 0 and len(list_filter(coalesce(ns_records, []), lambda n: {low_ns})) = 0 as r9b,
            not starts_with(lower(url), 'https') as r10 from s2""",
        ),
        ("s4", "select *, (r2 or r3 or r4 or r5h or r5l or r7 or r8a or r8b or r9a or r10) as strong0 from s3"),
        (
            "s5",
            """select *, strong0 or (len(hc) > 0 and brand) as strong1,
            (contains(sub, 'login') or contains(sub, 'secure') or contains(sub, 'account') or contains(sub, 'verify')) as r16
            from s4""",
        ),
        (
            "s6",
            """select *, least(100,
              case when r2 then 20 else 0 end + case when r3 then 8 else 0 end + case when r4 then 12 else 0 end
              + case when r5h then 45 when r5l then 12 else 0 end + case when r6 then 12 else 0 end
              + case when r7 then 10 else 0 end + case when r8a then 10 else 0 end + case when r9a then 10 else 0 end
              + case when r9b then 10 else 0 end + case when r8b then 10 else 0 end + case when r10 then 12 else 0 end
              + len(hc) * (case when brand then 30 when strong0 then 18 else 4 end)
              + case when len(promo) = 0 then 0 when brand then 6 * len(promo) when strong1 then 3 * len(promo) else 3 end
              + case when len(urg) = 0 then 0 when brand or strong1 or len(promo) > 0 then 4 * len(urg) else 2 end
              + 40 * len(sim) + case when r16 then 8 else 0 end) as pts,
            strong1 or len(sim) > 0 or r16 as strong2,
            list_filter([
              case when r2 then 'Creado hace ' || age || ' días (<180)' end,
              case when r3 then 'Sin emails en WHOIS' end,
              case when r4 then 'Sin registrador confiable' end,
              case when r5h then 'TLD de alto riesgo: .' || suffix when r5l then 'TLD de riesgo medio: .' || suffix end,
              case when r6 then 'Sin MX records' end,
              case when r7 then 'TTL corto: ' || ttl || 's' end,
              case when r8a then 'No resuelve IP' end,
              case when r9a then 'Pocos NS records' end,
              case when r9b then 'Nameservers no confiables' end,
              case when r8b then 'Múltiples IPs (fast-flux?)' end,
              case when r10 then 'Sin HTTPS' end,
              case when len(hc) = 0 then null
                when brand then 'Keywords de alta confianza (contexto marca): ' || array_to_string(hc, ', ')
                when strong0 then 'Keywords de alta confianza (con señales fuertes): ' || array_to_string(hc, ', ')
                else 'Keywords de alta confianza (aisladas): ' || array_to_string(hc, ', ') end,
              case when len(promo) = 0 then null
                when brand then 'Keywords promocionales junto a marca: ' || array_to_string(promo, ', ')
                when strong1 then 'Keywords promocionales con señales fuertes: ' || array_to_string(promo, ', ')
                else 'Keywords promocionales aisladas: ' || array_to_string(promo, ', ') end,
              case when len(urg) > 0 and (brand or strong1 or len(promo) > 0)
                then 'Keywords urgencia: ' || array_to_string(urg, ', ') end
              ], lambda x: x is not null)
              || list_transform(sim, lambda k: 'Similar a ' || k || ' (typosquatting posible)')
              || case when r16 then ['Subdominio sospechoso: ' || sub] else [] end as rs
            from s5""",
        ),
        (
            "o_scored",
            """select * exclude (title, snippet), title, snippet,
            case when filtered then false else pts >= 50 or (strong2 and brand) end as suspicious,
            case when filtered then stored when pts < 50 and strong2 and brand
              then rs || ['Señales fuertes combinadas con mención de marca'] else rs end as reasons,
            case when filtered then 0 else pts end as score from s6""",
        ),
    ]



def _ints(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return with_keyword_order(fx.derive(spark, sf, "fx_hits"), fx.keywords(spark))


def _prior_keys(spark: SparkSession, sf: str) -> DataFrame:
    old = fx.derive(spark, sf, "fx_sites").filter(F.col("page_id") % 4 == 0)
    return with_normalized_url(old).select("normalized_url")


# --- U: URL and domain functions ------------------------------------------
@query(
    "url_parts",
    with_tables(
        ["fx_sites"],
        [],
        r"""select page_id, regexp_extract(original_url, '^([a-z]+):', 1) as scheme,
        regexp_extract(original_url, '^[a-z]+://([^/?#]*)', 1) as netloc,
        regexp_extract(original_url, '^[a-z]+://([^/?#:]*)', 1) as host,
        lower(regexp_extract(original_url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) as path,
        starts_with(original_url, 'https:') as is_https, starts_with(original_url, 'https') as starts_https
        from fx_sites""",
    ),
)
def url_parts(spark, sf):
    return with_url_parts(fx.derive(spark, sf, "fx_sites"), "original_url").select(
        "page_id", "scheme", "netloc", "host", "path", "is_https", "starts_https"
    )


@query(
    "registrable_domain",
    with_tables(
        ["fx_sites"],
        located("fx_sites"),
        """select page_id, host, suffix, domain_core, base_domain,
        case when len(host) > len(base_domain) then host[1:len(host) - len(base_domain) - 1] else '' end as subdomain
        from o_located""",
    ),
)
def registrable_domain(spark, sf):
    sites = with_url_parts(fx.derive(spark, sf, "fx_sites"), "original_url")
    return with_registrable_domain(sites, "host", fx.suffixes(spark)).select(
        "page_id", "host", "suffix", "domain_core", "base_domain", "subdomain"
    )


FIRST_HITS = [
    (
        "o_first",
        f"""select * exclude (rn) from (select *, row_number() over (partition by normalized_url
        order by kseq, rank, original_url) as rn from (select *, {NORMAL.format(u='original_url')} as normalized_url,
        case keyword when 'acme' then 0 else 1 end as kseq from fx_hits) a) b where rn = 1""",
    )
]


@query(
    "url_normalize_dedup",
    with_tables(
        ["fx_hits"],
        FIRST_HITS,
        "select normalized_url, keyword, rank, original_url from o_first",
    ),
)
def url_normalize_dedup(spark, sf):
    return K.first_per_url(with_normalized_url(_hits(spark, sf))).select(
        "normalized_url", "keyword", "rank", "original_url"
    )


@query(
    "skip_processed",
    with_tables(
        ["fx_hits"],
        FIRST_HITS,
        f"""select normalized_url, keyword, rank from o_first where normalized_url not in
        (select {NORMAL.format(u='original_url')} from fx_sites where page_id % 4 = 0)""",
    ),
)
def skip_processed(spark, sf):
    first = K.first_per_url(with_normalized_url(_hits(spark, sf)))
    return K.skip_processed(first, _prior_keys(spark, sf)).select("normalized_url", "keyword", "rank")


@query(
    "typosquat_brand",
    with_tables(
        ["fx_sites"],
        located("fx_sites"),
        """select page_id, keyword as brand, domain_core,
        round(case when domain_core = keyword then 0
          else 0.6 * (1 - levenshtein(keyword, domain_core) / greatest(length(keyword), length(domain_core)))
            + 0.4 * jaro_winkler_similarity(keyword, domain_core) end, 6) as typo_score
        from o_located""",
    ),
)
def typosquat_brand(spark, sf):
    sites = locate(fx.derive(spark, sf, "fx_sites"), fx.suffixes(spark))
    return sites.select(
        "page_id",
        F.col("keyword").alias("brand"),
        "domain_core",
        F.round(F.expr(typosquat_score("keyword", "domain_core")), 6).alias("typo_score"),
    )


@query(
    "typosquat_known",
    with_tables(
        ["fx_sites"],
        located("fx_sites"),
        f"""select base_domain, known, round(jaro_winkler_similarity(base_domain, known), 6) as jw,
        round(1 - levenshtein(base_domain, known) / greatest(length(base_domain), length(known)), 6) as lev
        from (select distinct base_domain from o_located), (select unnest({sql_list(C.KNOWN_DOMAINS)}) as known)
        where abs(length(base_domain) - length(known)) <= 6
        and (jaro_winkler_similarity(base_domain, known) > 0.95
         or 1 - levenshtein(base_domain, known) / greatest(length(base_domain), length(known)) > 0.9)""",
    ),
)
def typosquat_known(spark, sf):
    sites = locate(fx.derive(spark, sf, "fx_sites"), fx.suffixes(spark))
    known = inline_table(spark, [(d,) for d in C.KNOWN_DOMAINS], "known")
    pairs = similar_pairs(
        sites.select("base_domain"),
        known,
        min_jw=C.SIMILAR_MIN_JARO_WINKLER,
        min_lev=C.SIMILAR_MIN_LEVENSHTEIN,
        max_len_diff=C.SIMILAR_MAX_LENGTH_GAP,
    )
    return pairs.select("base_domain", "known", F.round("jw", 6).alias("jw"), F.round("lev", 6).alias("lev"))


@query(
    "date_normalize",
    with_tables(
        ["pages"],
        [
            (
                "o_day",
                """select page_id, strftime(d, '%Y-%m-%d') as iso, strftime(d, '%m/%d/%Y') as us
                from (select page_id, date '2023-01-01' + cast(page_id * 13 % 700 as integer) as d from pages) p""",
            ),
            (
                "o_raw",
                """select page_id, case page_id % 7 when 0 then iso when 1 then iso || 'T01:02:03Z'
                when 2 then iso || ' 01:02:03.123' when 3 then us when 4 then 'unknown'
                when 5 then null else iso || ' 23:59:59' end as raw from o_day""",
            ),
        ],
        f"""select page_id, raw, strftime(d, '%Y-%m-%d %H:%M:%S') as parsed,
        cast(floor((epoch({AT}) - epoch(d)) / 86400) as bigint) as age_days
        from (select page_id, raw, coalesce(try_strptime(left(replace(raw, 'T', ' '), 19), '%Y-%m-%d %H:%M:%S'),
          try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%m/%d/%Y')) as d from o_raw) x""",
    ),
)
def date_normalize(spark, sf):
    day = F.date_add(F.lit("2023-01-01").cast("date"), (F.col("page_id") * 13 % 700).cast("int"))
    iso, us = F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "MM/dd/yyyy")
    layouts = F.array(
        iso, F.concat(iso, F.lit("T01:02:03Z")), F.concat(iso, F.lit(" 01:02:03.123")), us,
        F.lit("unknown"), F.lit(None).cast("string"), F.concat(iso, F.lit(" 23:59:59")),
    )
    raw = F.get(layouts, (F.col("page_id") % 7).cast("int"))
    pages = fx.scan(spark, sf, "pages").select("page_id", raw.alias("raw"))
    parsed = pages.withColumn("d", X.first_date(F.array("raw", F.lit("1999-01-01"))))
    return parsed.select(
        "page_id",
        "raw",
        F.date_format("d", "yyyy-MM-dd HH:mm:ss").alias("parsed"),
        X.whole_days(X.as_timestamp(fx.AS_OF), F.col("d")).cast("bigint").alias("age_days"),
    )


# --- D: domain facts --------------------------------------------------------
@query(
    "facts_fresh_lookup",
    with_tables(
        ["fx_sites", "fx_facts"],
        [*located("fx_sites"), O_FACTS],
        """select l.page_id, l.base_domain, f.base_domain is not null as cache_hit, f.registrar, f.mx_count,
        array_to_string(f.ip, ',') as ip, f.ttl, l.title
        from o_located l left join (select * from o_facts where stale_days <= 7) f on l.base_domain = f.base_domain""",
    ),
)
def facts_fresh_lookup(spark, sf):
    """Goes through the JSON-payload form of the cache."""
    facts = fx.facts(spark, sf)
    cached = facts.select(
        F.col("base_domain").alias("domain"),
        F.to_json(F.struct(*[c for c in facts.columns if c not in ("base_domain", "last_updated")])).alias("data"),
        "last_updated",
    )
    sites = locate(fx.derive(spark, sf, "fx_sites"), fx.suffixes(spark))
    out = D.fresh_facts(sites, D.read_payload(cached), fx.AS_OF)
    return _ints(
        out.select(
            "page_id", "base_domain", "cache_hit", "registrar", "mx_count",
            F.array_join("ip", ",").alias("ip"), "ttl", "title",
        ),
        "mx_count", "ttl",
    )


@query(
    "facts_upsert",
    with_tables(
        ["fx_sites", "fx_facts"],
        [],
        """select base_domain, case when n % 2 = 0 then 'New registrar' else registrar end as registrar,
        case when n % 2 = 0 then 9 else mx_count end as mx_count,
        case when n % 2 = 0 then '2025-01-01 00:00:00'
          else strftime(timestamp '2025-01-01 00:00:00' - to_days(cast(stale_days as integer)) - to_hours(5), '%Y-%m-%d %H:%M:%S') end as last_updated
        from fx_facts
        union all select 'new.example' || page_id, 'Only new', 1, '2025-01-01 00:00:00' from fx_sites where page_id % 50 = 0""",
    ),
)
def facts_upsert(spark, sf):
    old = fx.facts(spark, sf)
    even = fx.derive(spark, sf, "fx_facts").filter(F.col("n") % 2 == 0).select("base_domain")
    changed = even.select("base_domain", F.lit("New registrar").alias("registrar"), F.lit(9).alias("mx_count"))
    added = (
        fx.derive(spark, sf, "fx_sites")
        .filter(F.col("page_id") % 50 == 0)
        .select(
            F.concat(F.lit("new.example"), F.col("page_id").cast("string")).alias("base_domain"),
            F.lit("Only new").alias("registrar"),
            F.lit(1).alias("mx_count"),
        )
    )
    merged = D.upsert_facts(old, changed.unionByName(added), fx.AS_OF)
    return _ints(
        merged.select(
            "base_domain", "registrar", "mx_count",
            F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("last_updated"),
        ),
        "mx_count",
    )


@query(
    "facts_distinct_domains",
    with_tables(
        ["fx_sites", "fx_facts"],
        [*located("fx_sites"), O_FACTS],
        """select d.base_domain, f.error is not null as filtered, case when f.error is not null then 50 else 0 end as score,
        '' as reasons, coalesce(f.mx_count, 0) as mx_count, coalesce(f.ns_count, 0) as ns_count,
        array_to_string(coalesce(f.emails, []), ',') as emails, false as whitelisted
        from (select distinct base_domain from o_located where base_domain not in (select base_domain from o_facts where stale_days <= 7)) d
        left join o_facts f on d.base_domain = f.base_domain""",
    ),
)
def facts_distinct_domains(spark, sf):
    """Each domain to look up once, enriched from the acquired facts, canonical."""
    facts = fx.facts(spark, sf)
    sites = locate(fx.derive(spark, sf, "fx_sites"), fx.suffixes(spark))
    wanted = D.domains_to_look_up(sites, facts, fx.AS_OF)
    found = wanted.join(facts, "base_domain", "left")
    out = D.canonical_facts(found).select(
        "base_domain", "filtered", "score", F.array_join("reasons", " | ").alias("reasons"),
        "mx_count", "ns_count", F.array_join("emails", ",").alias("emails"), "whitelisted",
    )
    return _ints(out, "score", "mx_count", "ns_count")


@query(
    "whois_extract",
    with_tables(
        ["fx_whois"],
        [],
        f"""select domain, d as creation_date, datediff('day', cast(d as date), date '2025-01-01') as age_days,
        (contains(lower(response_text), 'redacted') or contains(lower(response_text), 'china')) as whois_suspicious,
        response_text[1:500] as raw, 'whois.example' as referral
        from (select *, nullif(regexp_extract(response_text, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '') as d from fx_whois) x""",
    ),
)
def whois_extract(spark, sf):
    out = D.extract_whois(fx.derive(spark, sf, "fx_whois"), fx.AS_OF)
    return _ints(
        out.withColumn("creation_date", F.date_format("creation_date", "yyyy-MM-dd")), "age_days"
    )


O_TLS = (
    "o_tls",
    """select s.*, case when https then coalesce(t.host is null or t.error is not null or
        (t.started_days_ago > 0 and t.started_days_ago < 90), true) else false end as ssl_valid,
      case when not https then null when t.host is null or t.error is not null then 'Unknown'
        else coalesce(t.issuer_org, 'Unknown') end as ssl_issuer,
      case when https and t.error is null then t.started_days_ago end as ssl_age_days
      from (select *, starts_with(url, 'https:') as https from {source}) s
      left join fx_tls t on s.https and s.host = t.host""",
)


@query(
    "tls_facts",
    with_tables(
        ["fx_sites", "fx_tls"],
        [
            ("o_src", "select *, original_url as url, " + HOST.format(u="original_url") + " as host from fx_sites"),
            (O_TLS[0], O_TLS[1].format(source="o_src")),
        ],
        "select page_id, ssl_valid, ssl_issuer, ssl_age_days from o_tls",
    ),
)
def tls_facts(spark, sf):
    sites = fx.derive(spark, sf, "fx_sites").withColumn("url", F.col("original_url"))
    text = fx.tls(spark, sf).withColumns(
        {
            c: F.regexp_replace(F.date_format(c, "MMM d HH:mm:ss yyyy 'GMT'"), r" (\d) ", "  $1 ")
            for c in ("not_before", "not_after")
        }
    )
    out = D.tls_status(sites, D.parse_certificates(text), fx.AS_OF)
    return _ints(out.select("page_id", "ssl_valid", "ssl_issuer", "ssl_age_days"), "ssl_age_days")


@query(
    "dns_rollup",
    with_tables(
        ["fx_dns"],
        [
            (
                "best",
                """select domain, rrtype, min(resolver_rank) as rank from fx_dns where status = 'ok' group by 1, 2""",
            ),
            (
                "used",
                """select d.* from fx_dns d join best b on d.domain = b.domain and d.rrtype = b.rrtype
                and d.resolver_rank = b.rank where d.status = 'ok'""",
            ),
        ],
        """select a.domain as base_domain,
        coalesce(string_agg(distinct rtrim(u.value, '.'), ',' order by rtrim(u.value, '.')) filter (u.rrtype = 'MX'), '') as mx_records,
        count(distinct u.value) filter (u.rrtype = 'MX') as mx_count,
        coalesce(string_agg(distinct u.value, ',' order by u.value) filter (u.rrtype = 'A'), '') as ip,
        min(u.ttl) filter (u.rrtype = 'A') as ttl,
        coalesce(string_agg(distinct rtrim(u.value, '.'), ',' order by rtrim(u.value, '.')) filter (u.rrtype = 'NS'), '') as ns_records,
        count(distinct u.value) filter (u.rrtype = 'NS') as ns_count
        from (select distinct domain from fx_dns) a left join used u on a.domain = u.domain group by a.domain""",
    ),
)
def dns_rollup(spark, sf):
    out = D.rollup_dns(fx.derive(spark, sf, "fx_dns"))
    lists = {c: F.array_join(c, ",") for c in ("mx_records", "ip", "ns_records")}
    return _ints(out.withColumns(lists), "mx_count", "ttl", "ns_count")


def _prefilter_case(base: str, text: str) -> str:
    words = " or ".join(
        f"contains({text}, '{w}')" for w in dict.fromkeys(C.ANTI_PHISHING_WORDS + C.IRRELEVANT_WORDS)
    )
    irrelevant = " or ".join(f"ends_with({base}, '{d}')" for d in C.IRRELEVANT_DOMAINS)
    trusted = ", ".join(f"'{d}'" for d in C.TRUSTED_DOMAINS)
    return f"""case when {words} then 'Irrelevant or educational content'
      when {irrelevant} then 'Irrelevant domain' when {base} in ({trusted}) then 'Whitelist match' end"""


O_PREFILTERED = (
    "o_prefiltered",
    "select *, "
    + _prefilter_case("base_domain", "lower(original_url || ' ' || title || ' ' || snippet)")
    + " as pre from o_located",
)


# Addresses that are not judged further, and some without a scheme.
_SCREENED_URL = """case page_id % 11 when 4 then concat('m.shop', cast(page_id as string), '.com/x')
 when 5 then concat('https://www.reddit.com/r/p', cast(page_id as string))
 when 6 then concat('https://login.apple.com/p', cast(page_id as string))
 when 7 then concat('https://notx.com/p', cast(page_id as string)) else original_url end"""
_SCREENED_TITLE = "case when page_id % 11 between 4 and 7 then 'Plain title' else title end"


@query(
    "prefilter",
    with_tables(
        ["fx_sites"],
        [
            ("o_screened", f"select * replace ({_SCREENED_URL} as original_url, {_SCREENED_TITLE} as title) from fx_sites"),
            *located("o_screened"),
            O_PREFILTERED,
        ],
        f"""select page_id, pre as prefilter_reason, pre is not null as filtered,
        coalesce(pre = 'Whitelist match', true) and regexp_matches(original_url, '(?i){C.LEGIT_SUBDOMAIN_PATTERN}') as is_legit_subdomain
        from o_prefiltered""",
    ),
)
def prefilter(spark, sf):
    sites = fx.derive(spark, sf, "fx_sites").withColumns(
        {"original_url": F.expr(_SCREENED_URL), "title": F.expr(_SCREENED_TITLE)}
    )
    return D.prefilter(locate(sites, fx.suffixes(spark))).select(
        "page_id",
        "prefilter_reason",
        F.col("prefilter_reason").isNotNull().alias("filtered"),
        "is_legit_subdomain",
    )


# --- R, K: scoring and results ---------------------------------------------
def _with_all_facts(spark: SparkSession, sf: str) -> DataFrame:
    sites = locate(fx.derive(spark, sf, "fx_sites"), fx.suffixes(spark))
    return D.canonical_facts(sites.join(fx.facts(spark, sf), "base_domain", "left"))


@query(
    "domain_score",
    with_tables(
        ["fx_sites", "fx_facts"],
        [
            *located("fx_sites"),
            O_FACTS,
            (
                "o_in",
                """select l.*, l.original_url as url, f.* exclude (base_domain), f.error is not null as filtered,
                cast([] as varchar[]) as stored from o_located l left join o_facts f on l.base_domain = f.base_domain""",
            ),
            *scored("o_in", fx.BRANDS),
        ],
        "select page_id, suspicious, array_to_string(reasons, ' | ') as reasons, score from o_scored",
    ),
)
def domain_score(spark, sf):
    out = score_domain(_with_all_facts(spark, sf), fx.AS_OF, brands=fx.BRANDS)
    return _ints(
        out.select("page_id", "suspicious", F.array_join("reasons", " | ").alias("reasons"), "score"), "score"
    )


def triage_steps(skip_prior: bool = True) -> list[tuple[str, str]]:
    known = (
        f"where p.normalized_url not in (select {NORMAL.format(u='original_url')} from fx_sites where page_id % 4 = 0)"
        if skip_prior
        else ""
    )
    return [
        *FIRST_HITS,
        *located("o_first"),
        O_PREFILTERED,
        O_FACTS,
        (
            "o_in",
            f"""select p.* exclude (pre), p.original_url as url, f.base_domain is not null as hit,
            case when f.base_domain is null then p.pre end as pre,
            f.registrar, f.creation_date, f.emails, f.mx_count, f.ip, f.ttl, f.ns_count, f.ns_records, f.error,
            f.error is not null or (f.base_domain is null and p.pre is not null) as filtered,
            case when f.base_domain is null and p.pre is not null then [p.pre] else cast([] as varchar[]) end as stored
            from o_prefiltered p left join (select * from o_facts where stale_days <= 7) f on p.base_domain = f.base_domain
            {known}""",
        ),
        *scored("o_in"),
    ]


TRIAGE_SELECT = """select keyword, normalized_url, base_domain as domain, suspicious,
 array_to_string(reasons, ' | ') as reasons, score, pre is not null as whitelisted, filtered, registrar,
 strftime(creation_date, '%Y-%m-%d %H:%M:%S') as creation_date, coalesce(mx_count, 0) as mx_count, ttl,
 array_to_string(coalesce(ns_records, []), ',') as ns_records, coalesce(ns_count, 0) as ns_count from o_scored"""
DOMAIN_TRIAGE_SQL = with_tables(["fx_hits", "fx_facts"], triage_steps(), TRIAGE_SELECT)


def triage_input(spark, sf, skip_prior: bool = True) -> DataFrame:
    return triage_domains(
        fx.derive(spark, sf, "fx_hits"),
        fx.facts(spark, sf),
        fx.AS_OF,
        prior=_prior_keys(spark, sf) if skip_prior else None,
        keywords=fx.keywords(spark),
        suffixes=fx.suffixes(spark),
    )


def triage_view(results: DataFrame) -> DataFrame:
    return _ints(
        results.select(
            "keyword", "normalized_url", "domain", "suspicious",
            F.array_join("reasons", " | ").alias("reasons"), "score", "whitelisted", "filtered",
            "registrar", F.date_format("creation_date", "yyyy-MM-dd HH:mm:ss").alias("creation_date"),
            "mx_count", "ttl", F.array_join("ns_records", ",").alias("ns_records"), "ns_count",
        ),
        "score", "mx_count", "ttl", "ns_count",
    )


@query("domain_triage", DOMAIN_TRIAGE_SQL)
def domain_triage(spark, sf):
    return triage_view(triage_input(spark, sf))


# --- K, S: results life cycle -------------------------------------------------
def _prior_results(spark, sf) -> DataFrame:
    """Earlier results of every third site, a day older."""
    old = with_normalized_url(fx.derive(spark, sf, "fx_sites").filter(F.col("page_id") % 3 == 0))
    return K.storable(
        old.select(
            F.concat(F.lit("old-"), "keyword").alias("keyword"),
            F.col("original_url").alias("url"),
            "normalized_url",
            F.lit(-7).alias("score"),
            F.array(F.lit("earlier")).alias("reasons"),
            F.lit(False).alias("suspicious"),
        ),
        "2024-12-31 00:00:00",
    )


@query(
    "results_upsert",
    with_tables(
        ["fx_hits", "fx_facts"],
        [
            *triage_steps(skip_prior=False),
            (
                "o_old",
                f"""select 'old-' || keyword as keyword, {NORMAL.format(u='original_url')} as normalized_url from fx_sites
                where page_id % 3 = 0""",
            ),
            ("o_new", "select * from o_scored where normalized_url not like '%/1%'"),
        ],
        """select normalized_url, keyword, score, suspicious, array_to_string(reasons, ' | ') as reasons,
        '2025-01-01 00:00:00' as last_checked from o_new
        union all select normalized_url, keyword, 0, false, 'earlier', '2024-12-31 00:00:00' from o_old
        where normalized_url not in (select normalized_url from o_new)""",
    ),
)
def results_upsert(spark, sf):
    """New results over earlier ones; a row without a keyword is not stored."""
    fresh = triage_input(spark, sf, skip_prior=False)
    blank = F.when(~F.contains("normalized_url", F.lit("/1")), F.col("keyword"))
    merged = K.upsert_results(_prior_results(spark, sf), fresh.withColumn("keyword", blank), fx.AS_OF)
    # Through the JSON form in which lists are stored as text.
    packed = merged.withColumn("reasons", X.list_to_json(F.col("reasons")))
    return _ints(
        packed.select(
            "normalized_url", "keyword", "score", "suspicious",
            F.array_join(X.list_from_json(F.col("reasons")), " | ").alias("reasons"),
            F.date_format("last_checked", "yyyy-MM-dd HH:mm:ss").alias("last_checked"),
        ),
        "score",
    )


@query(
    "suspicious_report",
    with_tables(
        ["fx_hits", "fx_facts"],
        triage_steps(),
        """select normalized_url, keyword, base_domain as domain, score, to_json(reasons)::varchar as reasons
        from o_scored where suspicious and score >= 50""",
    ),
)
def suspicious_report(spark, sf):
    """The CSV checkpoint, read back."""
    path = shared_folder(spark, "suspicious")
    table = shared_folder(spark, "results")
    write_results(K.storable(triage_input(spark, sf), fx.AS_OF), table)
    stored = read_results(spark, table)
    columns = ["normalized_url", "keyword", "domain", "score", "reasons"]
    if not export_suspicious_csv(stored, path):
        return _no_rows(stored.select(*columns))
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(*columns).withColumn("score", F.col("score").cast("bigint"))


def _no_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.col("score").cast("bigint")).filter(F.lit(False))


@query("results_roundtrip", with_tables(["fx_hits", "fx_facts"], triage_steps(), """select normalized_url, keyword, score,
  suspicious, filtered, array_to_string(reasons, ' | ') as reasons, registrar from o_scored"""))
def results_roundtrip(spark, sf):
    """Results table written and read back, and its full CSV export."""
    path, csv_path = shared_folder(spark, "results"), shared_folder(spark, "results-csv")
    write_results(K.storable(triage_input(spark, sf), fx.AS_OF), path)
    stored = read_results(spark, path)
    export_csv(stored, csv_path)
    text = spark.read.option("header", True).option("escape", '"').csv(csv_path)
    flags = text.select("normalized_url", F.col("filtered").cast("boolean"), F.col("registrar"))
    joined = stored.drop("filtered", "registrar").join(flags, "normalized_url")
    return _ints(
        joined.select(
            "normalized_url", "keyword", "score", "suspicious", "filtered",
            F.array_join("reasons", " | ").alias("reasons"), "registrar",
        ),
        "score",
    )


INCREMENTAL_SQL = with_tables(
    ["fx_hits", "fx_facts"],
    triage_steps(skip_prior=False),
    """select normalized_url, keyword, base_domain as domain, suspicious, array_to_string(reasons, ' | ') as reasons,
    score, filtered from o_scored""",
)


@query("stream_two_feeds", INCREMENTAL_SQL)
def stream_two_feeds(spark, sf):
    """Two feeds with a checkpoint of their own into one results table.

    The second one also brings the hits of the first, which are not triaged again.
    """
    first, both, out = (shared_folder(spark, n) for n in ("feed-1", "feed-2", "triaged"))
    hits = fx.derive(spark, sf, "fx_hits").select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in SERP_ITEMS.fields]
    )
    hits.filter(F.col("keyword") == fx.KEYWORDS[0][0]).write.parquet(first)
    hits.write.parquet(both)
    for incoming in (first, both):
        _feed(spark, sf, incoming, out, shared_folder(spark, "progress"))
    return _streamed(spark, out)


@query(
    "verdict_upsert",
    with_tables(
        ["fx_hits", "fx_facts"],
        [
            *triage_steps(skip_prior=False),
            (
                "o_verdict",
                """select base_domain, score, filtered from (select *, row_number() over (partition by base_domain
                order by case keyword when 'acme' then 0 else 1 end desc, rank desc, url desc) as rn
                from o_scored where base_domain <> '') v where rn = 1""",
            ),
        ],
        """select coalesce(f.base_domain, v.base_domain) as base_domain, f.registrar, f.mx_count, v.score, v.filtered
        from fx_facts f full join o_verdict v on f.base_domain = v.base_domain""",
    ),
)
def verdict_upsert(spark, sf):
    """The facts table after a run: verdicts added, looked-up facts kept."""
    facts = fx.facts(spark, sf)
    scored = score_sites(
        fx.derive(spark, sf, "fx_hits"), facts, fx.AS_OF, keywords=fx.keywords(spark), suffixes=fx.suffixes(spark)
    )
    updated = update_domain_facts(facts, scored, fx.AS_OF)
    return _ints(updated.select("base_domain", "registrar", "mx_count", "score", "filtered"), "mx_count", "score")


@query("incremental_triage", INCREMENTAL_SQL)
def incremental_triage(spark, sf):
    """Batches of arriving files, one keyword each; equals the batch result."""
    incoming, out, state = (shared_folder(spark, n) for n in ("incoming", "triaged", "progress"))
    hits = fx.derive(spark, sf, "fx_hits").select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in SERP_ITEMS.fields]
    )
    for word, seq in fx.KEYWORDS:
        hits.filter(F.col("keyword") == word).write.parquet(f"{incoming}/{seq}")
    _feed(spark, sf, f"{incoming}/*", out, state)
    return _streamed(spark, out)


def _feed(spark, sf, incoming: str, out: str, state: str) -> None:
    stream = triage_stream(
        spark,
        incoming,
        out,
        state,
        fx.facts(spark, sf),
        fx.AS_OF,
        keywords=fx.keywords(spark),
        suffixes=fx.suffixes(spark),
    )
    stream.awaitTermination()


def _streamed(spark, out: str) -> DataFrame:
    return _ints(
        results_so_far(spark, out).select(
            "normalized_url", "keyword", "domain", "suspicious",
            F.array_join("reasons", " | ").alias("reasons"), "score", "filtered",
        ),
        "score",
    )
