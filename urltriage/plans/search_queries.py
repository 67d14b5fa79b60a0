"""Candidate search and report queries with their comparison SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from urltriage import config as C
from urltriage import schemas
from urltriage.functions.text import as_timestamp
from urltriage.operators import candidates as S
from urltriage.plans import fixtures as fx
from urltriage.plans import page_triage as T
from urltriage.plans.domain_queries import _ints
from urltriage.plans.page_queries import _CATEGORY, _PAGE_TABLES, _analyzed, _whois, page_score_steps
from urltriage.plans.registry import query, sql_list, with_tables
from urltriage.session import shared_folder
from urltriage.sources.writers import (
    analysis_rows,
    append_analysis,
    export_json,
    merge_history,
    read_history,
    upgrade_history,
)

PER_QUERY = 3
MAX_RESULTS = 40

_LINKS = [
    (
        "o_anchor",
        """select brand, query_seq, i, regexp_extract_all(html, '<a [^>]*class="result__a"[^>]*>')[i] as tag
        from (select *, unnest(range(1, 1 + len(regexp_extract_all(html, '<a [^>]*class="result__a"[^>]*>')))) as i
          from fx_serp_pages) q""",
    ),
    (
        "o_href",
        """select brand, query_seq, count(*) over (partition by brand, query_seq order by i rows unbounded preceding) - 1 as pos,
        regexp_extract(tag, 'href="([^"]*)"', 1) as href from o_anchor where contains(tag, 'href=')""",
    ),
    (
        "o_link",
        f"""select brand, query_seq, pos, case when contains(href, 'uddg=')
          then url_decode(regexp_extract(href, 'uddg=(http[^&]+)', 1)) else href end as url
        from o_href where pos < {PER_QUERY}""",
    ),
    (
        "o_capped",
        f"""select l.* from o_link l join (select brand, query_seq, coalesce(sum(n) over (partition by brand
          order by query_seq rows between unbounded preceding and 1 preceding), 0) as before
          from (select brand, query_seq, count(*) as n from o_link group by 1, 2) c) b
        on l.brand = b.brand and l.query_seq = b.query_seq where b.before < {MAX_RESULTS}""",
    ),
]
_ALL_LINKS = [*_LINKS[:2], ("o_link", _LINKS[2][1].replace(f" where pos < {PER_QUERY}", ""))]
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)"
_NEWS = " or ".join(f"contains(host, '{h}')" for h in C.NEWS_AND_SOCIAL_HOSTS)


def _kept(source: str, name: str) -> tuple[str, str]:
    return (
        name,
        f"""select * exclude (rn) from (select *, row_number() over (partition by brand, url order by query_seq, pos) as rn
        from (select *, {_HOST} as host from {source}) h where host <> '' and not ({_NEWS})
          and not ends_with(host, 'duckduckgo.com') and not ends_with(host, 'bing.com')) r where rn = 1""",
    )


def _serp(spark, sf):
    return fx.derive(spark, sf, "fx_serp_pages")


@query(
    "query_expansion",
    with_tables(
        ["fx_sites"],
        [
            (
                "o_t",
                f"""select t, row_number() over (order by min(i)) - 1 as query_seq from
                (select unnest({sql_list(C.QUERY_TEMPLATES)}) as t, unnest(range(1, {len(C.QUERY_TEMPLATES) + 1})) as i) u group by t""",
            )
        ],
        "select brand, query_seq, replace(t, '{brand}', brand) as query from (select distinct base_domain_expected as brand from fx_sites) b, o_t",
    ),
)
def query_expansion(spark, sf):
    brands = fx.derive(spark, sf, "fx_sites").select(F.col("base_domain_expected").alias("brand")).distinct()
    return _ints(S.expand_queries(brands), "query_seq")


@query(
    "serp_links",
    with_tables(["fx_serp_pages"], _LINKS, "select brand, query_seq, pos, url from o_link"),
)
def serp_links(spark, sf):
    return _ints(S.explode_links(S.extract_result_links(_serp(spark, sf), PER_QUERY)), "query_seq", "pos")


@query(
    "candidate_cap",
    with_tables(["fx_serp_pages"], _LINKS, "select brand, query_seq, pos, url from o_capped"),
)
def candidate_cap(spark, sf):
    linked = S.cap_by_query(S.extract_result_links(_serp(spark, sf), PER_QUERY), MAX_RESULTS)
    return _ints(S.explode_links(linked), "query_seq", "pos")


@query(
    "candidate_filter",
    with_tables(
        ["fx_serp_pages"],
        [*_LINKS, _kept("o_capped", "o_kept")],
        f"""select brand, url, position from (select brand, url, row_number() over (partition by brand
        order by query_seq, pos, url) as position from o_kept) p where position <= {MAX_RESULTS}""",
    ),
)
def candidate_filter(spark, sf):
    return _ints(S.search_candidates(_serp(spark, sf), MAX_RESULTS, PER_QUERY), "position")


@query(
    "brand_page_triage",
    with_tables(
        ["fx_serp_pages", *_PAGE_TABLES],
        [
            *_ALL_LINKS,
            _kept("o_link", "o_kept"),
            ("o_cand", "select brand, url from o_kept"),
            *page_score_steps(),
        ],
        f"""select p.page_id, p.url, p.brand, p.score, {_CATEGORY.replace('score', 'p.score')} as category
        from o_pscored p join o_cand c on p.url = c.url and p.brand = c.brand where p.score >= 0.3""",
    ),
)
def brand_page_triage(spark, sf):
    """Search pages to all candidates to analyzed pages, per brand."""
    found = S.search_candidates(_serp(spark, sf), max_results=None, per_query=None)
    ranked = T.triage_pages(
        fx.derive(spark, sf, "fx_fetch"),
        _whois(spark, sf),
        fx.tls(spark, sf),
        fx.AS_OF,
        candidates=found,
        suffixes=fx.suffixes(spark),
    )
    return ranked.select("page_id", "url", "brand", "score", "category")


@query(
    "history_upgrade",
    with_tables(
        ["fx_history_v1"],
        [
            (
                "o_h1",
                """select url, base_domain, cast(score as double) as score, category,
                strftime(timestamp '2024-12-31 00:00:00' + to_hours(hours), '%Y-%m-%d %H:%M:%S') as analyzed_at,
                cast(null as varchar) as content_analysis, page_id from fx_history_v1""",
            )
        ],
        """select url, base_domain, score, category, analyzed_at, content_analysis from o_h1 where page_id % 2 = 0
        union all select url, base_domain, 0.99, 'phishing', analyzed_at, '{}' from o_h1 where page_id % 2 = 1
        union all select url, base_domain, 0.5, 'suspect', '2025-01-01 00:00:00', '{}' from o_h1 where page_id % 10 = 0""",
    ),
)
def history_upgrade(spark, sf):
    """Older layout upgraded, rows of equal key replaced, a later run appended."""
    start = as_timestamp("2024-12-31 00:00:00")
    v1 = fx.derive(spark, sf, "fx_history_v1").select(
        "url", "base_domain", F.col("score").cast("double").alias("score"), "category",
        F.array(F.lit("r")).alias("reasons"),
        (start + F.make_dt_interval(hours=F.col("hours").cast("int"))).alias("analyzed_at"),
        F.col("analysis_time_s").cast("double").alias("analysis_time_s"), "page_id",
    )
    odd = v1.filter(F.col("page_id") % 2 == 1).withColumns(
        {"score": F.lit(0.99), "category": F.lit("phishing"), "content_analysis": F.lit("{}")}
    )
    later = v1.filter(F.col("page_id") % 10 == 0).withColumns(
        {
            "score": F.lit(0.5),
            "category": F.lit("suspect"),
            "analyzed_at": as_timestamp(fx.AS_OF),
            "content_analysis": F.lit("{}"),
        }
    )
    path = shared_folder(spark, "history")
    merged = merge_history(upgrade_history(v1.drop("page_id")), odd.drop("page_id"))
    append_analysis(merged, path, "1")
    append_analysis(upgrade_history(later.drop("page_id")), path, "2")
    return read_history(spark, path).select(
        "url", "base_domain", "score", "category",
        F.date_format("analyzed_at", "yyyy-MM-dd HH:mm:ss").alias("analyzed_at"), "content_analysis",
    )


@query(
    "json_report_roundtrip",
    with_tables(
        _PAGE_TABLES,
        page_score_steps(),
        f"""select url, score, {_CATEGORY} as category, reasons, coalesce(forms_n, 0) as forms from o_pscored
        where score >= 0.3 and page_id % 100 >= 2""",
    ),
)
def json_report_roundtrip(spark, sf):
    """Ranked analyses as JSON Lines, read back."""
    path = shared_folder(spark, "report-json")
    ranked = T.rank_pages(_analyzed(spark, sf)).filter(F.col("category") != "error")
    export_json(ranked.select("url", "score", "category", "reasons", "content_analysis"), path)
    layout = f"url string, score double, category string, reasons array<string>, content_analysis {schemas.CONTENT_ANALYSIS}"
    back = spark.read.schema(layout).json(path)
    return _ints(
        back.select(
            "url", "score", "category", F.array_join("reasons", " | ").alias("reasons"),
            F.size("content_analysis.forms_details").alias("forms"),
        ),
        "forms",
    )


@query(
    "analysis_history",
    with_tables(
        _PAGE_TABLES,
        page_score_steps(),
        f"""select url, base_domain, score, {_CATEGORY} as category, '2025-01-01 00:00:00' as analyzed_at
        from o_pscored where page_id % 100 >= 2""",
    ),
)
def analysis_history(spark, sf):
    """Analyses stored as history rows; a repeated run does not double them."""
    path = shared_folder(spark, "analyses")
    done = _analyzed(spark, sf).filter(F.col("category") != "error")
    rows = analysis_rows(done, 0.0)
    append_analysis(rows, path, "first")
    append_analysis(rows, path, "first")
    return read_history(spark, path).select(
        "url", "base_domain", "score", "category",
        F.date_format("analyzed_at", "yyyy-MM-dd HH:mm:ss").alias("analyzed_at"),
    )


@query(
    "history_two_brands",
    with_tables(
        ["fx_history_v1"],
        [],
        """select url, brand, cast(score as double) + extra as score from fx_history_v1,
        (values ('acme', 0.0), ('paypal', 1.0)) b(brand, extra)""",
    ),
)
def history_two_brands(spark, sf):
    """Two runs at one instant, one for each brand; none replaces the other."""
    path = shared_folder(spark, "two-brands")
    v1 = fx.derive(spark, sf, "fx_history_v1")
    for brand, extra in (("acme", 0.0), ("paypal", 1.0)):
        rows = v1.select(
            "url", F.lit(brand).alias("brand"), "base_domain", (F.col("score") + extra).cast("double").alias("score"),
            "category", as_timestamp(fx.AS_OF).alias("analyzed_at"),
        )
        append_analysis(upgrade_history(rows), path, brand)
    return read_history(spark, path).select("url", "brand", "score")
