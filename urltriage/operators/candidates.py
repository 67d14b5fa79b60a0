"""Candidate pages for a brand: query texts, result links, filters and caps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urltriage import config
from urltriage.functions import html as H
from urltriage.functions.text import contains_any, sql_text
from urltriage.functions.urls import url_host
from urltriage.operators.keyed import first_per_key

MAX_RESULTS = 1000
PER_QUERY = 100


def per_query_limit(max_results: int) -> int:
    return max(PER_QUERY, max_results // 5)


def expand_queries(
    brands: DataFrame, templates: Sequence[str] = config.QUERY_TEMPLATES
) -> DataFrame:
    """One search text per brand and distinct template, in template order."""
    distinct = list(dict.fromkeys(templates))
    array = F.array(*[F.lit(t) for t in distinct])
    return brands.select("brand", F.posexplode(array).alias("query_seq", "template")).select(
        "brand", "query_seq", F.replace("template", F.lit("{brand}"), F.col("brand")).alias("query")
    )


def _percent_decoded(c: Column) -> Column:
    """Percent escapes only: a plus sign stays one."""
    kept = F.replace(c, F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(kept), c)


def result_links(html: str) -> Column:
    """Targets of the result anchors of one search page, in page order."""
    marked = sql_text(r"(^|\s)result__a(\s|$)")
    anchors = f"filter({H.tag_attributes(html, 'a')}, la -> {H.attribute('la', 'class')} RLIKE {marked})"
    hrefs = F.expr(f"array_compact(transform({anchors}, la -> {H.attribute('la', 'href')}))")

    def target(href: Column) -> Column:
        redirected = F.regexp_extract(href, r"uddg=(http[^&]+)", 1)
        return F.when(redirected != "", _percent_decoded(redirected)).otherwise(href)

    return F.transform(hrefs, target)


def extract_result_links(serp_pages: DataFrame, per_query: int | None = PER_QUERY) -> DataFrame:
    """Add ``links``: at most the first ``per_query`` targets of each page (None: all)."""
    links = result_links("coalesce(html, '')")
    if per_query is not None:
        links = F.slice(links, 1, per_query)
    return serp_pages.withColumn("links", links).drop("html")


def _links_before(counts: DataFrame) -> DataFrame:
    """``_before``: links of earlier queries of the brand, from one small row per query."""
    earlier = (
        Window.partitionBy("brand")
        .orderBy("query_seq")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def cap_by_query(linked: DataFrame, max_results: int | None = MAX_RESULTS) -> DataFrame:
    """Queries of each brand up to the one that reaches ``max_results`` links (None: all).

    The running total is taken over one small row per query, not over links.
    """
    if max_results is None:
        return linked
    counts = linked.groupBy("brand", "query_seq").agg(F.sum(F.size("links")).alias("_n"))
    wanted = _links_before(counts).filter(F.col("_before") < max_results).select("brand", "query_seq")
    return linked.join(wanted, ["brand", "query_seq"], "left_semi")


def explode_links(linked: DataFrame) -> DataFrame:
    return linked.select("brand", "query_seq", F.posexplode("links").alias("pos", "url"))


def filter_candidates(links: DataFrame, allow_news: bool = False) -> DataFrame:
    """Usable links, each (brand, url) once at its first position."""
    url = F.trim("url")
    host = url_host(url)
    usable = (url != "") & (host != "")
    if not allow_news:
        usable = usable & ~contains_any(host, config.NEWS_AND_SOCIAL_HOSTS)
    for engine in config.SEARCH_ENGINE_HOSTS:
        usable = usable & ~F.endswith(host, F.lit(engine))
    kept = links.filter(usable).withColumn("url", url)
    return first_per_key(kept, ["brand", "url"], ["query_seq", "pos"])


def first_candidates(candidates: DataFrame, max_results: int | None = MAX_RESULTS) -> DataFrame:
    """First ``max_results`` candidates per brand, in search order (None: all).

    A position is the number of candidates of earlier queries plus the rank within
    the query, so no task ever holds all candidates of a brand.
    """
    counts = candidates.groupBy("brand", "query_seq").agg(F.count(F.lit(1)).alias("_n"))
    before = _links_before(counts).drop("_n")
    if max_results is not None:
        before = before.filter(F.col("_before") < max_results)
    order = Window.partitionBy("brand", "query_seq").orderBy("pos", "url")
    placed = candidates.join(before, ["brand", "query_seq"]).withColumn(
        "position", (F.row_number().over(order) + F.col("_before")).cast("int")
    )
    if max_results is not None:
        placed = placed.filter(F.col("position") <= max_results)
    return placed.select("brand", "url", "position")


def search_candidates(
    serp_pages: DataFrame,
    max_results: int | None = MAX_RESULTS,
    per_query: int | None = PER_QUERY,
    allow_news: bool = False,
) -> DataFrame:
    linked = cap_by_query(extract_result_links(serp_pages, per_query), max_results)
    return first_candidates(filter_candidates(explode_links(linked), allow_news), max_results)
