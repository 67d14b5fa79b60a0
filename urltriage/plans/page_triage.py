"""Page triage end to end: page snapshots and facts to ranked analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urltriage import config
from urltriage.functions.text import as_timestamp, text_array
from urltriage.operators.facts import tls_status
from urltriage.operators.page_features import logo_similarity, page_features, with_fetch_status
from urltriage.operators.page_risk import score_page
from urltriage.session import shared_folder

MIN_SCORE = 0.3
#: Candidate URLs that are sent to all executors at most.
BROADCAST_URLS = 200_000


def analyze_pages(
    pages: DataFrame,
    whois: DataFrame,
    tls_facts: DataFrame,
    as_of,
    suffixes: DataFrame | None = None,
    options: config.PageRiskOptions | None = None,
    images: DataFrame | None = None,
    known_logo: bytes | None = None,
    brands: DataFrame | None = None,
) -> DataFrame:
    """Features, score, category and reasons of every (brand, url) page.

    The page table is read once.  Its HTML becomes compact columns before any
    join; facts are then joined on base_domain and host.  A page that was not
    fetched gets score 0, one reason and no category; a row that cannot be
    analyzed at all (no url or brand) becomes category ``error``.  With ``brands``
    (brand, url) pages come without a brand and are analyzed for those of their URL.
    With logo images, the compact columns are written to the shared folder when this
    is called, because both the score and the comparison read them.
    """
    absent = F.col("url").isNull() | (F.lit(False) if brands is not None else F.col("brand").isNull())
    fetched = with_fetch_status(pages).withColumn("invalid", absent)
    usable = F.col("ok") & ~F.col("invalid")
    # Unusable rows carry no HTML into the parsing stage.
    features = page_features(fetched.withColumn("html", F.when(usable, F.col("html"))), suffixes, brands)
    if images is not None and known_logo is not None:
        folder = shared_folder(features.sparkSession, "page-features")
        features.write.parquet(folder)
        features = features.sparkSession.read.schema(features.schema).parquet(folder)
    aged = features.join(
        whois.select("base_domain", "domain_age_days", "whois_suspicious"), "base_domain", "left"
    )
    known = tls_status(aged, tls_facts, as_of)
    if images is not None and known_logo is not None:
        best = logo_similarity(
            features.filter(usable).select("url", "brand", "final_url", "images"),
            images,
            known_logo,
            ["url", "brand"],
        )
        known = known.join(best, ["url", "brand"], "left")
    else:
        known = known.withColumn("logo_similarity", F.lit(0.0))
    scored = score_page(known, options)

    no_text = text_array([])
    lists = {
        "text_snippets": F.when(usable, F.col("text_snippets")).otherwise(no_text),
        "forms_details": F.when(usable, F.col("forms")).otherwise(F.array()),
        "logo_matches": F.when(usable, F.col("logo_matches")).otherwise(F.array()),
    }
    failure = F.concat_ws(": ", F.lit("No se pudo recuperar HTML"), F.col("error"))
    return (
        scored.withColumn("content_analysis", F.struct(*[v.alias(k) for k, v in lists.items()]))
        .withColumns(
            {
                "score": F.when(usable, F.col("score")).otherwise(F.lit(0.0)),
                "reasons": F.when(
                    F.col("invalid"), F.array(F.lit("Error en análisis: url o marca ausente"))
                )
                .when(~F.col("ok"), F.array(failure))
                .otherwise(F.col("reasons")),
                "category": F.when(F.col("invalid"), F.lit("error")).when(
                    F.col("ok"), F.col("category")
                ),
                "analyzed_at": as_timestamp(as_of),
            }
        )
        .drop("invalid", "forms", "images", "text_snippets", "logo_matches")
    )


def rank_pages(scored: DataFrame, min_score_filter: float = MIN_SCORE) -> DataFrame:
    """Pages of at least the given score, highest first; error rows stay.

    A global sort samples its input before it sorts.  The repartition in front
    lets both passes read the small scored rows from the shuffle; without it
    every page would be parsed twice.
    """
    kept = (F.col("score") >= min_score_filter) | F.coalesce(F.col("category") == "error", F.lit(False))
    return scored.filter(kept).repartition("url").orderBy(F.desc("score"), "url", "brand")


def triage_pages(
    pages: DataFrame,
    whois: DataFrame,
    tls_facts: DataFrame,
    as_of,
    candidates: DataFrame | None = None,
    min_score_filter: float = MIN_SCORE,
    **options,
) -> DataFrame:
    """Ranked analyses, optionally only of the given candidate (brand, url) pairs.

    Candidates are joined to parsed pages. If their URLs are few, pages of other URLs
    are dropped before by a broadcast; the page source is never shuffled.
    """
    brands = None
    if candidates is not None:
        brands = candidates.select("brand", "url").filter("brand is not null and url is not null").distinct()
        pages = pages.drop("brand")
        urls = brands.select("url").distinct()
        if urls.limit(BROADCAST_URLS + 1).count() <= BROADCAST_URLS:
            pages = pages.join(F.broadcast(urls), "url", "left_semi")
    analyzed = analyze_pages(pages, whois, tls_facts, as_of, brands=brands, **options)
    return rank_pages(analyzed, min_score_filter)


def top_report(pages: DataFrame, n: int = 30) -> DataFrame:
    """Summary of the n highest-scored pages."""
    return (
        pages.orderBy(F.desc("score"), "url", "brand")
        .limit(n)
        .select(
            "url", "final_url", "score", "category", "reasons", "base_domain", "ssl_valid",
            "domain_age_days", "content_analysis",
        )
    )


def whois_ages(extracted: DataFrame) -> DataFrame:
    """WHOIS extract keyed as the page side needs it."""
    return extracted.select(
        F.lower("domain").alias("base_domain"),
        F.col("age_days").alias("domain_age_days"),
        "whois_suspicious",
    )
