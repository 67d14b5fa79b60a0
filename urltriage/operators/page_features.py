"""Page features: HTML to columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urltriage import config as C
from urltriage.functions import html as H
from urltriage.functions import keywords as W
from urltriage.functions.similarity import hex_similarity, typosquat_score
from urltriage.functions.text import contains_any, sql_text
from urltriage.functions.urls import (
    is_https_scheme,
    reference_host,
    resolve_url,
    url_host,
    url_netloc,
    url_path,
)
from urltriage.operators.suffix import with_registrable_domain

ALL_KEYWORDS = tuple(k for family in C.KEYWORD_FAMILIES.values() for k in family)
SNIPPET_KEYWORDS = tuple(k for f in C.SNIPPET_FAMILIES for k in C.KEYWORD_FAMILIES[f])
LOGO_LIMIT = 5


def keyword_features(df: DataFrame, text_col: str) -> DataFrame:
    """Add <family>_keywords_count and _hits for the five families."""
    found = df.withColumn("_occ", W.occurrences(F.col(text_col), ALL_KEYWORDS))
    columns = {}
    for family, words in C.KEYWORD_FAMILIES.items():
        columns[f"{family}_keywords_count"] = W.count_in(F.col("_occ"), words)
        columns[f"{family}_keywords_hits"] = W.distinct_in(F.col("_occ"), words)
    return found.withColumns(columns)


def text_snippets(text: Column, occ: Column) -> Column:
    return W.snippets(text, occ, SNIPPET_KEYWORDS)


def parsed_forms(dom: str) -> Column:
    """Forms with action, method and inputs (no judgement yet)."""
    field = {n: H.attribute("ia", n) for n in ("type", "name", "id")}
    inputs = (
        f"transform({H.tag_attributes('fm', 'input')}, ia -> named_struct("
        f"'type', lower(coalesce(nullif({field['type']}, ''), 'text')), "
        f"'name', lower(coalesce(nullif({field['name']}, ''), nullif({field['id']}, ''), ''))))"
    )
    form = (
        f"transform({H.forms(dom)}, fm -> get(transform(array({H.form_attributes('fm')}), fa -> named_struct("
        f"'action', coalesce({H.attribute('fa', 'action')}, ''), "
        f"'method', lower(coalesce(nullif({H.attribute('fa', 'method')}, ''), 'get')), "
        f"'inputs', {inputs})), 0))"
    )
    return F.expr(form)


def judged_forms(forms: Column, base_domain: Column) -> Column:
    """Form details as reported, given the page's registrable domain."""

    def judge(f: Column) -> Column:
        inputs = f["inputs"]
        return F.struct(
            f["action"].alias("action"),
            reference_host(f["action"], base_domain).alias("action_domain"),
            f["method"].alias("method"),
            F.exists(inputs, lambda i: i["type"] == "password").alias("has_password"),
            F.exists(
                inputs, lambda i: (i["type"] == "email") | F.contains(i["name"], F.lit("email"))
            ).alias("has_email"),
            F.exists(inputs, lambda i: contains_any(i["name"], C.SUSPICIOUS_INPUT_WORDS)).alias(
                "suspicious_inputs"
            ),
            inputs.alias("inputs"),
            F.size(inputs).alias("inputs_count"),
        )

    return F.transform(forms, judge)


def form_aggregates(df: DataFrame, forms_col: str = "forms") -> DataFrame:
    """Counts and ratios over the judged forms."""
    forms = F.col(forms_col)
    n = F.size(forms)
    external = F.size(
        F.filter(
            forms, lambda f: (f["action_domain"] != "") & (f["action_domain"] != F.col("base_domain"))
        )
    )
    return df.withColumns(
        {
            "forms_count": n,
            "forms_external_action_ratio": external / F.greatest(n, F.lit(1)),
            "suspicious_forms_count": F.size(F.filter(forms, lambda f: f["suspicious_inputs"])),
            "password_inputs_count": F.size(F.filter(forms, lambda f: f["has_password"])),
            "email_inputs_count": F.size(F.filter(forms, lambda f: f["has_email"])),
        }
    )


def link_hosts(dom: str) -> Column:
    """Host of each a[href]; blank for relative links and other schemes."""
    hrefs = f"array_compact(transform({H.tag_attributes(dom, 'a')}, la -> {H.attribute('la', 'href')}))"
    return F.transform(F.expr(hrefs), lambda h: reference_host(h))


def external_ratio(hosts: Column, base_domain: Column) -> Column:
    external = F.size(F.filter(hosts, lambda h: (h != "") & ~F.contains(h, base_domain)))
    return F.when((base_domain == "") | (F.size(hosts) == 0), F.lit(0.0)).otherwise(
        external / F.size(hosts)
    )


def meta_map(dom: str) -> Column:
    """Meta name -> content; of repeated names the last wins."""
    pairs = (
        f"filter(transform({H.tag_attributes(dom, 'meta')}, ma -> named_struct("
        f"'k', lower({H.attribute('ma', 'name')}), 'v', {H.attribute('ma', 'content')})), "
        "mp -> mp.k IS NOT NULL AND mp.v IS NOT NULL)"
    )
    last = (
        f"flatten(transform(array({pairs}), ms -> filter(ms, (mp, mi) -> "
        "NOT exists(slice(ms, mi + 2, size(ms)), later -> later.k = mp.k))))"
    )
    return F.expr(f"map_from_entries({last})")


def image_array(dom: str) -> Column:
    fields = ", ".join(f"'{n}', {H.attribute('ga', n)}" for n in ("src", "alt", "title"))
    return F.expr(f"transform({H.tag_attributes(dom, 'img')}, ga -> named_struct({fields}))")


def _names_logo(image: Column, brand: Column) -> Column:
    parts = [F.nullif(image[n], F.lit("")) for n in ("alt", "title", "src")]
    text = F.lower(F.concat_ws(" ", *parts))
    return F.contains(text, F.lower(brand)) | F.contains(text, F.lit("logo"))


def logo_candidates(images: Column, brand: Column) -> Column:
    return F.slice(F.filter(images, lambda i: _names_logo(i, brand)), 1, LOGO_LIMIT)


def compared_images(images: Column, brand: Column) -> Column:
    """Images up to and including the fifth that names the brand or a logo."""
    marks = F.transform(images, lambda i: _names_logo(i, brand))
    positions = F.filter(
        F.transform(marks, lambda m, i: F.when(m, i + 1)), lambda p: p.isNotNull()
    )
    fifth = F.get(positions, LOGO_LIMIT - 1)
    return F.slice(images, F.lit(1), F.coalesce(fifth, F.size(images)))


def informational(text: Column, title: Column, meta: Column) -> Column:
    in_text = contains_any(F.substring(text, 1, 300), C.INFORMATIONAL_PATTERNS)
    in_title = contains_any(title, C.INFORMATIONAL_PATTERNS)
    in_meta = F.exists(
        F.map_values(meta), lambda v: contains_any(F.lower(v), C.INFORMATIONAL_PATTERNS)
    )
    return in_text | in_title | in_meta


def parse_pages(pages: DataFrame) -> DataFrame:
    """HTML to compact columns in one narrow stage; drops the HTML.

    Later joins then move only these columns, never the page source.
    """
    dom = pages.withColumn("_dom", H.strip_hidden(F.coalesce("html", F.lit(""))))
    parsed = dom.withColumns(
        {
            "text": H.visible_text("_dom"),
            "title": H.title_text("_dom"),
            "images_count": F.expr(H.tag_count("_dom", "img")),
            "buttons_count": F.expr(H.tag_count("_dom", "button")),
            "images": image_array("_dom"),
            "_forms": parsed_forms("_dom"),
            "_links": link_hosts("_dom"),
            "meta": meta_map("_dom"),
        }
    ).drop("_dom", "html")
    counted = keyword_features(parsed, "text")
    return counted.withColumns(
        {
            "text_len": F.length("text"),
            "text_snippets": text_snippets(F.col("text"), F.col("_occ")),
            "informational_context": informational(F.col("text"), F.col("title"), F.col("meta")),
        }
    ).drop("_occ", "text")


def brand_flags(df: DataFrame, brand_col: str = "brand", url_col: str = "url") -> DataFrame:
    """Brand in domain, as the domain itself, in path or subdomain; whitelists."""
    brand = F.lower(F.col(brand_col))
    listed = F.concat_ws(" ", brand, F.lower("base_domain")).isin(
        *[f"{name} {domain}" for name, domain in C.BRAND_WHITELIST]
    )
    return df.withColumns(
        {
            "brand_in_domain": F.contains("base_domain", brand) | F.contains("host", brand),
            "exact_brand_domain": F.lower("domain_core") == brand,
            "brand_in_path": F.contains(F.lower(url_path(F.col(url_col))), brand)
            | F.contains("subdomain", brand),
            "brand_whitelisted": listed,
            "whitelisted_platform": contains_any(F.lower(url_netloc(F.col(url_col))), C.PLATFORM_DOMAINS),
        }
    )


def with_fetch_status(pages: DataFrame) -> DataFrame:
    """ok only for status 200 with nonblank text; otherwise an error text."""
    ok = F.coalesce((F.col("status") == 200) & (F.length(F.trim("html")) > 0), F.lit(False))
    stated = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    fallback = F.concat(F.lit("HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("None")))
    return pages.withColumn("ok", ok).withColumn("error", F.when(~ok, F.coalesce(stated, fallback)))


def page_features(
    pages: DataFrame, suffixes: DataFrame | None = None, brands: DataFrame | None = None
) -> DataFrame:
    """All features of (url, brand, html) rows except joined facts.

    With ``brands`` (brand, url), pages have no brand of their own: each is parsed
    once, and only the compact columns are joined to the brands of its URL.
    """
    parsed = parse_pages(pages).withColumns(
        {"host": url_host(F.col("url")), "is_https": is_https_scheme(F.col("url"))}
    )
    placed = with_registrable_domain(parsed, "host", suffixes)
    if brands is not None:
        placed = placed.join(brands, "url")
    flagged = brand_flags(placed)
    judged = flagged.withColumns(
        {
            "forms": judged_forms(F.col("_forms"), F.col("base_domain")),
            "external_links_ratio": external_ratio(F.col("_links"), F.col("base_domain")),
            "typo_score": F.expr(typosquat_score("brand", "domain_core")),
            "logo_matches": logo_candidates(F.col("images"), F.col("brand")),
        }
    ).drop("_forms", "_links")
    return form_aggregates(judged).withColumn(
        "suspicious_payment", (F.col("suspicious_forms_count") > 0) & ~F.col("whitelisted_platform")
    )


def logo_similarity(
    page_images: DataFrame, images: DataFrame, known_logo: bytes, key_cols: list[str]
) -> DataFrame:
    """Best similarity to the known logo among each page's compared images.

    ``page_images`` has the key columns, brand, final_url and images.  Image
    content is hashed where it lies, so only (src, similarity) is shuffled.
    """
    known = hashlib.md5(known_logo).hexdigest()
    hashed = images.selectExpr("src AS _src", "md5(content) AS _digest", "length(content) > 0 AS _filled").selectExpr(
        "_src", f"CASE WHEN _filled THEN {hex_similarity('_digest', sql_text(known))} ELSE 0D END AS _sim"
    )
    shown = page_images.select(
        *key_cols,
        "final_url",
        F.explode(
            F.array_distinct(
                F.transform(compared_images(F.col("images"), F.col("brand")), lambda i: i["src"])
            )
        ).alias("_ref"),
    ).filter(F.coalesce("_ref", F.lit("")) != "")
    absolute = shown.withColumn("_src", resolve_url(F.col("final_url"), F.col("_ref")))
    return (
        absolute.select(*key_cols, "_src")
        .join(hashed, "_src")
        .groupBy(*key_cols)
        .agg(F.max("_sim").alias("logo_similarity"))
    )
