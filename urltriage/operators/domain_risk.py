"""Domain risk: additive 0..100 score with ordered reasons."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urltriage import config as C
from urltriage.functions.similarity import (
    jaro_winkler,
    levenshtein_similarity,
    may_reach_jaro_winkler,
)
from urltriage.functions.text import (
    BRAND_SEPARATORS,
    as_timestamp,
    contains_any_sql,
    sql_array,
    sql_text,
    whole_days,
    word_tokens,
)
from urltriage.functions.urls import url_path
from urltriage.operators.keyed import latest_per_key
from urltriage.operators.rules import Rule, fire


def similar_known_domains(base: str) -> str:
    """Known domains the given one is confusable with (equality included).

    The known list is fixed and short, so it is an array literal rather than a
    join; length gap and character bound come before the distances.
    """
    gap = f"abs(length({base}) - length(known)) <= {C.SIMILAR_MAX_LENGTH_GAP}"
    close = f"{levenshtein_similarity(base, 'known')} > {C.SIMILAR_MIN_LEVENSHTEIN}D"
    possible = may_reach_jaro_winkler(base, "known", C.SIMILAR_MIN_JARO_WINKLER)
    near = f"{possible} AND {jaro_winkler(base, 'known')} > {C.SIMILAR_MIN_JARO_WINKLER}D"
    return (
        f"filter({sql_array(C.KNOWN_DOMAINS)}, known -> {base} != '' AND {gap} AND (({close}) OR ({near})))"
    )


def brand_present(brands: Sequence[str] | None) -> str:
    """Brand named in domain, title, snippet or path, as substring or as token."""
    names = [b.strip().lower() for b in brands or () if b and b.strip()]
    if not names:
        return "false"
    tokens = {t for b in names for t in re.split(BRAND_SEPARATORS, b) if t}
    # The line break keeps a match from running across two of the texts.
    texts = "concat_ws('\\n', _base, _title, _snippet, _path)"
    shared = f"coalesce(arrays_overlap(_tokens, {sql_array(sorted(tokens))}), false)" if tokens else "false"
    return f"({contains_any_sql(texts, names)} OR {shared})"


def _fact_rules() -> list[Rule]:
    high, low = (", ".join(sql_text(s) for s in x) for x in (C.HIGH_RISK_SUFFIXES, C.LOW_RISK_SUFFIXES))
    ips = "size(coalesce(ip, array()))"
    servers = "lower(array_join(coalesce(ns_records, CAST(array() AS ARRAY<STRING>)), '\\n'))"
    trusted = contains_any_sql(servers, C.TRUSTED_NAMESERVER_WORDS)
    minimum = C.CREATION_MIN_DAYS
    return [
        Rule(
            f"_age < {minimum}",
            C.CREATION_POINTS,
            f"concat('Creado hace ', _age, ' días (<{minimum})')",
            strong=True,
        ),
        Rule("size(coalesce(emails, array())) = 0", C.NO_EMAIL_POINTS, "'Sin emails en WHOIS'", strong=True),
        Rule(
            "trim(coalesce(registrar, '')) = ''",
            C.NO_REGISTRAR_POINTS,
            "'Sin registrador confiable'",
            strong=True,
        ),
        Rule(
            f"suffix IN ({high})",
            C.HIGH_RISK_SUFFIX_POINTS,
            "concat('TLD de alto riesgo: .', suffix)",
            strong=True,
        ),
        Rule(
            f"suffix IN ({low})",
            C.LOW_RISK_SUFFIX_POINTS,
            "concat('TLD de riesgo medio: .', suffix)",
            strong=True,
        ),
        Rule("mx_count = 0", C.NO_MX_POINTS, "'Sin MX records'"),
        Rule(
            f"try_cast(ttl AS INT) < {C.SHORT_TTL_SECONDS}",
            C.SHORT_TTL_POINTS,
            "concat('TTL corto: ', ttl, 's')",
            strong=True,
        ),
        Rule(f"{ips} = 0", C.NO_IP_POINTS, "'No resuelve IP'", strong=True),
        Rule("ns_count <= 1", C.FEW_NS_POINTS, "'Pocos NS records'", strong=True),
        Rule(f"{servers} != '' AND NOT {trusted}", C.UNTRUSTED_NS_POINTS, "'Nameservers no confiables'"),
        Rule(
            f"{ips} > {C.MANY_IPS_LIMIT}", C.MANY_IPS_POINTS, "'Múltiples IPs (fast-flux?)'", strong=True
        ),
        Rule("NOT startswith(lower(_url), 'https')", C.NO_HTTPS_POINTS, "'Sin HTTPS'", strong=True),
    ]


def _named(text: str, words: str) -> str:
    return f"concat({sql_text(text)}, array_join({words}, ', '))"


def _word_rules() -> list[Rule]:
    hc, promo, urgency = "size(_hc)", "size(_promo)", "size(_urgency)"
    backed = f"(_brand OR _strong1 OR {promo} > 0)"
    return [
        Rule(
            f"{hc} > 0 AND _brand",
            f"{hc} * {C.HIGH_CONFIDENCE_BRAND_POINTS}",
            _named("Keywords de alta confianza (contexto marca): ", "_hc"),
        ),
        Rule(
            f"{hc} > 0 AND NOT _brand AND _strong0",
            f"{hc} * {C.HIGH_CONFIDENCE_STRONG_POINTS}",
            _named("Keywords de alta confianza (con señales fuertes): ", "_hc"),
        ),
        Rule(
            f"{hc} > 0 AND NOT _brand AND NOT _strong0",
            f"{hc} * {C.HIGH_CONFIDENCE_ALONE_POINTS}",
            _named("Keywords de alta confianza (aisladas): ", "_hc"),
        ),
        Rule(
            f"{promo} > 0 AND _brand",
            f"{promo} * {C.PROMO_BRAND_POINTS}",
            _named("Keywords promocionales junto a marca: ", "_promo"),
        ),
        Rule(
            f"{promo} > 0 AND NOT _brand AND _strong1",
            f"{promo} * {C.PROMO_POINTS}",
            _named("Keywords promocionales con señales fuertes: ", "_promo"),
        ),
        Rule(
            f"{promo} > 0 AND NOT _brand AND NOT _strong1",
            C.PROMO_POINTS,
            _named("Keywords promocionales aisladas: ", "_promo"),
        ),
        Rule(
            f"{urgency} > 0 AND {backed}",
            f"{urgency} * {C.URGENCY_POINTS}",
            _named("Keywords urgencia: ", "_urgency"),
        ),
        Rule(f"{urgency} > 0 AND NOT {backed}", C.URGENCY_ALONE_POINTS, None),
    ]


def score_domain(
    df: DataFrame,
    as_of,
    brands: Sequence[str] | None = None,
    threshold: int = C.SUSPICIOUS_THRESHOLD,
) -> DataFrame:
    """Add suspicious, reasons and score to sites with attached facts.

    Needs url, domain (host), base_domain, suffix, title, snippet, filtered and
    the fact columns.  Everything is one narrow projection chain: no shuffle.
    ``brands`` is a short list and becomes literals of the plan.
    """
    none = "CAST(array() AS ARRAY<STRING>)"
    stored = f"coalesce(reasons, {none})" if "reasons" in df.columns else none
    out = df.select(
        "*",
        F.lower(url_path(F.trim("url"))).alias("_raw_path"),
        whole_days(as_timestamp(as_of), F.col("creation_date")).alias("_age"),
    ).selectExpr(
        "*",
        "trim(coalesce(url, '')) AS _url",
        "coalesce(_raw_path, '') AS _path",
        "lower(coalesce(title, '')) AS _title",
        "lower(coalesce(snippet, '')) AS _snippet",
        "lower(coalesce(base_domain, '')) AS _base",
        f"{stored} AS _stored",
        "coalesce(filtered, false) AS _filtered",
    )
    out = out.withColumn("_tokens", word_tokens(F.concat_ws(" ", "_base", "_path", "_title", "_snippet")))

    def hits(words) -> str:
        return f"array_sort(array_intersect(_tokens, {sql_array(words)}))"

    labels = "split(coalesce(domain, ''), '[.]')"
    out = out.selectExpr(
        "*",
        f"{brand_present(brands)} AS _brand",
        f"{hits(C.HIGH_CONFIDENCE_WORDS)} AS _hc",
        f"{hits(C.PROMO_WORDS)} AS _promo",
        f"{hits(C.SITE_URGENCY_WORDS)} AS _urgency",
        f"{similar_known_domains('_base')} AS _similar",
        f"CASE WHEN size({labels}) > 3 THEN array_join(slice({labels}, 1, size({labels}) - 2), '.') "
        "ELSE '' END AS _sub",
    )
    out, facts = fire(out, _fact_rules(), "_f")
    # Later rules read the flag as it stands after the earlier ones.
    out = out.selectExpr("*", f"({facts.strong()}) AS _strong0").selectExpr(
        "*",
        "_strong0 OR (size(_hc) > 0 AND _brand) AS _strong1",
        f"{contains_any_sql('_sub', C.SUSPICIOUS_SUBDOMAIN_WORDS)} AS _bad_sub",
    )
    out, words = fire(out, _word_rules(), "_w")
    out = out.selectExpr(
        "*",
        f"CAST(least(100, {facts.points()} + {words.points()} + "
        f"size(_similar) * {C.SIMILAR_DOMAIN_POINTS} + "
        f"CASE WHEN _bad_sub THEN {C.SUSPICIOUS_SUBDOMAIN_POINTS} ELSE 0 END) AS INT) AS _score",
        f"concat({facts.reasons()}, {words.reasons()}, "
        "transform(_similar, k -> concat('Similar a ', k, ' (typosquatting posible)')), "
        "CASE WHEN _bad_sub THEN array(concat('Subdominio sospechoso: ', _sub)) "
        f"ELSE {none} END) AS _reasons",
        "_strong1 OR size(_similar) > 0 OR _bad_sub AS _strong2",
    )
    # A filtered site keeps its stored reasons.  A record that lacks ns_count
    # cannot be evaluated and counts as suspicious.
    failed = "ns_count IS NULL"
    by_brand = f"_score < {threshold} AND _strong2 AND _brand"
    keep = [c for c in df.columns if c not in ("suspicious", "reasons", "score")]
    return out.selectExpr(
        *[f"`{c}`" for c in keep],
        f"CASE WHEN _filtered THEN false WHEN {failed} THEN true "
        f"ELSE _score >= {threshold} OR (_strong2 AND _brand) END AS suspicious",
        f"CASE WHEN _filtered THEN _stored WHEN {failed} THEN array('Error en evaluación') "
        f"WHEN {by_brand} THEN array_append(_reasons, 'Señales fuertes combinadas con mención de marca') "
        "ELSE _reasons END AS reasons",
        f"CASE WHEN _filtered THEN 0 WHEN {failed} THEN 50 ELSE _score END AS score",
    )


def verdict_facts(scored: DataFrame, as_of) -> DataFrame:
    """Verdict per domain for the facts table (last site in search order wins)."""
    columns = ["base_domain", "keyword_seq", "rank", "url", "reasons", "score", "filtered", "whitelisted"]
    return (
        latest_per_key(scored.select(*columns), "base_domain", ["keyword_seq", "rank", "url"])
        .drop("keyword_seq", "rank", "url")
        .withColumn("cached_at", as_timestamp(as_of))
    )
