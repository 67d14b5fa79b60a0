"""Page risk: weighted rules, sigmoid score in 0..1, category and reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urltriage import config as C
from urltriage.functions.text import (
    linear_damped_sql,
    log_damped_sql,
    sigmoid_sql,
    sql_text,
    two_decimals_sql,
)
from urltriage.operators.rules import Rule, fire

PHISHING_FROM = 0.7
SUSPECT_FROM = 0.3
CATEGORY = (
    f"CASE WHEN score >= {PHISHING_FROM}D THEN 'phishing' "
    f"WHEN score >= {SUSPECT_FROM}D THEN 'suspect' ELSE 'legit' END"
)
LEGIT_REASON = "Override: Señales legit fuertes (dominio viejo, SSL válido, logo match)"


def _with(text: str, value: str, after: str = "") -> str:
    return f"concat({sql_text(text)}, {value}, {sql_text(after)})"


def page_rules(columns: set[str], options: C.PageRiskOptions) -> list[Rule]:
    """Rules in order; inputs nobody produces are optional columns."""
    w = options.weights
    backed = "(password_inputs_count > 0 OR suspicious_forms_count > 0 OR phishing_keywords_count > 0)"
    several = "phishing_keywords_count >= 2"
    if options.snippet_arm:
        near = "exists(text_snippets, s -> contains(lower(s), lower(brand)))"
        several = f"({several} OR (phishing_keywords_count > 0 AND {near}))"
    unknown_contact = str(options.default_contact_suspicious).lower()
    contact = (
        f"coalesce(contact_info_suspicious, {unknown_contact})"
        if "contact_info_suspicious" in columns
        else unknown_contact
    )
    several_brands = "multi_brand_detected" if "multi_brand_detected" in columns else "false"
    suffixes = ", ".join(sql_text(s) for s in C.SUSPICIOUS_SUFFIXES)
    issuers = ", ".join(sql_text(s) for s in C.TRUSTED_ISSUERS)
    official = "'Plataforma oficial / retailer (whitelist override)'"
    not_brand = "NOT exact_brand_domain"
    return [
        Rule("exact_brand_domain", w.exact_brand_domain, "'Dominio exacto de la marca (confianza)'"),
        Rule(
            f"{not_brand} AND brand_in_domain", w.brand_in_domain, "'Marca en dominio (reduce sospecha)'"
        ),
        Rule(
            f"{not_brand} AND NOT brand_in_domain AND brand_in_path",
            w.brand_in_path,
            "'Marca en path/subdominio pero no en dominio base (posible spoof)'",
        ),
        Rule("brand_whitelisted", w.whitelisted_platform, official),
        Rule(
            "password_inputs_count > 0",
            w.password_input,
            _with("Formularios con campo password: ", "password_inputs_count"),
        ),
        Rule(
            "email_inputs_count > 0",
            w.password_input,
            _with("Formularios con campo email: ", "email_inputs_count"),
        ),
        Rule(
            "suspicious_forms_count > 0",
            w.password_input,
            _with("Formularios con campos sospechosos (e.g., card_number): ", "suspicious_forms_count"),
        ),
        Rule("forms_count > 2", w.many_forms, _with("Multiples formularios (", "forms_count", ")")),
        Rule(
            "forms_external_action_ratio > 0.2D",
            f"{w.form_action_external}D * forms_external_action_ratio",
            _with("Ratio forms->dominios externos: ", two_decimals_sql("forms_external_action_ratio")),
        ),
        Rule(
            "credential_keywords_count > 0",
            f"{w.credential_keywords}D * {log_damped_sql('credential_keywords_count')}",
            _with("Keywords de credenciales en página: ", "credential_keywords_count"),
        ),
        Rule(
            f"ecommerce_keywords_count > 0 AND {backed}",
            f"{w.ecommerce_keywords}D * {linear_damped_sql('ecommerce_keywords_count', 10)}",
            _with("Keywords ecommerce junto a formularios o phishing: ", "ecommerce_keywords_count"),
        ),
        Rule(
            f"urgency_keywords_count > 0 AND {backed}",
            f"{w.urgency_keywords}D * {linear_damped_sql('urgency_keywords_count', 5)}",
            _with("Keywords de urgencia con señales fuertes: ", "urgency_keywords_count"),
        ),
        Rule(
            several,
            f"{w.phishing_keywords}D * {linear_damped_sql('phishing_keywords_count', 5)}",
            _with("Keywords de phishing (múltiples o cerca de marca): ", "phishing_keywords_count"),
        ),
        Rule(
            "replica_keywords_count > 0",
            w.replica_keywords,
            _with("Keywords de replica/mercancía falsa: ", "replica_keywords_count"),
        ),
        Rule(
            "suspicious_payment",
            w.suspicious_payment,
            "'Método de pago sospechoso (tarjeta directa sin pasarela confiable)'",
        ),
        Rule(
            contact, w.contact_info_suspicious, "'Información de contacto insuficiente o email gratuito'"
        ),
        Rule(
            several_brands,
            w.multi_brand_detected,
            "'Inventario con múltiples marcas no relacionadas (scam típico)'",
        ),
        Rule(
            "_logo > 0.8D",
            w.images_logo_match,
            _with("Logo similar detectado (sim: ", two_decimals_sql("_logo"), ")"),
        ),
        Rule(f"suffix IN ({suffixes})", w.suspicious_suffix, _with("TLD sospechoso: .", "suffix")),
        Rule(
            "typo_score > 0.5D",
            f"{w.typo_similar_brand}D * least(1D, typo_score)",
            _with("Similitud tipográfica con marca: ", two_decimals_sql("typo_score")),
        ),
        Rule(
            "external_links_ratio > 0.6D",
            w.external_links_ratio,
            "'Alta proporción de enlaces externos (posible redirección/affiliate)'",
        ),
        Rule(
            f"text_len < {C.MIN_TEXT_LENGTH} AND forms_count > 0",
            w.low_text_to_form_ratio,
            "'Poca cantidad de texto frente a formularios (página muy simple)'",
        ),
        Rule(
            "informational_context",
            w.informational_context,
            "'Contenido claramente educativo/informativo (reduce sospecha)'",
        ),
        Rule("whitelisted_platform", w.whitelisted_platform, official),
        Rule("NOT coalesce(is_https, false)", w.https_missing, "'Sin HTTPS'"),
        Rule("domain_age_days < 180", w.domain_young, _with("Domini o joven: ", "domain_age_days", " días")),
        Rule("NOT ssl_valid", w.ssl_invalid, "'SSL inválido o ausente'"),
        Rule(
            "ssl_age_days < 30 AND domain_age_days < 90",
            w.ssl_young,
            _with("Cert SSL joven: ", "ssl_age_days", " días"),
        ),
        Rule(
            f"ssl_issuer != '' AND ssl_issuer NOT IN ({issuers})",
            w.ssl_untrusted_issuer,
            _with("Emisor SSL no confiable: ", "ssl_issuer"),
        ),
        Rule(
            "images_count > 20 AND text_len < 1000",
            w.high_img_low_text,
            "'Alta cantidad de imágenes con poco texto (posible fake shop)'",
        ),
    ]


def score_page(df: DataFrame, options: C.PageRiskOptions | None = None) -> DataFrame:
    """Add score (rounded to four decimals), category and reasons."""
    options = options or C.PageRiskOptions()
    columns = set(df.columns)
    logo = "coalesce(logo_similarity, 0D)" if "logo_similarity" in columns else "0D"
    known = df.selectExpr("*", f"{logo} AS _logo")
    flagged, fired = fire(known, page_rules(columns, options), "_g")
    legit = (
        "coalesce(exact_brand_domain, false) OR coalesce(whitelisted_platform, false) OR "
        "(_logo > 0.8D AND coalesce(domain_age_days, 0) > 365 AND coalesce(ssl_valid, false))"
    )
    raw = flagged.selectExpr(
        "*", f"{sigmoid_sql(fired.points())} AS _raw", f"({legit}) AS _legit", f"{fired.reasons()} AS _reasons"
    )
    kept = [f"`{c}`" for c in df.columns]
    scored = raw.selectExpr(
        *kept,
        "round(CASE WHEN _legit THEN greatest(0D, _raw - 0.5D) ELSE _raw END, 4) AS score",
        f"array_sort(array_distinct(CASE WHEN _legit THEN array_append(_reasons, {sql_text(LEGIT_REASON)}) "
        "ELSE _reasons END)) AS reasons",
    )
    return scored.withColumn("category", F.expr(CATEGORY))
