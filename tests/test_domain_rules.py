"""One row per rule and per boundary of the domain score."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from urltriage import schemas
from urltriage.operators import facts as D
from urltriage.operators.domain_risk import score_domain, verdict_facts

AS_OF = "2025-01-01 00:00:00"
NOW = datetime(2025, 1, 1)
SCHEMA = schemas.table(
    "id string, url string, domain string, base_domain string, suffix string, title string, "
    "snippet string, filtered boolean, reasons array<string>, creation_date timestamp, "
    "emails array<string>, registrar string, mx_count int, ttl int, ip array<string>, "
    "ns_count int, ns_records array<string>"
)
# Fires no rule at all.
CLEAN = {
    "url": "https://plain.org/", "domain": "plain.org", "base_domain": "plain.org", "suffix": "org",
    "title": "", "snippet": "", "filtered": False, "reasons": None,
    "creation_date": NOW - timedelta(days=4000), "emails": ["a@plain.org"], "registrar": "R",
    "mx_count": 1, "ttl": 3600, "ip": ["10.0.0.1"], "ns_count": 2, "ns_records": ["NS1.Cloudflare.com"],
}


def run(spark, cases, **options):
    rows = [tuple({**CLEAN, **c, "id": k}.get(f.name) for f in SCHEMA.fields) for k, c in cases.items()]
    out = score_domain(spark.createDataFrame(rows, SCHEMA), AS_OF, **options).collect()
    return {r["id"]: (r["suspicious"], list(r["reasons"]), r["score"]) for r in out}


def days(n):
    return NOW - timedelta(days=n)


CASES = {
    "clean": ({}, 0, []),
    "age179": ({"creation_date": days(179)}, 20, ["Creado hace 179 días (<180)"]),
    "age180": ({"creation_date": days(180)}, 0, []),
    "future": ({"creation_date": days(-1)}, 20, ["Creado hace -1 días (<180)"]),
    "no_date": ({"creation_date": None}, 0, []),
    "no_email": ({"emails": []}, 8, ["Sin emails en WHOIS"]),
    "blank_registrar": ({"registrar": "  "}, 12, ["Sin registrador confiable"]),
    "null_registrar": ({"registrar": None}, 12, ["Sin registrador confiable"]),
    "high_suffix": ({"suffix": "xyz"}, 45, ["TLD de alto riesgo: .xyz"]),
    "low_suffix": ({"suffix": "ru"}, 12, ["TLD de riesgo medio: .ru"]),
    "no_mx": ({"mx_count": 0}, 12, ["Sin MX records"]),
    "null_mx": ({"mx_count": None}, 0, []),
    "ttl299": ({"ttl": 299}, 10, ["TTL corto: 299s"]),
    "ttl300": ({"ttl": 300}, 0, []),
    "ttl_null": ({"ttl": None}, 0, []),
    "no_ip": ({"ip": []}, 10, ["No resuelve IP"]),
    "ip5": ({"ip": list("abcde")}, 0, []),
    "ip6": ({"ip": list("abcdef")}, 10, ["Múltiples IPs (fast-flux?)"]),
    "ns1": ({"ns_count": 1}, 10, ["Pocos NS records"]),
    "ns_untrusted": ({"ns_records": ["ns.example"]}, 10, ["Nameservers no confiables"]),
    "ns_empty": ({"ns_records": []}, 0, []),
    "http": ({"url": "http://plain.org/"}, 12, ["Sin HTTPS"]),
    "hc_alone": (
        {"url": "https://plain.org/login/verify"},
        8,
        ["Keywords de alta confianza (aisladas): login, verify"],
    ),
    "hc_strong": (
        {"url": "http://plain.org/login"},
        30,
        ["Sin HTTPS", "Keywords de alta confianza (con señales fuertes): login"],
    ),
    "hyphen_entry_is_inert": (
        {"title": "sign-in reset-password"},
        8,
        ["Keywords de alta confianza (aisladas): password, reset"],
    ),
    "promo_alone": ({"title": "free sale"}, 3, ["Keywords promocionales aisladas: free, sale"]),
    "promo_strong": (
        {"title": "free sale", "emails": None},
        14,
        ["Sin emails en WHOIS", "Keywords promocionales con señales fuertes: free, sale"],
    ),
    "urgency_alone": ({"title": "hurry"}, 2, []),
    "urgency_promo": (
        {"title": "hurry free"},
        7,
        ["Keywords promocionales aisladas: free", "Keywords urgencia: hurry"],
    ),
    "typo": ({"base_domain": "paypa1.com"}, 40, ["Similar a paypal.com (typosquatting posible)"]),
    "typo_equal": ({"base_domain": "paypal.com"}, 40, ["Similar a paypal.com (typosquatting posible)"]),
    "subdomain": ({"domain": "secure-login.a.plain.org"}, 8, ["Subdominio sospechoso: secure-login.a"]),
    "subdomain3": ({"domain": "login.plain.org"}, 0, []),
    "stored": ({"filtered": True, "reasons": ["x"], "suffix": "xyz"}, 0, ["x"]),
    "mixed_mx_weak": (
        {"mx_count": 0, "url": "https://plain.org/login"},
        16,
        ["Sin MX records", "Keywords de alta confianza (aisladas): login"],
    ),
}


def test_rules_and_boundaries(spark):
    got = run(spark, {k: c for k, (c, _, _) in CASES.items()})
    for name, (_, score, reasons) in CASES.items():
        assert got[name][1:] == (reasons, score), name
        assert got[name][0] == (score >= 50), name


def test_threshold_and_cap(spark):
    got = run(
        spark,
        {
            "49": {"suffix": "xyz", "title": "login"},
            "at": {"registrar": None, "mx_count": 0, "suffix": "ru", "ttl": 1, "url": "http://plain.org"},
            "cap": {"suffix": "xyz", "registrar": "", "emails": [], "base_domain": "paypa1.com", "mx_count": 0},
        },
    )
    assert got["at"][2] == 58 and got["at"][0]
    assert got["49"][2] == 63
    assert got["cap"][2] == 100
    assert not run(spark, {"a": {"suffix": "xyz"}})["a"][0]
    assert run(spark, {"a": {"suffix": "xyz"}}, threshold=45)["a"][0]


def test_brands(spark):
    got = run(
        spark,
        {
            "strong": {"title": "Acme shop", "emails": []},
            "weak": {"title": "Acme shop"},
            "hc": {"title": "acme login"},
            "token": {"title": "big mr-c night"},
            "cross": {"title": "ac", "snippet": "me"},
        },
        brands=["Acme", "mr c", ""],
    )
    note = "Señales fuertes combinadas con mención de marca"
    assert got["strong"] == (True, ["Sin emails en WHOIS", note], 8)
    assert got["weak"] == (False, [], 0)
    assert got["hc"] == (True, ["Keywords de alta confianza (contexto marca): login", note], 30)
    assert got["cross"] == (False, [], 0)
    # The tokens of a brand count one by one.
    assert not got["token"][0] and got["token"][2] == 0


def test_record_without_ns_count_is_an_error(spark):
    assert run(spark, {"x": {"ns_count": None}})["x"] == (True, ["Error en evaluación"], 50)
    assert run(spark, {"x": {"ns_count": None, "filtered": True}})["x"] == (False, [], 0)


def test_lookup_error_counts_as_filtered(spark):
    row = spark.createDataFrame([("a.com", "timeout")], "base_domain string, error string")
    r = D.canonical_facts(row).first()
    assert (r["filtered"], r["score"], list(r["reasons"]), r["ns_count"]) == (True, 50, [], 0)
    assert len(D.CANONICAL) == 23


@pytest.mark.parametrize(
    ("hours", "fresh"), [(7 * 24 + 23, True), (8 * 24 - 1, True), (8 * 24, False), (0, True)]
)
def test_freshness_counts_completed_days(spark, hours, fresh):
    df = spark.createDataFrame([(NOW - timedelta(hours=hours),)], "last_updated timestamp")
    assert df.filter(D.is_fresh(AS_OF)).count() == int(fresh)


def test_prefilter(spark):
    rows = [
        ("https://a.com/x", "a.com", "show", "Irrelevant or educational content"),
        ("https://netflix.com/", "netflix.com", "", "Irrelevant domain"),
        ("https://www.google.com/", "google.com", "", "Whitelist match"),
        ("https://a.com/", "a.com", "", None),
        ("a.com/store/x", "", "", None),
        (None, "b.com", None, None),
    ]
    df = spark.createDataFrame(rows, "url string, base_domain string, title string, want string")
    out = D.prefilter(df.withColumn("snippet", F.lit(None).cast("string")))
    assert out.filter(~F.col("prefilter_reason").eqNullSafe(F.col("want"))).count() == 0
    strict = D.prefilter(df.withColumn("snippet", F.lit("")), strict_suffix=True)
    assert strict.filter("base_domain = 'netflix.com' and prefilter_reason is null").count() == 1


def test_legit_subdomain_only_without_scheme(spark):
    rows = [("https://a.b.com/x", "b.com"), ("a.b.com/x", "")]
    df = spark.createDataFrame(rows, "url string, base_domain string")
    out = D.prefilter(df.withColumns({"title": F.lit(""), "snippet": F.lit("")}))
    assert [r[0] for r in out.orderBy(F.desc("url")).select("is_legit_subdomain").collect()] == [False, True]


def test_verdict_of_a_domain_is_that_of_its_last_site(spark):
    rows = [("d.com", 0, 1, "u1", ["a"], 10, False, False), ("d.com", 0, 2, "u2", ["b"], 60, False, False)]
    df = spark.createDataFrame(
        rows,
        "base_domain string, keyword_seq int, rank int, url string, reasons array<string>, score int, "
        "filtered boolean, whitelisted boolean",
    )
    assert verdict_facts(df, AS_OF).first()["score"] == 60


def test_bad_json_is_a_miss(spark):
    rows = [("A.com", '{"registrar": "R", "emails": ["x"], "creation_date": "2024-01-02"}', NOW), ("b.com", "{oops", NOW), ("c.com", None, NOW), ("d.com", "[1]", NOW)]
    df = spark.createDataFrame(rows, "domain string, data string, last_updated timestamp")
    got = D.read_payload(df).collect()
    assert [r["base_domain"] for r in got] == ["a.com"]
    assert got[0]["creation_date"] == datetime(2024, 1, 2)
