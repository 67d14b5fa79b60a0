"""Every registered query against its SQL, and the shape of its plan."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import compare
from urltriage.plans import catalog

SF = "/root/testdata/sf0.001"
ORACLES = catalog.ORACLES
QUERIES = catalog.QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    ok, note, _ = compare(spark, name, QUERIES[name], ORACLES.get(name), SF)
    assert ok, note


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize(
    "name",
    ["domain_triage", "page_triage", "typosquat_known", "candidate_filter", "dns_rollup", "query_expansion"],
)
def test_no_nested_loops(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan


#: Beginnings of reasons that page rules give.
REASONS = (
    "Dominio exacto", "Marca en dominio", "Marca en path", "Plataforma oficial", "Formularios con campo password",
    "Formularios con campo email", "Formularios con campos sospechosos", "Ratio forms", "Keywords de credenciales",
    "Keywords ecommerce", "Keywords de urgencia", "Keywords de phishing", "Keywords de replica", "pago sospechoso",
    "contacto insuficiente", "TLD sospechoso", "Similitud tipográfica", "proporción de enlaces", "Poca cantidad",
    "educativo/informativo", "Sin HTTPS", "Domini o joven", "SSL inválido", "Emisor SSL", "cantidad de imágenes",
)


def test_page_rules_fire(spark):
    """Each rule gives its reason for several pages at sf0.01."""
    found = [r["reasons"] for r in QUERIES["page_score"](spark, "/root/testdata/sf0.01").select("reasons").collect()]
    rare = {r: n for r in REASONS if (n := sum(r in x for x in found)) < 5}
    assert not rare
    brands = [r["reasons"] for r in QUERIES["page_score_brands"](spark, "/root/testdata/sf0.01").collect()]
    assert sum("múltiples marcas" in x for x in brands) >= 5
    logos = [r["reasons"] for r in QUERIES["page_triage_logo"](spark, "/root/testdata/sf0.01").collect()]
    assert sum("Logo similar" in x for x in logos) >= 5


def test_prefilter_arms_fire(spark):
    found = QUERIES["prefilter"](spark, "/root/testdata/sf0.01").collect()
    for reason in ("Irrelevant or educational content", "Irrelevant domain", "Whitelist match"):
        assert sum(r["prefilter_reason"] == reason for r in found) >= 5
    assert sum(r["is_legit_subdomain"] for r in found) >= 5


def test_page_source_is_never_shuffled(spark):
    """Also where nothing can be broadcast, the HTML stays below the first exchange."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        plan = QUERIES["brand_page_triage"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffled and not any("html" in line for line in shuffled)


def test_html_is_not_read_where_it_is_not_needed(spark):
    plan = QUERIES["domain_triage"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "html:string" not in plan


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
