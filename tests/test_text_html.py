"""Text, URL and HTML functions on hard inputs."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from urltriage import config as C
from urltriage.functions import html as H
from urltriage.functions import keywords as W
from urltriage.functions import text as X
from urltriage.functions import urls as U
from urltriage.operators import candidates as S
from urltriage.operators import page_features as P
from urltriage.operators.suffix import with_registrable_domain


def one(spark, column, **values):
    ddl = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], ddl).select(column).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("a&amp;lt; &#39;x&#x41;", "a&lt; 'xA"),
        ("&nope; & &copy; &#38;lt;", "&nope; & © &lt;"),
        ("&#xD800; &#99999999; &eacute;", "&#xD800; &#99999999; é"),
        ("plain", "plain"),
        ("&#128512;&", "😀&"),
    ],
)
def test_entities(spark, raw, want):
    assert one(spark, F.expr(X.decode_entities_sql("t")), t=raw) == want


def test_whitespace(spark):
    raw = " \t A  B \n\n c\x1f　d e "
    assert one(spark, X.normalize_text(F.col("t")), t=raw) == re.sub(r"\s+", " ", raw).strip().lower()


@pytest.mark.parametrize(
    ("url", "host", "path", "key"),
    [
        ("HTTPS://User:pw@WWW.Example.com:443/A/b;p=1?q#f", "www.example.com", "/A/b", "https://www.example.com/A/b;p=1"),
        ("http://h_1.com:80", "h_1.com", "", "http://h_1.com"),
        ("http://h.com:8080/x/", "h.com", "/x/", "http://h.com:8080/x"),
        ("example.com/login", "", "example.com/login", "example.com/login"),
        ("//cdn.example/2", "cdn.example", "/2", "//cdn.example/2"),
        ("http://[::1]:80/a", "::1", "/a", "http://[::1]/a"),
        ("", "", "", ""),
    ],
)
def test_url_parts(spark, url, host, path, key):
    assert one(spark, U.url_host(F.col("u")), u=url) == host
    assert one(spark, U.url_path(F.col("u")), u=url) == path
    assert one(spark, U.normalize_url(F.col("u")), u=url) == key


def test_kept_query(spark):
    assert one(spark, U.normalize_url(F.col("u"), True), u="http://A.com/x/?b=1#f") == "http://a.com/x?b=1"


@pytest.mark.parametrize(
    ("base", "ref", "want"),
    [
        ("https://h.com/a/b?q", "c.png", "https://h.com/a/c.png"),
        ("https://h.com/a/b", "/c", "https://h.com/c"),
        ("https://h.com/a/b", "//x.com/c", "https://x.com/c"),
        ("https://h.com/a/b/", "../c", "https://h.com/a/c"),
        ("https://h.com/a", "./x/./y", "https://h.com/x/y"),
        ("https://h.com/a", "http://y.com/z", "http://y.com/z"),
        ("https://h.com", "i.png", "https://h.com/i.png"),
        ("https://h.com/a?b#c", "?d", "https://h.com/a?d"),
    ],
)
def test_resolve(spark, base, ref, want):
    assert one(spark, U.resolve_url(F.col("b"), F.col("r")), b=base, r=ref) == want


def test_registrable_domain(spark):
    rules = spark.createDataFrame(
        [("com", "exact"), ("uk", "exact"), ("co.uk", "exact"), ("ck", "exact"), ("*.ck", "wildcard"), ("www.ck", "exception")],
        "suffix string, rule_type string",
    )
    want = {
        "a.b.example.com": ("com", "example", "a.b", "example.com"),
        "shop.acme.co.uk": ("co.uk", "acme", "shop", "acme.co.uk"),
        "x.y.foo.ck": ("foo.ck", "y", "x", "y.foo.ck"),
        "www.ck": ("ck", "www", "", "www.ck"),
        "a.www.ck": ("ck", "www", "a", "www.ck"),
        "co.uk": ("co.uk", "", "", ".co.uk"),
        "10.0.0.1": ("", "10.0.0.1", "", "10.0.0.1"),
        "intranet": ("", "intranet", "", "intranet"),
        "": ("", "", "", ""),
    }
    df = spark.createDataFrame([(h,) for h in want], "host string")
    out = with_registrable_domain(df, "host", rules).collect()
    assert {r["host"]: (r["suffix"], r["domain_core"], r["subdomain"], r["base_domain"]) for r in out} == want


PAGE = """<!DOCTYPE html><html><head><title>Big &amp; <!-- x -->Sale</title>
<meta name='Description' content="a > b"><meta name=description content=Last><meta charset=utf-8>
<script>var f = "<form><img src=x>"; if (a < b) {}</script><style>p{}</style></head><body>
<!-- <img src="hidden.png"> <form></form> -->
<p title="1 > 0">Hello<b>World</b> a < b</p>
<FORM ACTION=/go method="POST"><input TYPE=Password name="Email_x"><input value="name=cvv" id='CVV'></FORM>
<form action='https://Evil.example:8443/x'><input name=q>
<a href="https://other.example/?a=1&amp;b=2">o</a><a name=x>no</a><a href="">e</a><a href=//cdn.example.com/z>c</a>
<img src="/logo.png" alt='ACME'><img data-src="no" SRC=b.png>
<script>unclosed"""


def test_page_structure(spark):
    df = spark.createDataFrame([(PAGE, "example.com")], "html string, base string")
    dom = df.withColumn("d", H.strip_hidden(F.col("html")))
    row = dom.select(
        H.title_text("d").alias("title"),
        H.visible_text("d").alias("text"),
        F.expr(H.tag_count("d", "img")).alias("imgs"),
        P.meta_map("d").alias("meta"),
        P.judged_forms(P.parsed_forms("d"), F.col("base")).alias("forms"),
        P.link_hosts("d").alias("links"),
        P.image_array("d").alias("images"),
    ).first()
    assert row["title"] == "big & sale"
    assert row["text"] == "big & sale hello world a < b o no e c"
    assert row["imgs"] == 2
    assert row["meta"] == {"description": "Last"}
    first, second = row["forms"]
    assert (first["action"], first["action_domain"], first["method"]) == ("/go", "example.com", "post")
    assert first["has_password"] and first["has_email"] and first["suspicious_inputs"]
    assert [(i["type"], i["name"]) for i in first["inputs"]] == [("password", "email_x"), ("text", "cvv")]
    assert second["action_domain"] == "evil.example" and second["inputs_count"] == 1
    assert list(row["links"]) == ["other.example", "", "cdn.example.com"]
    assert [(i["src"], i["alt"]) for i in row["images"]] == [("/logo.png", "ACME"), ("b.png", None)]


def test_very_long_tag_is_no_stack_overflow(spark):
    tag = "<p " + " ".join(f'a{i}="{i}"' for i in range(60_000)) + ">x</p>"
    assert one(spark, H.visible_text("t"), t=tag) == "x"


KEYWORD_TEXTS = [
    "verify account verify-account verified account-verification",
    "login to claim now, login required! free gift free-gift",
    "sign_in sign-in signin éxpires expires ñlogin login",
    "100% original 1100% original cheap {brand}x cheap {brand} replica",
    "oferta por tiempo oferta limited stock limited_stock limited-stock",
    "login", "", "xlogin login2 login",
]


@pytest.mark.parametrize("text", KEYWORD_TEXTS)
def test_keyword_counts_equal_one_search_per_keyword(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    row = P.keyword_features(df, "text").first()
    for family, words in C.KEYWORD_FAMILIES.items():
        want = {k: len(re.findall(rf"\b{re.escape(k)}\b", text)) for k in words}
        assert row[f"{family}_keywords_count"] == sum(want.values()), family
        assert row[f"{family}_keywords_hits"] == sorted(k for k, n in want.items() if n), family


@pytest.mark.parametrize("text", [*KEYWORD_TEXTS, "aá " * 40 + "login " + "é" * 80 + " act now " + "login " * 9])
def test_snippets_equal_search(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(P.text_snippets(F.col("text"), W.occurrences(F.col("text"), P.ALL_KEYWORDS))).first()[0]
    want = [
        text[max(0, m.start() - 50) : m.end() + 50].strip()[:100]
        for k in sorted(set(P.SNIPPET_KEYWORDS))
        for m in re.finditer(rf"\b{re.escape(k)}\b", text)
    ]
    assert list(got) == want[:5]


def test_logo_limit(spark):
    images = "".join(f"<img src='/logo{i}.png'>" if i % 2 == 0 else "<img src='/x.png'>" for i in range(20))
    df = spark.createDataFrame([(images, "acme")], "d string, brand string")
    row = df.select(
        P.logo_candidates(P.image_array("d"), F.col("brand")).alias("logos"),
        P.compared_images(P.image_array("d"), F.col("brand")).alias("seen"),
    ).first()
    assert len(row["logos"]) == 5 and len(row["seen"]) == 9


def test_result_links(spark):
    page = (
        '<a class="result__a big" href="/l/?uddg=https%3A%2F%2Fa.com%2Fx+y&amp;rut=1">1</a>'
        '<a class="result__abc" href="https://no.com">2</a><a href="https://b.com/%zz" class=result__a>3</a>'
        '<a class="result__a" href="/l/?uddg=ftp">4</a><a class="result__a">5</a>'
    )
    assert one(spark, S.result_links("h"), h=page) == ["https://a.com/x+y", "https://b.com/%zz", "/l/?uddg=ftp"]


def test_lists_and_dates(spark):
    back = X.list_from_json(F.col("t"))
    assert one(spark, back, t='["a", "", "b"]') == ["a", "b"]
    assert one(spark, back, t="free text") == ["free text"]
    assert one(spark, back, t="") == []
    for raw, want in {
        "2024-03-05T01:02:03Z": "2024-03-05 01:02:03",
        "03/05/2024": "2024-03-05 00:00:00",
        "2024-03-05 01:02:03.5": "2024-03-05 01:02:03",
        "2024-03-05T01:02:03+02:00": "2024-03-04 23:02:03",
        "soon": None,
    }.items():
        shown = F.date_format(X.normalize_date(F.col("t")), "yyyy-MM-dd HH:mm:ss")
        assert one(spark, shown, t=raw) == want, raw
