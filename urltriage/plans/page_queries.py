"""Page-side queries with their comparison SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from urltriage import config as C
from urltriage.functions import html as H
from urltriage.functions import keywords as W
from urltriage.functions import text as X
from urltriage.functions.urls import url_host
from urltriage.operators import facts as D
from urltriage.operators import page_features as P
from urltriage.operators.mentions import brand_mentions
from urltriage.operators.page_risk import score_page
from urltriage.operators.suffix import inline_table, with_registrable_domain
from urltriage.plans import fixtures as fx
from urltriage.plans import page_triage as T
from urltriage.plans.domain_queries import O_TLS, _ints, located
from urltriage.plans.registry import query, sql_list, with_tables

# --- shared comparison steps ------------------------------------------------
_TAG = (
    r"""(?is)<(?:/?[a-z](?:[^''">]|"[^"]*"|''[^'']*'')*>|/?[a-z][^>]*>|[!?][^>]*>)"""
)
_ENTITIES = [(k, v) for k, v in X.NAMED_ENTITIES.items() if k != "&amp;"] + [("&amp;", "&")]


def _decoded(c: str) -> str:
    for name, char in _ENTITIES:
        c = f"replace({c}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return c


def _plain(c: str) -> str:
    return f"lower(trim(regexp_replace({_decoded(c)}, '{X.WHITESPACE}', ' ', 'g')))"


def _marked(c: str) -> str:
    return rf"regexp_replace({c}, '([\p{{L}}\p{{N}}_]+)', chr(1) || '\1' || chr(1), 'g')"


def mark(keyword: str) -> str:
    """Keyword with its words wrapped the way the marked text has them."""
    wrapped = re.sub(r"(\w+)", "\x01\\1\x01", keyword)
    return wrapped if re.search(r"\w$", keyword) else wrapped + "\x01"


def dom_steps(source: str) -> list[tuple[str, str]]:
    return [
        ("o_dom", f"select *, regexp_replace(coalesce(html, ''), '{H.HIDDEN}', ' ', 'g') as dom from {source}"),
        (
            "o_text",
            f"""select *, {_plain(f"regexp_replace(dom, '{_TAG}', ' ', 'g')")} as text,
            {_plain("regexp_extract(dom, '(?is)<title[^>]*>(.*?)</title', 1)")} as page_title from o_dom""",
        ),
    ]


def keyword_steps(source: str, key: str, text: str = "text") -> list[tuple[str, str]]:
    counts = ", ".join(
        f"list_sum(list_transform({sql_list(mark(k) for k in words)}, "
        f"lambda k: (len(m) - len(replace(m, k, ''))) // len(k))) as {family}_n, "
        "array_to_string(list_sort(list_filter("
        + "["
        + ", ".join(f"case when contains(m, '{mark(k)}') then '{k}' end" for k in words)
        + f"], lambda k: k is not null)), ',') as {family}_hits"
        for family, words in C.KEYWORD_FAMILIES.items()
    )
    return [
        ("o_marked", f"select *, {_marked(text)} as m from {source}"),
        ("o_kw", f"select *, {counts} from o_marked"),
    ]


_PAIRS = ", ".join(f"('{k}', '{mark(k)}')" for k in P.SNIPPET_KEYWORDS)


def snippet_steps(source: str, key: str, text: str = "text") -> list[tuple[str, str]]:
    """``source`` has the marked text m."""
    return [
        (
            "o_split",
            f"""select {key}, {text} as text, kw, string_split(m, mk) as parts from {source},
            (values {_PAIRS}) v(kw, mk) where contains(m, mk)""",
        ),
        ("o_pos", f"select *, unnest(range(1, len(parts))) as i from o_split"),
        (
            "o_start",
            f"""select {key}, text, kw, i, cast(list_sum(list_transform(parts[1:i], lambda p: len(replace(p, chr(1), '')))) as bigint)
            + (i - 1) * len(kw) as st from (select * from o_pos where i <= 5) z""",
        ),
        (
            "o_snip",
            f"""select {key}, string_agg(snip, ' || ' order by rn) as snippets from (
            select {key}, trim(substring(text, greatest(st - 50, 0) + 1, least(st, 50) + len(kw) + 50))[1:100] as snip,
              row_number() over (partition by {key} order by kw, i) as rn from o_start) r
            where rn <= 5 group by {key}""",
        ),
    ]


def form_steps(source: str, key: str, base: str) -> list[tuple[str, str]]:
    odd = " or ".join(f"contains(x.n, '{w}')" for w in C.SUSPICIOUS_INPUT_WORDS)
    return [
        (
            "f0",
            f"""select {key}, {base} as base, i, string_split_regex(dom, '(?i)<form')[i + 1] as piece
            from (select *, unnest(range(1, len(string_split_regex(dom, '(?i)<form')))) as i from {source}) q""",
        ),
        (
            "f1",
            f"""select {key}, base, i, regexp_extract(piece, '^[^>]*action="([^"]*)"', 1) as action,
            coalesce(nullif(lower(regexp_extract(piece, '^[^>]*method="([^"]*)"', 1)), ''), 'get') as method,
            list_transform(regexp_extract_all(string_split_regex(piece, '(?i)</form')[1], '<input([^>]*)>', 1),
              lambda a: {{'t': coalesce(nullif(lower(regexp_extract(a, 'type="([^"]*)"', 1)), ''), 'text'),
               'n': lower(coalesce(nullif(regexp_extract(a, 'name="([^"]*)"', 1), ''), regexp_extract(a, 'id="([^"]*)"', 1)))}}) as ins
            from f0""",
        ),
        (
            "f2",
            f"""select *, case when action = '' then '' when regexp_matches(action, '^([a-z]+:)?//')
              then regexp_extract(action, '^(?:[a-z]+:)?//([^/?#:]*)', 1) else base end as action_domain,
            len(list_filter(ins, lambda x: x.t = 'password')) > 0 as has_password,
            len(list_filter(ins, lambda x: x.t = 'email' or contains(x.n, 'email'))) > 0 as has_email,
            len(list_filter(ins, lambda x: {odd})) > 0 as odd from f1""",
        ),
        (
            "o_forms",
            f"""select {key}, count(*) as forms_count,
            count(*) filter (action_domain <> '' and action_domain <> base) / count(*) as ext_ratio,
            count(*) filter (odd) as odd_n, count(*) filter (has_password) as pw_n, count(*) filter (has_email) as mail_n,
            string_agg(action || ',' || action_domain || ',' || method || ',' ||
              array_to_string(list_transform(ins, lambda x: x.t || ':' || x.n), ';'), ' || ' order by i) as details
            from f2 group by {key}""",
        ),
    ]


LINK_STEP = (
    "o_links",
    """select {key}, case when len(hs) = 0 then 0 else
      len(list_filter(hs, lambda h: h <> '' and not contains(h, base))) / len(hs) end as link_ratio from (
     select {key}, {base} as base, list_transform(regexp_extract_all(dom, '<a href="([^"]*)"', 1),
      lambda h: regexp_extract(h, '^(?:[a-z]+:)?//([^/?#:]*)', 1)) as hs from {source}) q""",
)
BASE = "regexp_extract(url, '^[a-z]+://[^/?#]*?([^./]+[.][a-z]+)(?:[/?#]|$)', 1)"
_INFO = " or ".join(
    f"contains(text[1:300], '{p}') or contains(page_title, '{p}') or contains(lower(desc_meta), '{p}')"
    for p in C.INFORMATIONAL_PATTERNS
)
# The only named meta tags in the derived pages are the two descriptions.
META_STEP = (
    "o_meta",
    f"""select *, ({_INFO}) as info from (select *, coalesce(list_extract(regexp_extract_all(dom,
      '(?i)<meta name="description" content="([^"]*)"', 1), -1), '') as desc_meta from {{source}}) q""",
)


def _pages(spark, sf):
    return fx.derive(spark, sf, "fx_pages")


def _dom(spark, sf):
    return _pages(spark, sf).withColumn("dom", H.strip_hidden(F.col("html")))


def _based(spark, sf):
    hosted = _dom(spark, sf).withColumn("host", url_host(F.col("url")))
    return with_registrable_domain(hosted, "host", fx.suffixes(spark))


# --- P: features ------------------------------------------------------------
@query(
    "page_text",
    with_tables(
        ["fx_pages"], dom_steps("fx_pages"), "select page_id, page_title as title, text, len(text) as text_len from o_text"
    ),
)
def page_text(spark, sf):
    return _ints(
        _dom(spark, sf)
        .select("page_id", H.title_text("dom").alias("title"), H.visible_text("dom").alias("text"))
        .withColumn("text_len", F.length("text")),
        "text_len",
    )


@query(
    "page_tag_counts",
    with_tables(
        ["fx_pages"],
        dom_steps("fx_pages"),
        """select page_id, len(regexp_extract_all(dom, '<img ')) as images_count,
        len(regexp_extract_all(dom, '<button')) as buttons_count from o_dom""",
    ),
)
def page_tag_counts(spark, sf):
    return _ints(
        _dom(spark, sf).select(
            "page_id",
            F.expr(H.tag_count("dom", "img")).alias("images_count"),
            F.expr(H.tag_count("dom", "button")).alias("buttons_count"),
        ),
        "images_count",
        "buttons_count",
    )


def _kw_select(key: str) -> str:
    cols = ", ".join(
        f"cast({f}_n as bigint) as {f}_keywords_count, {f}_hits as {f}_keywords_hits"
        for f in C.KEYWORD_FAMILIES
    )
    return f"select {key}, {cols} from o_kw"


def _kw_view(df, key):
    counted = P.keyword_features(df, "text")
    return counted.select(
        key,
        *[F.col(f"{f}_keywords_count").cast("bigint").alias(f"{f}_keywords_count") for f in C.KEYWORD_FAMILIES],
        *[F.array_join(f"{f}_keywords_hits", ",").alias(f"{f}_keywords_hits") for f in C.KEYWORD_FAMILIES],
    )


@query(
    "page_keyword_counts",
    with_tables(
        ["fx_pages"], [*dom_steps("fx_pages"), *keyword_steps("o_text", "page_id")], _kw_select("page_id")
    ),
)
def page_keyword_counts(spark, sf):
    texts = _dom(spark, sf).select("page_id", H.visible_text("dom").alias("text"))
    return _kw_view(texts, "page_id")


_DOC_TEXT = [
    ("o_docs", f"select doc_id, lower(trim(regexp_replace(text, '{X.WHITESPACE}', ' ', 'g'))) as text from documents")
]


@query(
    "document_keyword_counts",
    with_tables([], [*_DOC_TEXT, *keyword_steps("o_docs", "doc_id")], _kw_select("doc_id")),
)
def document_keyword_counts(spark, sf):
    texts = fx.scan(spark, sf, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("text"))
    return _kw_view(texts, "doc_id")


@query(
    "page_snippets",
    with_tables(
        ["fx_pages"],
        [
            *dom_steps("fx_pages"),
            ("o_marked", f"select page_id, text, {_marked('text')} as m from o_text"),
            *snippet_steps("o_marked", "page_id"),
        ],
        "select p.page_id, coalesce(s.snippets, '') as text_snippets from fx_pages p left join o_snip s on p.page_id = s.page_id",
    ),
)
def page_snippets(spark, sf):
    texts = _dom(spark, sf).select("page_id", H.visible_text("dom").alias("text"))
    found = texts.withColumn("occ", W.occurrences(F.col("text"), P.ALL_KEYWORDS))
    return found.select(
        "page_id", F.array_join(P.text_snippets(F.col("text"), F.col("occ")), " || ").alias("text_snippets")
    )


@query(
    "page_forms",
    with_tables(
        ["fx_pages"],
        [*dom_steps("fx_pages"), *form_steps("o_dom", "page_id", BASE)],
        """select p.page_id, coalesce(forms_count, 0) as forms_count,
        round(coalesce(ext_ratio, 0), 6) as forms_external_action_ratio, coalesce(odd_n, 0) as suspicious_forms_count,
        coalesce(pw_n, 0) as password_inputs_count, coalesce(mail_n, 0) as email_inputs_count,
        coalesce(details, '') as details
        from fx_pages p left join o_forms f on p.page_id = f.page_id""",
    ),
)
def page_forms(spark, sf):
    forms = P.judged_forms(P.parsed_forms("dom"), F.col("base_domain"))
    out = P.form_aggregates(_based(spark, sf).withColumn("forms", forms))

    def show(f):
        inputs = F.transform(f["inputs"], lambda i: F.concat(i["type"], F.lit(":"), i["name"]))
        return F.concat_ws(",", f["action"], f["action_domain"], f["method"], F.array_join(inputs, ";"))

    return _ints(
        out.select(
            "page_id",
            "forms_count",
            F.round("forms_external_action_ratio", 6).alias("forms_external_action_ratio"),
            "suspicious_forms_count",
            "password_inputs_count",
            "email_inputs_count",
            F.array_join(F.transform("forms", show), " || ").alias("details"),
        ),
        "forms_count", "suspicious_forms_count", "password_inputs_count", "email_inputs_count",
    )


@query(
    "page_links",
    with_tables(
        ["fx_pages"],
        [*dom_steps("fx_pages"), (LINK_STEP[0], LINK_STEP[1].format(key="page_id", base=BASE, source="o_dom"))],
        "select page_id, round(link_ratio, 6) as external_links_ratio from o_links",
    ),
)
def page_links(spark, sf):
    ratio = P.external_ratio(P.link_hosts("dom"), F.col("base_domain"))
    return _based(spark, sf).select("page_id", F.round(ratio, 6).alias("external_links_ratio"))


@query(
    "page_meta_context",
    with_tables(
        ["fx_pages"],
        [*dom_steps("fx_pages"), (META_STEP[0], META_STEP[1].format(source="o_text"))],
        """select page_id, page_title as title, case when desc_meta = '' then '' else 'description=' || desc_meta end as meta,
        info as informational_context from o_meta""",
    ),
)
def page_meta_context(spark, sf):
    out = _dom(spark, sf).select(
        "page_id",
        H.title_text("dom").alias("title"),
        P.meta_map("dom").alias("m"),
        H.visible_text("dom").alias("text"),
    )
    entries = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select(
        "page_id",
        "title",
        F.array_join(entries, ";").alias("meta"),
        P.informational(F.col("text"), F.col("title"), F.col("m")).alias("informational_context"),
    )


MENTION_BRANDS = ("acme", "paypal", "cipriani", "therent", "on the", "tionen", "elle", "of and the")
_MENTION_ROWS = ", ".join(f"('{b}', '{mark(b)}')" for b in MENTION_BRANDS)


@query(
    "page_brand_mentions",
    with_tables(
        [],
        [
            ("o_brands", f"select * from (values {_MENTION_ROWS}) v(brand, mk)"),
            (
                "o_words",
                r"select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as word from documents",
            ),
            (
                "o_vocab",
                # DuckDB compares bytes; single-byte stand-ins make that characters.
                """select word, brand from (select distinct word from o_words), o_brands
                where jaro_winkler_similarity(translate(word, 'ßäçèéêíñóöüáú', 'ABCDEFGHIJKLM'), brand) > 0.9""",
            ),
            (
                "o_fuzzy",
                """select doc_id, brand, count(*) as n, string_agg(w.word, ',' order by w.word) as fuzzy_matches
                from o_words w join o_vocab v on w.word = v.word group by 1, 2""",
            ),
            (
                "o_exact",
                f"""select doc_id, brand, (len(m) - len(replace(m, mk, ''))) // len(mk) as n from
                (select doc_id, {_marked('lower(text)')} as m from documents) d, o_brands where contains(m, mk)""",
            ),
        ],
        """select coalesce(f.doc_id, e.doc_id) as doc_id, coalesce(f.brand, e.brand) as brand, true as present,
        coalesce(f.n, 0) + coalesce(e.n, 0) as mentions, coalesce(fuzzy_matches, '') as fuzzy_matches
        from o_fuzzy f full join o_exact e on f.doc_id = e.doc_id and f.brand = e.brand""",
    ),
)
def page_brand_mentions(spark, sf):
    names = inline_table(spark, [(b,) for b in MENTION_BRANDS], "brand")
    out = brand_mentions(fx.scan(spark, sf, "documents"), names, "doc_id", "text")
    return out.withColumn("fuzzy_matches", F.array_join(F.array_sort("fuzzy_matches"), ","))


@query(
    "page_logos",
    with_tables(
        ["fx_pages"],
        [
            *dom_steps("fx_pages"),
            (
                "o_tags",
                """select page_id, list_filter(regexp_extract_all(dom, '<img [^>]*>'), lambda t:
                regexp_matches(lower(concat_ws(' ', regexp_extract(t, 'src="([^"]*)"', 1), regexp_extract(t, 'alt="([^"]*)"', 1),
                  regexp_extract(t, 'title="([^"]*)"', 1))), 'acme|logo'))[1:5] as tags from o_dom""",
            ),
        ],
        """select page_id, array_to_string(list_transform(tags, lambda t: concat_ws(',', regexp_extract(t, 'src="([^"]*)"', 1),
          case when contains(t, 'alt="') then regexp_extract(t, 'alt="([^"]*)"', 1) end,
          case when contains(t, 'title="') then regexp_extract(t, 'title="([^"]*)"', 1) end)), ';') as logo_matches from o_tags""",
    ),
)
def page_logos(spark, sf):
    logos = P.logo_candidates(P.image_array("dom"), F.lit("acme"))
    shown = F.transform(logos, lambda i: F.concat_ws(",", i["src"], i["alt"], i["title"]))
    return _dom(spark, sf).select("page_id", F.array_join(shown, ";").alias("logo_matches"))


def _images(pages):
    """Image contents: one row per site and picture, bytes of the path."""
    roots = pages.select(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1).alias("root")).distinct()
    paths = F.explode(F.array(*[F.lit(p) for p in ("/logo.png", "/b.png", "/p.png")]))
    return roots.select("root", paths.alias("path")).select(
        F.concat("root", "path").alias("src"), F.col("path").cast("binary").alias("content")
    )


# Best similarity of a page's images to the logo; an image is the bytes of its path.
LOGO_STEPS = [
    ("o_img", "select page_id, unnest(regexp_extract_all(html, '<img [^>]*>')) as tag from fx_pages"),
    (
        "o_logo",
        """select page_id, max(1 - hamming(md5(src), md5('/logo.png')) / 32) as logo_similarity
        from (select page_id, regexp_extract(tag, 'src="([^"]*)"', 1) as src from o_img) s
        where src in ('/logo.png', '/b.png', '/p.png') group by page_id""",
    ),
]


@query(
    "logo_similarity",
    with_tables(
        ["fx_pages"],
        LOGO_STEPS,
        "select page_id, round(logo_similarity, 6) as logo_similarity from o_logo",
    ),
)
def logo_similarity(spark, sf):
    pages = _pages(spark, sf)
    shown = pages.withColumn("dom", H.strip_hidden(F.col("html"))).select(
        "page_id",
        F.lit("acme").alias("brand"),
        F.col("url").alias("final_url"),
        P.image_array("dom").alias("images"),
    )
    out = P.logo_similarity(shown, _images(pages), b"/logo.png", ["page_id"])
    return out.withColumn("logo_similarity", F.round("logo_similarity", 6))


_LISTED = " or ".join(f"(keyword = '{b}' and base_domain = '{d}')" for b, d in C.BRAND_WHITELIST)
_PLATFORM = " or ".join(f"contains(host, '{d}')" for d in C.PLATFORM_DOMAINS)


@query(
    "brand_flags",
    with_tables(
        ["fx_sites"],
        located("fx_sites"),
        f"""select page_id, contains(host, keyword) as brand_in_domain, domain_core = keyword as exact_brand_domain,
        contains(lower(regexp_extract(original_url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), keyword)
         or contains(case when len(host) > len(base_domain) then host[1:len(host) - len(base_domain) - 1] else '' end, keyword) as brand_in_path,
        ({_LISTED}) as brand_whitelisted, ({_PLATFORM}) as whitelisted_platform from o_located""",
    ),
)
def brand_flags(spark, sf):
    sites = fx.derive(spark, sf, "fx_sites").select(
        "page_id", F.col("keyword").alias("brand"), F.col("original_url").alias("url")
    )
    placed = with_registrable_domain(sites.withColumn("host", url_host(F.col("url"))), "host", fx.suffixes(spark))
    return P.brand_flags(placed).select(
        "page_id", "brand_in_domain", "exact_brand_domain", "brand_in_path", "brand_whitelisted", "whitelisted_platform"
    )


# --- G, K: scoring and triage -------------------------------------------------
_BACKED = "(pw_n > 0 or odd_n > 0 or phishing_n > 0)"
_ISSUERS = ", ".join("'" + i.replace("'", "''") + "'" for i in C.TRUSTED_ISSUERS)
_BAD_SUFFIX = ", ".join(f"'{s}'" for s in C.SUSPICIOUS_SUFFIXES)
_RULES = [
    ("exact_b", "-1.0", "'Dominio exacto de la marca (confianza)'"),
    ("not exact_b and in_dom", "-0.7", "'Marca en dominio (reduce sospecha)'"),
    ("not exact_b and not in_dom and in_path", "0.03", "'Marca en path/subdominio pero no en dominio base (posible spoof)'"),
    ("listed", "-1.0", "'Plataforma oficial / retailer (whitelist override)'"),
    ("pw_n > 0", "0.35", "'Formularios con campo password: ' || pw_n"),
    ("mail_n > 0", "0.35", "'Formularios con campo email: ' || mail_n"),
    ("odd_n > 0", "0.35", "'Formularios con campos sospechosos (e.g., card_number): ' || odd_n"),
    ("forms_n > 2", "0.2", "'Multiples formularios (' || forms_n || ')'"),
    ("ext_ratio > 0.2", "0.4 * ext_ratio", "'Ratio forms->dominios externos: ' || cast(round_even(ext_ratio, 2) as varchar)"),
    ("credential_n > 0", "0.4 * least(1, ln(1 + credential_n) / ln(6))", "'Keywords de credenciales en página: ' || credential_n"),
    (f"ecommerce_n > 0 and {_BACKED}", "0.02 * least(1, ecommerce_n / 10)", "'Keywords ecommerce junto a formularios o phishing: ' || ecommerce_n"),
    (f"urgency_n > 0 and {_BACKED}", "0.2 * least(1, urgency_n / 5)", "'Keywords de urgencia con señales fuertes: ' || urgency_n"),
    ("phishing_n >= 2", "0.45 * least(1, phishing_n / 5)", "'Keywords de phishing (múltiples o cerca de marca): ' || phishing_n"),
    ("replica_n > 0", "0.6", "'Keywords de replica/mercancía falsa: ' || replica_n"),
    ("odd_n > 0 and not platform", "0.7", "'Método de pago sospechoso (tarjeta directa sin pasarela confiable)'"),
    ("true", "0.4", "'Información de contacto insuficiente o email gratuito'"),
    (f"suffix in ({_BAD_SUFFIX})", "0.25", "'TLD sospechoso: .' || suffix"),
    ("typo > 0.5", "0.5 * least(1, typo)", "'Similitud tipográfica con marca: ' || cast(round_even(typo, 2) as varchar)"),
    ("link_ratio > 0.6", "0.25", "'Alta proporción de enlaces externos (posible redirección/affiliate)'"),
    ("text_len < 200 and forms_n > 0", "0.3", "'Poca cantidad de texto frente a formularios (página muy simple)'"),
    ("info", "-0.5", "'Contenido claramente educativo/informativo (reduce sospecha)'"),
    ("platform", "-1.0", "'Plataforma oficial / retailer (whitelist override)'"),
    ("not https", "0.3", "'Sin HTTPS'"),
    ("age < 180", "0.4", "'Domini o joven: ' || age || ' días'"),
    ("not ssl_valid", "0.45", "'SSL inválido o ausente'"),
    ("ssl_age_days < 30 and age < 90", "0.3", "'Cert SSL joven: ' || ssl_age_days || ' días'"),
    (f"ssl_issuer not in ({_ISSUERS})", "0.35", "'Emisor SSL no confiable: ' || ssl_issuer"),
    ("images_n > 20 and text_len < 1000", "0.3", "'Alta cantidad de imágenes con poco texto (posible fake shop)'"),
]
_LEGIT = "(exact_b or platform or (logo > 0.8 and coalesce(age, 0) > 365 and coalesce(ssl_valid, false)))"
_LEGIT_NOTE = "Override: Señales legit fuertes (dominio viejo, SSL válido, logo match)"


# Rules whose inputs come from elsewhere: several brands, and the known logo.
_KNOWN_RULES = [
    ("multi_brand", "0.5", "'Inventario con múltiples marcas no relacionadas (scam típico)'"),
    ("logo > 0.8", "-0.4", "'Logo similar detectado (sim: ' || cast(round_even(logo, 2) as varchar) || ')'"),
]


def _sum_of(rules) -> str:
    return " + ".join(f"case when coalesce({c}, false) then {w} else 0 end" for c, w, _ in rules)


def _reasons_of(rules) -> str:
    return "[" + ", ".join(f"case when coalesce({c}, false) then {r} end" for c, _, r in rules) + "]"


def page_score_steps(logo: str = "0", multi_brand: str = "false") -> list[tuple[str, str]]:
    """Scores of the fetched pages of ``fx_fetch``, with SQL for the inputs from elsewhere."""
    rules = [*_RULES, *_KNOWN_RULES]
    return [
        ("o_ok", "select *, brand as keyword from fx_fetch where status = 200 and trim(html) <> ''"),
        *located("o_ok", "url"),
        *dom_steps("o_located"),
        (META_STEP[0], META_STEP[1].format(source="o_text")),
        *keyword_steps("o_meta", "page_id"),
        *form_steps("o_dom", "page_id", "base_domain"),
        (LINK_STEP[0], LINK_STEP[1].format(key="page_id", base="base_domain", source="o_dom")),
        (O_TLS[0], O_TLS[1].format(source="o_kw")),
        (
            "o_feat",
            f"""select t.*, len(text) as text_len, coalesce(f.forms_count, 0) as forms_n, coalesce(f.ext_ratio, 0) as ext_ratio,
            coalesce(f.odd_n, 0) as odd_n, coalesce(f.pw_n, 0) as pw_n, coalesce(f.mail_n, 0) as mail_n, f.details,
            {logo} as logo, {multi_brand} as multi_brand, l.link_ratio, len(regexp_extract_all(t.dom, '<img ')) as images_n,
            datediff('day', cast(nullif(regexp_extract(w.response_text, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '') as date), date '2025-01-01') as age,
            t.domain_core = t.brand as exact_b, contains(t.host, t.brand) as in_dom,
            contains(lower(regexp_extract(t.url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), t.brand)
              or contains(t.host[1:len(t.host) - len(t.base_domain)], t.brand) as in_path,
            ({_LISTED}) as listed, ({_PLATFORM}) as platform,
            case when t.domain_core = t.brand then 0 else 0.6 * (1 - levenshtein(t.brand, t.domain_core)
              / greatest(length(t.brand), length(t.domain_core))) + 0.4 * jaro_winkler_similarity(t.brand, t.domain_core) end as typo
            from o_tls t left join o_forms f on t.page_id = f.page_id join o_links l on t.page_id = l.page_id
            left join fx_whois w on t.base_domain = w.domain""",
        ),
        (
            "o_sum",
            f"""select *, 1 / (1 + exp(-3 * cast({_sum_of(rules)} as double))) as raw,
            list_filter({_reasons_of(rules)}, lambda x: x is not null) as rs from o_feat""",
        ),
        (
            "o_pscored",
            f"""select *, round(case when {_LEGIT} then greatest(0, raw - 0.5) else raw end, 4) as score,
            array_to_string(list_sort(list_distinct(case when {_LEGIT} then rs || ['{_LEGIT_NOTE}'] else rs end)), ' | ') as reasons
            from o_sum""",
        ),
    ]


_CATEGORY = "case when score >= 0.7 then 'phishing' when score >= 0.3 then 'suspect' else 'legit' end"
_PAGE_TABLES = ["fx_fetch", "fx_whois", "fx_tls"]


def _whois(spark, sf):
    return T.whois_ages(D.extract_whois(fx.derive(spark, sf, "fx_whois"), fx.AS_OF))


@query(
    "page_score",
    with_tables(
        _PAGE_TABLES,
        page_score_steps(),
        f"select page_id, brand, score, {_CATEGORY} as category, reasons from o_pscored",
    ),
)
def page_score(spark, sf):
    pages = P.with_fetch_status(fx.derive(spark, sf, "fx_fetch")).filter("ok")
    features = P.page_features(pages, fx.suffixes(spark)).join(_whois(spark, sf), "base_domain", "left")
    known = D.tls_status(features, fx.tls(spark, sf), fx.AS_OF)
    return score_page(known).select(
        "page_id", "brand", "score", "category", F.array_join("reasons", " | ").alias("reasons")
    )


_FAILED = """select page_id, url, brand, cast(0 as double) as score, cast(null as varchar) as category,
 'No se pudo recuperar HTML: ' || coalesce(error, 'HTTP ' || coalesce(cast(status as varchar), 'None')) as reasons
 from fx_fetch where coalesce(status, 0) <> 200 or trim(html) = ''"""


def _analyzed(spark, sf):
    pages = fx.derive(spark, sf, "fx_fetch")
    # Two records without a brand per hundred pages stand for failing ones.
    broken = F.when(F.col("page_id") % 100 >= 2, F.col("brand"))
    return T.analyze_pages(
        pages.withColumn("brand", broken),
        _whois(spark, sf),
        fx.tls(spark, sf),
        fx.AS_OF,
        suffixes=fx.suffixes(spark),
    )


_ALL_PAGES = f"""select page_id, url, case when page_id % 100 >= 2 then brand end as brand,
 case when page_id % 100 < 2 then 0 else score end as score,
 case when page_id % 100 < 2 then 'error' else category end as category,
 case when page_id % 100 < 2 then 'Error en análisis: url o marca ausente' else reasons end as reasons
 from (select page_id, url, brand, score, {_CATEGORY} as category, reasons from o_pscored union all {_FAILED}) u"""


def _fetched_images(pages):
    return _images(pages.select(F.col("final_url").alias("url")))


_FETCHED_LOGO = [
    (LOGO_STEPS[0][0], LOGO_STEPS[0][1].replace("fx_pages", "fx_fetch")),
    LOGO_STEPS[1],
]
_LOGO_OF_PAGE = "coalesce((select g.logo_similarity from o_logo g where g.page_id = t.page_id), 0)"


@query(
    "page_score_brands",
    with_tables(
        _PAGE_TABLES,
        page_score_steps(multi_brand="t.page_id % 6 = 0"),
        f"select page_id, brand, score, {_CATEGORY} as category, reasons from o_pscored",
    ),
)
def page_score_brands(spark, sf):
    """Pages of which another analysis says whether they show several brands."""
    pages = P.with_fetch_status(fx.derive(spark, sf, "fx_fetch")).filter("ok")
    features = P.page_features(pages, fx.suffixes(spark)).join(_whois(spark, sf), "base_domain", "left")
    known = D.tls_status(features, fx.tls(spark, sf), fx.AS_OF)
    return score_page(known.withColumn("multi_brand_detected", F.col("page_id") % 6 == 0)).select(
        "page_id", "brand", "score", "category", F.array_join("reasons", " | ").alias("reasons")
    )


@query(
    "page_triage_logo",
    with_tables(
        _PAGE_TABLES,
        [*_FETCHED_LOGO, *page_score_steps(logo=_LOGO_OF_PAGE)],
        f"select page_id, brand, score, {_CATEGORY} as category, reasons from o_pscored",
    ),
)
def page_triage_logo(spark, sf):
    """Fetched pages whose images are compared with a known logo, ranked."""
    pages = fx.derive(spark, sf, "fx_fetch")
    analyzed = T.analyze_pages(
        pages,
        _whois(spark, sf),
        fx.tls(spark, sf),
        fx.AS_OF,
        suffixes=fx.suffixes(spark),
        images=_fetched_images(pages),
        known_logo=b"/logo.png",
    )
    return T.rank_pages(analyzed.filter("ok"), min_score_filter=0.0).select(
        "page_id", "brand", "score", "category", F.array_join("reasons", " | ").alias("reasons")
    )


@query(
    "page_triage",
    with_tables(
        _PAGE_TABLES,
        [*page_score_steps(), ("o_all", _ALL_PAGES)],
        "select page_id, url, brand, score, category, reasons from o_all where score >= 0.3 or category = 'error'",
    ),
)
def page_triage(spark, sf):
    return T.rank_pages(_analyzed(spark, sf)).select(
        "page_id", "url", "brand", "score", "category", F.array_join("reasons", " | ").alias("reasons")
    )


@query(
    "page_fetch_failures",
    with_tables(
        _PAGE_TABLES,
        [*page_score_steps(), ("o_all", _ALL_PAGES)],
        """select page_id, score, category, reasons, 0 as snippets, 0 as forms from o_all
        where score = 0 and reasons not like '%|%'""",
    ),
)
def page_fetch_failures(spark, sf):
    """Failed and unusable records as they appear with no minimum score."""
    every = T.rank_pages(_analyzed(spark, sf), 0.0)
    failed = every.filter((F.col("score") == 0) & (F.size("reasons") == 1))
    return failed.select(
        "page_id", "score", "category", F.array_join("reasons", " | ").alias("reasons"),
        F.size("content_analysis.text_snippets").alias("snippets"),
        F.size("content_analysis.forms_details").alias("forms"),
    )


@query(
    "page_report",
    with_tables(
        _PAGE_TABLES,
        page_score_steps(),
        f"""select url, score, {_CATEGORY} as category, reasons, base_domain, ssl_valid, age as domain_age_days
        from o_pscored where score >= 0.3 order by score desc, url, brand limit 30""",
    ),
)
def page_report(spark, sf):
    ranked = T.triage_pages(
        fx.derive(spark, sf, "fx_fetch"), _whois(spark, sf), fx.tls(spark, sf), fx.AS_OF, suffixes=fx.suffixes(spark)
    )
    return _ints(
        T.top_report(ranked).select(
            "url", "score", "category", F.array_join("reasons", " | ").alias("reasons"),
            "base_domain", "ssl_valid", "domain_age_days",
        ),
        "domain_age_days",
    )
