"""Tags, attributes and visible text of HTML, as SQL text.

Patterns that repeat a group use possessive repetition: it runs as a loop, so
a hostile page with a very long tag cannot exhaust a task's stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from urltriage.functions.text import decode_entities_sql, normalize_text, sql_text

_ATTRIBUTES = r"""(?:[^'">]++|"[^"]*"|'[^']*')*+"""
_ATTRIBUTE = r"""[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?"""
HIDDEN = (
    r"(?is)<(?:!--.*?(?:-->|\z)|script\b[^>]*>.*?(?:</script\s*>|\z)"
    r"|style\b[^>]*>.*?(?:</style\s*>|\z))"
)
TAG = rf"(?is)<(?:/?[a-z]{_ATTRIBUTES}>|/?[a-z][^>]*>|[!?][^>]*>)"


def strip_hidden(html: Column) -> Column:
    """Page without comments and without script and style elements."""
    return F.regexp_replace(html, HIDDEN, " ")


def visible_text(dom: str) -> Column:
    """Normalized, lowercased text of a page freed of hidden parts."""
    # A one-entry array names the tagless text, so it is built once.
    untagged = f"array(regexp_replace({dom}, {sql_text(TAG)}, ' '))"
    return normalize_text(F.expr(f"get(transform({untagged}, t -> {decode_entities_sql('t')}), 0)"))


def title_text(dom: str) -> Column:
    title = f"array(regexp_extract({dom}, {sql_text(r'(?is)<title\b[^>]*>(.*?)</title\s*>')}, 1))"
    plain = f"CASE WHEN t RLIKE '<[a-zA-Z]' THEN '' ELSE {decode_entities_sql('t')} END"
    return normalize_text(F.expr(f"get(transform({title}, t -> {plain}), 0)"))


def tag_count(dom: str, tag: str) -> str:
    return f"regexp_count({dom}, {sql_text(rf'(?i)<{tag}(?=[\s/>])')})"


def split_attributes(text: str) -> str:
    return f"regexp_extract_all({text}, {sql_text(_ATTRIBUTE)}, 0)"


def tag_attributes(html: str, tag: str) -> str:
    """One array of ``name=value`` texts per start tag, in page order."""
    pattern = rf"(?is)<{tag}(?=[\s/>])({_ATTRIBUTES})>"
    tags = f"regexp_extract_all({html}, {sql_text(pattern)}, 1)"
    return f"transform({tags}, ta -> {split_attributes('ta')})"


def attribute(attributes: str, name: str) -> str:
    """Value of an attribute (last one wins), null when the tag lacks it."""
    named = sql_text(rf"(?i)^{name}\s*(=|$)")
    value = sql_text(r"""(?s)^[^=]*=?\s*(["']?)(.*)\1$""")
    last = f"try_element_at(filter({attributes}, aa -> aa RLIKE {named}), -1)"
    raw = f"array(regexp_replace({last}, {value}, '$2'))"
    return f"get(transform({raw}, av -> {decode_entities_sql('av')}), 0)"


def forms(dom: str) -> str:
    """One text per form, from its attributes up to its end or the next form."""
    pieces = f"split({dom}, {sql_text(r'(?i)<form(?=[\s/>])')})"
    return (
        f"transform(filter({pieces}, (fp, fi) -> fi > 0), "
        f"fp -> get(split(fp, {sql_text(r'(?i)</form')}, 2), 0))"
    )


def form_attributes(form: str) -> str:
    return split_attributes(f"regexp_extract({form}, {sql_text(rf'(?s)^({_ATTRIBUTES})>')}, 1)")
