"""Text, list, date and number helpers as Column expressions."""

from __future__ import annotations

import re
from datetime import datetime
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that counts as such in a page's text.
_SPACES = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WHITESPACE = f"[{_SPACES}]+"
# The same, arranged for speed: plain letters fail the first cheap class, and a
# single blank, which needs no replacement, is not matched at all.
_COLLAPSIBLE = rf"(?:[^!-~](?<=[{_SPACES}])){{2,}}+|[^ -~](?<=[{_SPACES}])"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
TOKEN_SEPARATORS = r"[\s\-/?&=_.,:;!]+"
BRAND_SEPARATORS = r"[\s\-/._]+"

# Named character references that are decoded.
NAMED_ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&",
    "&copy;": "©", "&reg;": "®", "&trade;": "™", "&euro;": "€", "&pound;": "£", "&yen;": "¥",
    "&cent;": "¢", "&middot;": "·", "&bull;": "•", "&hellip;": "…", "&ndash;": "–",
    "&mdash;": "—", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”",
    "&laquo;": "«", "&raquo;": "»", "&iexcl;": "¡", "&iquest;": "¿", "&deg;": "°",
    "&aacute;": "á", "&eacute;": "é", "&iacute;": "í", "&oacute;": "ó", "&uacute;": "ú",
    "&ntilde;": "ñ", "&uuml;": "ü", "&Aacute;": "Á", "&Eacute;": "É", "&Iacute;": "Í",
    "&Oacute;": "Ó", "&Uacute;": "Ú", "&Ntilde;": "Ñ", "&Uuml;": "Ü", "&agrave;": "à",
    "&egrave;": "è", "&ccedil;": "ç", "&ecirc;": "ê", "&ocirc;": "ô", "&auml;": "ä",
    "&ouml;": "ö", "&szlig;": "ß",
}
_NAMES = "\x02".join(f"{k[1:-1]}\x01{v}" for k, v in NAMED_ENTITIES.items())


def sql_text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_array(values) -> str:
    return "array(" + ", ".join(sql_text(v) for v in values) + ")"


def text_array(values) -> Column:
    """Array literal of strings (typed also when empty)."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def collapse_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _COLLAPSIBLE, " "))


def normalize_text(c: Column) -> Column:
    return F.coalesce(F.lower(collapse_whitespace(c)), F.lit(""))


def decode_entities_sql(c: str) -> str:
    """Decode character references in one left-to-right pass (never twice).

    The text is cut at its ampersands; each later piece starts with a candidate
    reference that ends at its first semicolon.
    """
    names = f"str_to_map({sql_text(_NAMES)}, '\\u0002', '\\u0001')"
    code = (
        "CASE WHEN r.n RLIKE '^#[xX][0-9a-fA-F]{1,7}$' THEN try_cast(conv(substring(r.n, 3), 16, 10) AS INT) "
        "WHEN r.n RLIKE '^#[0-9]{1,7}$' THEN try_cast(substring(r.n, 2) AS INT) END"
    )
    numeric = (
        f"CASE WHEN r.n LIKE '#%' AND ({code}) BETWEEN 1 AND 1114111 AND NOT ({code}) BETWEEN 55296 AND 57343 "
        f"THEN decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32') END"
    )
    rest = "substring(r.p, length(r.n) + 2)"
    piece = (
        "get(transform(array(named_struct('p', p, 'n', substring_index(p, ';', 1))), r -> "
        f"CASE WHEN length(r.n) = length(r.p) THEN concat('&', r.p) ELSE coalesce("
        f"concat(try_element_at({names}, r.n), {rest}), concat({numeric}, {rest}), concat('&', r.p)) END), 0)"
    )
    pieces = f"transform(split({c}, '&'), (p, i) -> CASE WHEN i = 0 THEN p ELSE {piece} END)"
    return f"CASE WHEN contains({c}, '&') THEN array_join({pieces}, '') ELSE {c} END"


def clean_list(c: Column) -> Column:
    """Null becomes the empty list; entries are trimmed and blanks dropped."""
    trimmed = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x))
    return F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))


def list_from_scalar(c: Column) -> Column:
    return clean_list(F.array(c))


def list_to_json(c: Column) -> Column:
    return F.to_json(F.coalesce(c, F.array().cast("array<string>")))


def list_from_json(c: Column) -> Column:
    """JSON text to a list; text that is no JSON array becomes a one-entry list."""
    parsed = F.from_json(c, "array<string>", {"mode": "PERMISSIVE"})
    looks_like_array = F.startswith(F.ltrim(c), F.lit("["))
    entries = F.filter(parsed, lambda x: x.isNotNull() & (x != ""))
    return (
        F.when(c.isNull() | (c == ""), F.array().cast("array<string>"))
        .when(looks_like_array & parsed.isNotNull(), entries)
        .otherwise(F.array(c))
    )


# Accepted date layouts, in order of trial.
DATE_LAYOUTS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy")
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d{1,6})?)?([+-]\d{2}:?\d{2})?)?$"


def normalize_date(c: Column) -> Column:
    """Text to timestamp: ISO first, then the fixed layouts; null when none fits."""
    plain = F.regexp_replace(c, "Z", "")
    no_fraction = F.element_at(F.split(c, "[.]"), 1)
    tries = [F.try_to_timestamp(no_fraction, F.lit(fmt)) for fmt in DATE_LAYOUTS]
    iso = F.when(plain.rlike(_ISO), plain.try_cast("timestamp"))
    return F.coalesce(iso, *tries)


def first_date(c: Column) -> Column:
    """Date from a list of texts: only the first entry counts."""
    return normalize_date(F.get(c, 0))


def as_timestamp(as_of) -> Column:
    """A fixed evaluation instant; nothing in this package reads the clock."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, datetime):
        as_of = as_of.isoformat(sep=" ")
    return F.lit(as_of).cast("timestamp")


def whole_days(later: Column, earlier: Column) -> Column:
    """Completed days between two instants (floor, so negative ages round down)."""
    seconds = F.unix_timestamp(later) - F.unix_timestamp(earlier)
    return F.floor(seconds / F.lit(86400)).cast("int")


def sigmoid_sql(c: str, steepness: float = 3.0) -> str:
    return f"greatest(0D, least(1D, 1D / (1D + exp(-{steepness}D * ({c})))))"


def log_damped_sql(count: str, full_at: int = 6) -> str:
    return f"least(1D, log1p({count}) / ln({full_at}D))"


def linear_damped_sql(count: str, full_at: int) -> str:
    return f"least(1D, {count} / {full_at}D)"


def two_decimals_sql(c: str) -> str:
    """Number text as it appears inside reasons: 0.5, 0.33, 1.0."""
    return f"CAST(bround({c}, 2) AS STRING)"


def word_tokens(c: Column, separators: str = TOKEN_SEPARATORS) -> Column:
    """Distinct nonblank tokens of a lowercased text."""
    return F.array_remove(F.array_distinct(F.split(F.lower(c), separators)), "")


def alternation(words) -> str:
    """Pattern that finds any of the fixed words as a plain substring.

    Words with the same first character share a branch, so most positions of a
    text are dismissed after a few comparisons.
    """
    ordered = sorted(set(words))
    branches = [
        re.escape(first) + "(?:" + "|".join(re.escape(w[1:]) for w in group) + ")"
        for first, group in groupby(ordered, key=lambda w: w[0])
    ]
    return "|".join(branches)


def contains_any(c: Column, words) -> Column:
    """True when any of the fixed words is a plain substring."""
    return c.rlike(alternation(words)) if words else F.lit(False)


def contains_any_sql(c: str, words) -> str:
    return f"{c} RLIKE {sql_text(alternation(words))}"
