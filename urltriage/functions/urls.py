"""URL parts, normalization and reference resolution as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*"


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.ltrim(url), rf"^({_SCHEME}):", 1))


def url_netloc(url: Column) -> Column:
    return F.regexp_extract(F.ltrim(url), rf"^(?:{_SCHEME}:)?//([^/?#]*)", 1)


def url_host(url: Column) -> Column:
    """Lowercased host without user info, port and IPv6 brackets."""
    host = F.regexp_extract(
        F.ltrim(url), rf"^(?:{_SCHEME}:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#]*)", 1
    )
    return F.lower(F.trim(F.translate(host, "[]", "")))


def url_raw_path(url: Column) -> Column:
    return F.regexp_extract(F.ltrim(url), rf"^(?:{_SCHEME}:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_path(url: Column) -> Column:
    """Path without query, fragment and parameters of the last segment."""
    return F.regexp_replace(url_raw_path(url), r";[^/]*$", "")


def is_https_scheme(url: Column) -> Column:
    return url_scheme(url) == "https"


def starts_with_https(url: Column) -> Column:
    return F.startswith(F.lower(F.trim(url)), F.lit("https"))


def with_url_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add scheme, netloc, host, path and both HTTPS flags."""
    u = F.coalesce(F.col(url_col), F.lit(""))
    return df.withColumns(
        {
            "scheme": url_scheme(u),
            "netloc": F.lower(url_netloc(u)),
            "host": url_host(u),
            "path": F.lower(url_path(u)),
            "is_https": is_https_scheme(u),
            "starts_https": starts_with_https(u),
        }
    )


def normalize_url(url: Column, keep_query: bool = False) -> Column:
    """Key under which two spellings of a URL count as the same.

    Lowercased scheme and host; no user info, default port, fragment, query
    (unless kept) or trailing slash.
    """
    u = F.regexp_replace(F.trim(url), "#.*$" if keep_query else "[?#].*$", "")
    u = F.regexp_replace(u, rf"^({_SCHEME}:)?//[^/?#]*@", "$1//")
    u = F.regexp_replace(u, r"(?i)^(http://[^/?#]*):80(?=[/?]|$)|^(https://[^/?#]*):443(?=[/?]|$)", "$1$2")
    u = F.regexp_replace(u, r"/+(?=[?]|$)" if keep_query else "/+$", "")
    root = rf"^(?:{_SCHEME}:)?//[^/?#]*"
    return F.concat(F.lower(F.regexp_extract(u, root, 0)), F.regexp_replace(u, root, ""))


def with_normalized_url(
    df: DataFrame, url_col: str = "original_url", keep_query: bool = False
) -> DataFrame:
    return df.withColumn("normalized_url", normalize_url(F.col(url_col), keep_query))


def reference_host(ref: Column, base_host: Column | None = None) -> Column:
    """Host a link leads to; relative links give the base host (or blank)."""
    r = F.ltrim(ref)
    relative = F.lit("") if base_host is None else base_host
    foreign_scheme = url_scheme(r)
    return (
        F.when(F.coalesce(r, F.lit("")) == "", F.lit(""))
        .when(r.rlike(rf"^(?:{_SCHEME}:)?//"), url_host(r))
        .when((foreign_scheme != "") & (foreign_scheme != "https"), F.lit(""))
        .otherwise(relative)
    )


def _drop_dot_segments(path: Column) -> Column:
    segments = F.split(path, "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    trailing = F.when(path.rlike(r"/[.]{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"(^|/)[.]{1,2}(/|$)"), F.concat(F.array_join(kept, "/"), trailing)).otherwise(
        path
    )


def resolve_url(base: Column, ref: Column) -> Column:
    """Absolute URL of a link found on page ``base``."""
    r, b = F.trim(ref), F.trim(base)
    scheme = url_scheme(b)
    root = F.concat(scheme, F.lit("://"), url_netloc(b))
    base_path = url_raw_path(b)
    directory = F.regexp_replace(base_path, r"[^/]*$", "")
    directory = F.when(directory == "", F.lit("/")).otherwise(directory)
    path, tail = F.regexp_extract(r, r"^([^?#]*)", 1), F.regexp_extract(r, r"([?#].*)$", 1)
    absolute_path = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(directory, path))
    return (
        F.when(F.coalesce(r, F.lit("")) == "", b)
        .when(url_scheme(r) != "", r)
        .when(F.startswith(r, F.lit("//")), F.concat(scheme, F.lit(":"), r))
        .when(F.startswith(r, F.lit("?")), F.concat(root, base_path, r))
        .when(F.startswith(r, F.lit("#")), F.concat(F.regexp_extract(b, r"^([^#]*)", 1), r))
        .otherwise(F.concat(root, _drop_dot_segments(absolute_path), tail))
    )
