"""URL parts, normal form, classes and resolution of relative links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://([^/?#]*))?([^?#]*)"


def _with_slashes(url: Column) -> Column:
    return F.when(url.contains("//"), url).otherwise(F.concat(F.lit("//"), url))


def authority(url: Column) -> Column:
    """Host and port in lower case; empty for a URL without one."""
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def domain(url: Column) -> Column:
    return F.regexp_replace(authority(url), "^www\\.", "")


def url_normal(url: Column, keep_query: bool = False) -> Column:
    """Host without ``www.`` plus path without closing slashes.

    Scheme, query and fragment are dropped. ``keep_query`` keeps the query but for
    its ``utm_`` parameters, for sites that tell pages apart by it.
    """
    full = _with_slashes(url)
    path = F.regexp_replace(F.regexp_replace(path_of(full), ";[^/]*$", ""), "/+$", "")
    base = F.concat(domain(full), path)
    if not keep_query:
        return base
    query = F.regexp_extract(full, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")), "&"
    )
    return F.when(kept == "", base).otherwise(F.concat_ws("?", base, kept))


def url_kind(url: Column) -> Column:
    """Company, person, job or other page of a professional network."""
    return (
        F.when(url.rlike("(?i)/company/[^/?#]+"), "company")
        .when(url.rlike("(?i)/in/[^/?#]+"), "person")
        .when(url.contains("/jobs/"), "job")
        .otherwise("other")
    )


def url_route(url: Column) -> Column:
    """Which channel reads a URL: the professional network's host, or the open web."""
    host = F.regexp_replace(authority(url), ":\\d+$", "")
    return F.when(host.rlike("(^|\\.)linkedin\\.com$"), "linkedin").otherwise("web")


def _without_dots(path: Column) -> Column:
    """``.`` and ``..`` segments applied, as a browser does."""
    parts = F.split(path, "/")
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda seen, part: F.when(part == ".", seen)
        .when(part == "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(1))))
        .otherwise(F.concat(seen, F.array(part))),
    )
    closing = F.when(path.rlike("/\\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    tidy = F.concat(F.array_join(walked, "/"), closing)
    return F.when(path.rlike("(^|/)\\.{1,2}(/|$)"), tidy).otherwise(path)


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link found on the page ``base``."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(page, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*", ""), "^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    target = F.regexp_extract(href, r"^([^?#]*)", 1)
    tail = F.substring(href, F.length(target) + 1, F.length(href))
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, _without_dots(target), tail))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, "^([^#]*)", 1), href))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, target)), tail))
    )
