"""Pieces of SQL the checks share."""

from __future__ import annotations

PARTS = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://([^/?#]*))?([^?#]*)"


def normal(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"


def host(x: str) -> str:
    return f"lower(regexp_extract({x}, '{PARTS}', 1))"


def url_normal(x: str) -> str:
    path = f"regexp_replace(regexp_replace(regexp_extract({x}, '{PARTS}', 2), ';[^/]*$', ''), '/+$', '')"
    return f"(regexp_replace({host(x)}, '^www\\.', '') || {path})"


def with_ctes(*parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts)
