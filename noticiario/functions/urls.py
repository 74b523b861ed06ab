"""URL expressions: absolute links and the tests that accept or reject a link."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def absolutise(href: Column, base: Column | str) -> Column:
    """Relative link -> base + link; a link starting with ``http`` is kept."""
    base = F.lit(base) if isinstance(base, str) else base
    return F.when(href.startswith("http"), href).otherwise(F.concat(base, href))


def absolutise_rooted(href: Column, base: Column | str) -> Column:
    """As :func:`absolutise`, but only links starting with ``/`` get the base."""
    base = F.lit(base) if isinstance(base, str) else base
    return F.when(href.startswith("/"), F.concat(base, href)).otherwise(href)


def has_prefix(href: Column, base: str) -> Column:
    return href.startswith(base)


def in_domain(href: Column, domain: str) -> Column:
    return href.contains(domain)


def is_excluded(href: Column, fragments: Sequence[str]) -> Column:
    """True when the link holds any of the path fragments."""
    found = F.lit(False)
    for fragment in fragments:
        found = found | href.contains(fragment)
    return found


def is_external(href: Column, base: str) -> Column:
    """Absolute link that does not hold the base of its site."""
    return href.startswith("http") & ~href.contains(base)


def segments(href: Column) -> Column:
    """Non-empty path segments of a relative link."""
    return F.filter(F.split(href, "/"), lambda part: part != "")


def is_article(href: Column, min_segments: int, year_segment: int | None = None) -> Column:
    """Relative link with enough segments and, if asked, a year 2000-2030 in place
    ``year_segment`` (counted from 1).
    """
    parts = segments(href)
    ok = href.startswith("/") & (F.size(parts) >= min_segments)
    if year_segment is not None:
        year = F.get(parts, F.lit(year_segment - 1))
        ok = ok & F.coalesce(year.rlike("^[+]?0*(20[0-2][0-9]|2030)$"), F.lit(False))
    return F.coalesce(ok, F.lit(False))
