"""URL columns: host, registered domain, parameters, unwrapping, building."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimscope.rules import ICON_URL, SECOND_LEVELS

_TWO_LEVELS = rf"^(?:{'|'.join(SECOND_LEVELS)})\.[a-z]{{2}}$"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host(url: Column) -> Column:
    """The lower-case host; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def registered_domain(url: Column) -> Column:
    """Public suffix and one label before it; the host itself where it is an address or a single label.

    The suffix is the last label, or the last two where a registry's second level stands before a country code. By a
    table of suffixes: ``operators.domains.registered``.
    """
    own = host(url)
    two, three = F.substring_index(own, ".", -2), F.substring_index(own, ".", -3)
    return F.when(own.rlike(r"^[0-9.]+$"), own).when(two.rlike(_TWO_LEVELS), three).otherwise(two)


def absolute(link: Column, origin: Column) -> Column:
    """A link that starts with ``./``, put behind the origin; only its first ``./`` goes."""
    at = F.instr(link, "./")
    return F.concat(origin, F.when(at > 0, F.concat(link.substr(F.lit(1), at - 1), link.substr(at + 2, F.length(link)))).otherwise(link))


def unwrapped(link: Column, prefix: str) -> Column:
    """The target of a redirect link: decoded, without the tracking parameter, without the prefix."""
    plain = F.replace(F.url_decode(link), F.lit(prefix), F.lit(""))
    return F.regexp_replace(plain, r"[?&]fbclid=.*$", "")


def parameters(url: Column) -> Column:
    """Array of (name, value) of the query string in order; ``+`` is a space, a missing ``=`` gives a null value."""
    query = F.replace(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("+"), F.lit(" "))
    pair = F.filter(F.split(query, "&"), lambda x: x != "")
    cut = lambda x: F.instr(x, "=")
    return F.transform(
        pair,
        lambda x: F.struct(
            F.try_url_decode(F.when(cut(x) > 0, x.substr(F.lit(1), cut(x) - 1)).otherwise(x)).alias("name"),
            F.when(cut(x) > 0, F.try_url_decode(x.substr(cut(x) + 1, F.length(x)))).alias("value"),
        ),
    )


def parameter_map(url: Column) -> Column:
    """Map of names to arrays of all their values, in order."""
    pairs = parameters(url)
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.transform(F.filter(pairs, lambda p: p["name"] == n), lambda p: p["value"]).alias("value"))))


def search_url(base: str, keywords: Column) -> Column:
    """A search address with the keywords as they are, not encoded."""
    return F.concat(F.lit(base), keywords)


def encoded_search_url(base: str, **params: Column) -> Column:
    """A search address with encoded parameters."""
    parts = [F.concat(F.lit(f"{k}="), F.url_encode(v)) for k, v in params.items()]
    return F.concat(F.lit(base), F.array_join(F.array(*parts), "&"))


def narrowed_query(query: Column, marker: str, width: int = 5) -> Column:
    """The first characters of a query, or its last ones if it holds the marker."""
    return F.when(F.contains(query, F.lit(marker)), F.right(query, F.lit(width))).otherwise(F.left(query, F.lit(width)))


def class_selector(classes: Column) -> Column:
    """A class attribute as a CSS selector."""
    return F.replace(classes, F.lit(" "), F.lit("."))


def icon(url: Column) -> Column:
    """Address of the icon of a result's host."""
    return F.concat(F.lit(ICON_URL), host(url))
