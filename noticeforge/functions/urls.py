"""URL functions as Catalyst expressions (no Python in the hot path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track, and those that only hold the listing's context.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid")
LISTING_CONTEXT = ("article.offset", "articlelimit")

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$"


def _kept(name: Column, drop: tuple[str, ...]) -> Column:
    low = F.lower(name)
    return ~low.startswith("utm_") & ~low.isin(*drop)


def normalize_url(url: Column, drop: tuple[str, ...] = TRACKING, root: str = "") -> Column:
    """The comparison form of a URL; null stays null, a text that is no URL is treated as a path.

    Scheme and host in lower case, no slash at the end of the path (an empty path becomes `root`), no fragment, tracking
    parameters dropped, the others sorted by name and value. Percent escapes stay as written.
    """
    url = F.trim(url)
    part = lambda i: F.regexp_extract(url, _PARTS, i)
    name = lambda p: F.split_part(p, F.lit("="), F.lit(1))
    pairs = F.filter(F.split(part(4), "&"), lambda p: (p != "") & _kept(name(p), drop))
    # (name, whole pair) sorts as (name, value) does: pairs of one name share the prefix "name=".
    query = F.array_join(F.transform(F.array_sort(F.transform(pairs, lambda p: F.struct(name(p).alias("n"), p.alias("p")))), lambda s: s["p"]), "&")
    scheme, host, path = F.lower(part(1)), F.lower(part(2)), F.regexp_replace(part(3), "/+$", "")
    plain = F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(url.rlike("^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//"), F.concat(F.lit("//"), host)).otherwise(""),
        F.when(path != "", path).otherwise(root),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )
    return F.when(url.isNotNull(), plain)


def normalize_detail_url(url: Column) -> Column:
    """normalize_url without the parameters that only carry the listing's context."""
    return normalize_url(url, TRACKING + LISTING_CONTEXT, "/")


def origin(url: Column) -> Column:
    """scheme://host[:port] in lower case, or null if there is no host."""
    host = F.lower(F.regexp_extract(url, _PARTS, 2))
    return F.when(host != "", F.concat(F.lower(F.regexp_extract(url, _PARTS, 1)), F.lit("://"), host))


def website(url: Column) -> Column:
    """The host without case, user, port and leading www.; null if there is none."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), _PARTS, 2)), "^.*@", ""), ":\\d*$", "")
    host = F.regexp_replace(host, "^www\\.", "")
    return F.when(host != "", host)


def url_pattern(url: Column) -> Column:
    """The URL with every run of digits as '#'."""
    return F.regexp_replace(url, "\\d+", "#")


def host(url: Column) -> Column:
    """The host in lower case without user and port; '' if there is none."""
    at = F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), _PARTS, 2)), "^.*@", "")
    return F.coalesce(F.regexp_replace(at, ":\\d*$", ""), F.lit(""))


def display_name(url: Column) -> Column:
    """The first label of the host without leading www."""
    return F.split_part(F.regexp_replace(host(url), "^www\\.", ""), F.lit("."), F.lit(1))


def advance_offset(url: Column, param: Column, step: Column, start: Column) -> Column:
    """The URL with a parameter raised by step; a missing or odd one counts as start. Of several of one name the last holds."""
    part = lambda i: F.regexp_extract(url, _PARTS, i)
    name = lambda p: F.split_part(p, F.lit("="), F.lit(1))
    value = lambda p: F.substring(p, F.length(name(p)) + 2, F.length(p))
    pairs = F.filter(F.split(part(4), "&"), lambda p: p != "")
    names = F.array_distinct(F.transform(pairs, name))
    last = lambda n: value(F.element_at(F.filter(pairs, lambda p: name(p) == n), -1))
    now = F.when(F.array_contains(names, param), last(param))
    base = F.when(now.rlike(r"^\d{1,18}$"), now.try_cast("bigint")).otherwise(start.cast("bigint"))
    raised = F.concat(param, F.lit("="), (base + step).cast("string"))
    kept = F.transform(names, lambda n: F.when(n == param, raised).otherwise(F.concat(n, F.lit("="), last(n))))
    query = F.array_join(F.when(F.array_contains(names, param), kept).otherwise(F.concat(kept, F.array(raised))), "&")
    bare = F.regexp_extract(url, r"^[^?#]*", 0)
    return F.concat(bare, F.lit("?"), query, F.regexp_extract(url, r"#[\s\S]*$", 0))


def admissible(url: Column) -> Column:
    """Whether a school may be registered with this URL: http or https, and a host."""
    return F.coalesce(F.lower(F.regexp_extract(F.trim(url), _PARTS, 1)).isin("http", "https") & (host(url) != ""), F.lit(False))
