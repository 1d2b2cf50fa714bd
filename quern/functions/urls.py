"""Addresses: three canonical forms that differ on purpose, fingerprints, citation links. All inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import fold_width

# Parameters each canonical form drops, beside utm_*.
FEED_DROPS = ("gclid", "fbclid")
KEY_DROPS = (*FEED_DROPS, "at_medium", "at_campaign")
LEDGER_DROPS = (*KEY_DROPS, "ref", "ref_src", "spm", "from", "source", "mc_cid", "mc_eid")

_PARTS = r"(?s)^(https)://([^/?#\s]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _bare(url: Column) -> Column:
    return F.regexp_replace(url, r"^\s+|\s+$", "")


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(_bare(url), "(?i)" + _PARTS, i)


def _query(url: Column, drops: tuple[str, ...], ordered: bool) -> Column:
    names = "|".join(drops)
    kept = F.filter(F.split(_part(url, 4), "&"), lambda p: (p != "") & ~F.regexp_like(p, F.lit(rf"(?i)^(utm_[^=]*|{names})(=.*)?$")))
    return F.array_join(F.array_sort(kept) if ordered else kept, "&")


def _joined(host: Column, path: Column, query: Column) -> Column:
    return F.concat(F.lit("https://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _valid(url: Column) -> Column:
    return F.regexp_like(_bare(url), F.lit("(?i)" + _PARTS)) & ~F.contains(_part(url, 2), F.lit("@"))


def feed_url(url: Column) -> Column:
    """https only, no user info, scheme and host lower case, tracking parameters and fragment dropped, order kept; else null."""
    path = _part(url, 3)
    return F.when(_valid(url), _joined(F.lower(_part(url, 2)), F.when(path == "", "/").otherwise(path), _query(url, FEED_DROPS, False)))


def key_url(url: Column) -> Column:
    """Also without port 443 and closing slashes, parameters sorted."""
    host = F.regexp_replace(F.lower(_part(url, 2)), ":443$", "")
    return F.when(_valid(url), _joined(host, F.regexp_replace(_part(url, 3), "/+$", ""), _query(url, KEY_DROPS, True)))


def ledger_url(url: Column) -> Column:
    """Also without www. and more tracking parameters; another port than 443 makes it invalid."""
    host = F.regexp_replace(F.regexp_replace(F.lower(_part(url, 2)), ":443$", ""), r"^www\.", "")
    ok = _valid(url) & ~F.contains(host, F.lit(":"))
    return F.when(ok, _joined(host, F.regexp_replace(_part(url, 3), "/+$", ""), _query(url, LEDGER_DROPS, True)))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^\s*https?://([^/?#:\s@]+)", 1))


def plain_title(title: Column) -> Column:
    """Letters and numbers of any script, lower case, half width."""
    return F.regexp_replace(F.lower(fold_width(title)), r"[^\p{L}\p{N}]", "")


def fingerprints(url: Column, title: Column) -> Column:
    """The distinct digests an item is known by."""
    return F.array_distinct(F.array_compact(F.array(F.sha2(F.concat(F.lit("url:"), ledger_url(url)), 256), F.sha2(F.concat(F.lit("title:"), plain_title(title)), 256))))


def citation_href(url: Column, page: Column) -> Column:
    """A safe http(s) address with #page=N, else null."""
    base = F.regexp_replace(F.trim(url), "#.*$", "")
    ok = F.regexp_like(base, F.lit(r"(?i)^https?://[^/?#\s@]+([/?]\S*)?$"))
    return F.when(ok, F.when(page > 0, F.concat(base, F.lit("#page="), page.cast("string"))).otherwise(F.trim(url)))


def has_secret_parameter(url: Column) -> Column:
    """Whether a parameter's name is like that of a secret."""
    query = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    return F.exists(query, lambda p: F.regexp_like(F.lower(p), F.lit(r"^[^=]*(token|secret|password|passwd|api[_-]?key|signature|session|auth)[^=]*=")))
