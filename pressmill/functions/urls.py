"""Parts and identities of web addresses as column expressions.

Regular expressions rather than the parser functions: those refuse hosts with
underscores or letters beyond ASCII, which archives hold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def host(url: Column) -> Column:
    """Lower-case host without user or port; empty where there is none."""
    return F.lower(F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":\d*$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, _PARTS, 4), r"^\?", "")


def safe(url: Column) -> Column:
    """The address if it is http or https, has a host and names no user; else null."""
    good = scheme(url).isin("http", "https") & (host(url) != "") & ~F.contains(authority(url), F.lit("@")) & ~url.rlike(r"\s")
    return F.when(good, url)


def host_key(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def canonical(url: Column) -> Column:
    """Host and path without its trailing slash, and the query: what makes two addresses one page here."""
    rest = F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise("")
    return F.when(host(url) != "", F.concat(host(url), F.regexp_replace(path(url), r"/+$", ""), rest))


def identity(url: Column) -> Column:
    """Address without fragment and trailing slash."""
    return F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"/+$", "")


def web_domain(collection: Column, url: Column) -> Column:
    """Host of web documents (collection 1); null for other collections."""
    return F.when((collection == "1") & (host(url) != ""), host(url))
