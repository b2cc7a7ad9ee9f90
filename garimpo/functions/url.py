"""URL keys and hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, optional user part, host, optional port
HOST = r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def url_hash(url: Column) -> Column:
    """Base64 of the SHA-256 of the URL's UTF-8 bytes; null for a null URL."""
    return F.base64(F.unhex(F.sha2(url, 256)))


def host(url: Column) -> Column:
    """Lower-case host without port and leading ``www.``; null where there is none."""
    found = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"^www\.", "")
    return F.when(found != "", found)


def domain(url: Column) -> Column:
    """The host, or the URL itself if it has none; null for a null URL."""
    return F.coalesce(host(url), url)


def trust_domain(url: Column) -> Column:
    """The host, or the empty string if there is none."""
    return F.coalesce(host(url), F.lit(""))
