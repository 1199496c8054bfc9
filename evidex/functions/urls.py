"""URL identity and names derived from URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: file name noise the sources add ----------------------------------------------
CACHE_BUSTER = r"__\d+\.\d+(?=\.[A-Za-z]+$|$)"
SIZE_SUFFIX = r"-\d{2,4}x\d{2,4}$"
SCALED_SUFFIX = r"-scaled$"


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)


def url_host(url: Column) -> Column:
    """The host, or null for a string that is not an absolute URL."""
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)
    return F.when(host != "", host)


def query_value(url: Column, key: str) -> Column:
    """A query parameter, percent-decoded; null when absent."""
    raw = F.regexp_extract(url, rf"[?&]{key}=([^&#]*)", 1)
    return F.when(raw != "", F.try_url_decode(raw))


def basename(url: Column) -> Column:
    return F.regexp_extract(url_path(url), r"([^/]*)$", 1)


def slug_of(url: Column) -> Column:
    """One slug from a permalink, an API address (``?slug=``) or a bare slug; applying it twice changes nothing."""
    path = F.regexp_replace(F.trim(url_path(url), F.lit("/")), r"^product/", "")
    return F.coalesce(F.trim(query_value(url, "slug"), F.lit("/")), F.trim(path, F.lit("/")))


def stem_of(filename: Column, suffixes: tuple[str, ...] = (CACHE_BUSTER, SIZE_SUFFIX, SCALED_SUFFIX)) -> Column:
    """A comparable lower-case stem: no extension, and none of the source's suffixes (upload stamp, size, scale)."""
    stem = F.regexp_replace(F.lower(filename), r"\.[^./]*$", "")
    for pattern in suffixes:
        stem = F.regexp_replace(stem, pattern, "")
    return stem
