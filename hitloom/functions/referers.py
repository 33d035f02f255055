"""Referer host, kind and internal path."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from hitloom import defaults
from hitloom.functions.text import quote, quoted

KNOWN_DOMAINS = (
    ("Search Engine", defaults.SEARCH_ENGINE_DOMAINS),
    ("Social", defaults.SOCIAL_DOMAINS),
    ("AI Platform", defaults.AI_PLATFORM_DOMAINS),
)

# Optional scheme, then the authority; the host follows the last "@" and ends at the port.
_AUTHORITY = r"^[\x00-\x20]*(?:[a-z][a-z0-9+.\-]*:)?//"
_HOST = _AUTHORITY + r"(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)"
_PATH = r"(?i)" + _AUTHORITY + r"[^/?#]*([^?#]*)"


def referer_host(referer: Column) -> Column:
    """Lower-case host name of an address; empty when it has none."""
    return F.translate(F.regexp_extract(F.lower(referer), _HOST, 1), "[]", "")


def referer_path(referer: Column) -> Column:
    """Path of an address, without the parameters of its last segment; ``/`` when empty."""
    path = F.regexp_replace(F.regexp_extract(referer, _PATH, 1), ";[^/]*$", "")
    return F.when(path == "", F.lit("/")).otherwise(path)


def known_domain(host: Column) -> Column:
    """The longest known domain that the host equals or lies under; empty when unknown."""
    names = "|".join(re.escape(d) for _, domains in KNOWN_DOMAINS for d in domains)
    return F.regexp_extract(host, rf"(?:^|\.)({names})$", 1)


def is_internal(host: str, site_domain: str) -> str:
    """SQL test whether a host is the site's domain or lies under it."""
    site = site_domain.strip().lower()
    return f"({host} = {quote(site)} OR endswith({host}, {quote('.' + site)}))" if site else "FALSE"


def classify_referer(df, site_domain: str, referer: str = "referer"):
    """Add ``referer_type`` and ``referer_path`` (the latter for internal referers only)."""
    known = " ".join(f"WHEN _domain IN ({quoted(domains)}) THEN {quote(name)}" for name, domains in KNOWN_DOMAINS)
    kind = f"""CASE WHEN {referer} IS NULL OR {referer} IN ('', '-') THEN 'Direct' WHEN _host = '' THEN 'Other'
        WHEN {is_internal('_host', site_domain)} THEN 'Internal' {known} ELSE 'Other' END"""
    return (
        df.withColumn("_host", referer_host(F.col(referer)))
        .withColumn("_domain", known_domain(F.col("_host")))
        .withColumn("referer_type", F.expr(kind))
        .withColumn("referer_path", F.when(F.col("referer_type") == "Internal", referer_path(F.col(referer))))
        .drop("_host", "_domain")
    )
