"""URL functions as Column expressions. A URL that can't be parsed has an empty host and never raises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that track, and two-label public suffixes.
TRACKING = r"^(utm_.*|gclid|fbclid|msclkid|dclid|mc_cid|mc_eid|igshid|ref|ref_src)$"
SECOND_LEVEL = ["com.gr", "org.gr", "net.gr", "edu.gr", "gov.gr", "co.uk", "org.uk", "ac.uk", "com.cy", "com.au", "co.jp", "com.br", "co.nz", "com.tr"]


def host(url: Column) -> Column:
    """Lower-cased, without ``www.``; '' if there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def registrable(name: Column, suffixes: list[str] | None = None) -> Column:
    """The label below the public suffix, with the suffix: two labels, or three where the last two are a suffix."""
    labels = F.split(name, r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    three = F.array_join(F.slice(labels, -3, 3), ".")
    n = F.size(labels)
    return F.when(n <= 2, name).when(two.isin(suffixes or SECOND_LEVEL), three).otherwise(two)


def site_root(name: Column) -> Column:
    """The registrable name's first label."""
    return F.split(registrable(name), r"\.")[0]


# URLs that lead to one amount.
AMOUNT_PATHS = [
    r"(?iu)(?:gift|voucher|δωρο|doro)[-_/ ]*(?:card|voucher|καρτ|επιταγ)?[-_/ ]*(?:€|eur)?\s*\d{1,4}",
    r"(?:^|[-_/])(?:10|15|20|25|30|40|50|60|75|100|150|200|250|300|500)(?:[-_/]|$)",
]
AMOUNT_PARAMETERS = r"(?i)(?:amount|value|denomination|price)=\d+"


def names_amount(url: Column) -> Column:
    """Whether a URL's path or parameters fix the amount of what it sells."""
    path, query = (F.lower(F.coalesce(F.try_url_decode(F.try_parse_url(url, F.lit(x))), F.lit(""))) for x in ("PATH", "QUERY"))
    return reduce(lambda a, b: a | b, [F.rlike(path, F.lit(p)) for p in AMOUNT_PATHS]) | F.rlike(query, F.lit(AMOUNT_PARAMETERS))


def _parameters(url: Column) -> Column:
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    return F.filter(F.split(query, "&"), lambda p: p != "")


def _tracks(parameter: Column) -> Column:
    return F.rlike(F.lower(F.split(parameter, "=")[0]), F.lit(TRACKING))


def has_tracking(url: Column) -> Column:
    return F.coalesce(F.exists(_parameters(url), _tracks), F.lit(False))


def canonical(url: Column) -> Column:
    """Without fragment, tracking parameters, ``www.``, doubled or closing slashes; null if it can't be parsed."""
    kept = F.array_join(F.filter(_parameters(url), lambda p: ~_tracks(p)), "&")
    path = F.regexp_replace(F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/{2,}", "/"), "/$", "")
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    return F.when(host(url) != "", F.concat(scheme, F.lit("://"), host(url), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def is_public_http(url: Column) -> Column:
    """http or https, with a host and no credentials."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    return F.coalesce(scheme.isin("http", "https") & (host(url) != "") & F.try_parse_url(url, F.lit("USERINFO")).isNull(), F.lit(False))


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts, or one a subdomain of the other."""
    return (a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a))


def on_list(name: Column, hosts: list[str]) -> Column:
    """Whether a host or a domain above it is on a (short) list."""
    return reduce(lambda x, y: x | y, [(name == h) | F.endswith(name, F.lit(f".{h}")) for h in hosts], F.lit(False))


def role(path: Column, patterns: list[tuple[str, str]], default: str = "UNKNOWN") -> Column:
    """The name of the first pattern that a path matches."""
    out = F.lit(default)
    for name, pattern in reversed(patterns):
        out = F.when(F.rlike(F.lower(path), F.lit(pattern)), F.lit(name)).otherwise(out)
    return out
