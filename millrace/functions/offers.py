"""Amounts and currencies that titles, texts and URLs of offers state, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.numbers import parse_number

# How currencies are written beside amounts, which words let a bare number be an amount, and which paths.
SIGNS = r"€|eur(?:o)?s?|euro|ευρώ|ευρω|chf|gbp|usd|£|\$"
BEHIND = SIGNS + r"|e\b|ε\b"
NUMBER = r"(\d+(?:[.,]\d{1,3})?)"
BARE = r"(?:gift\s*(?:card|voucher)|giftcard|δωροκάρτα|δωροκαρτα|δωροεπιταγή|δωροεπιταγη)[^0-9]{0,16}(?<![\p{L}\p{N}])" + NUMBER + r"(?![\p{L}\p{N}])"
PATH_WORDS = r"gift|voucher|δωρο|dorokart|dwrokart|doroepitag|gifcard"
PATH_NUMBER = r"(\d+(?:[.,]\d+)?)\s*(?:eur|euro|gbp|chf|usd|e)?(?:[-_/]|$)"
#: Currencies in the order in which they are tried.
CURRENCIES = [("GBP", r"£|\bgbp\b"), ("CHF", r"\bchf\b"), ("USD", r"\busd\b|\$"), ("EUR", r"€|\beur(?:o)?s?\b|ευρώ|ευρω|\d\s*[eε]\b")]


def _amounts(found: list[Column], least: float, most: float) -> Column:
    """Distinct amounts within bounds, ascending, of arrays of matched numbers."""
    values = F.transform(reduce(F.concat, found), lambda x: parse_number(x))
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: v.between(least, most))))


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?iu){pattern}"), 1)


def _explicit(text: Column) -> list[Column]:
    return [_matches(text, rf"(?:{SIGNS})\s*{NUMBER}"), _matches(text, rf"{NUMBER}\s*(?:{BEHIND})")]


def explicit_amounts(text: Column, least: float = 5, most: float = 10_000) -> Column:
    """Amounts beside a currency."""
    return _amounts(_explicit(text), least, most)


def title_amounts(title: Column, least: float = 5, most: float = 10_000) -> Column:
    """Amounts beside a currency, and bare numbers close behind the name of a gift card."""
    return _amounts([*_explicit(title), _matches(title, BARE)], least, most)


def url_amounts(url: Column, least: float = 5, most: float = 10_000) -> Column:
    """Numbers that end a part of the path of a URL that names a gift card; none if it can't be read."""
    path = F.coalesce(F.try_url_decode(F.try_parse_url(url, F.lit("PATH"))), F.lit(""))
    named = F.rlike(path, F.lit(f"(?iu){PATH_WORDS}"))
    return F.when(named, _amounts([_matches(path, PATH_NUMBER)], least, most)).otherwise(F.array().cast("array<double>"))


def currency(text: Column) -> Column:
    """The first currency in the list that a text has; null if it has none."""
    return F.coalesce(*[F.when(F.rlike(F.coalesce(text, F.lit("")), F.lit(f"(?iu){p}")), F.lit(c)) for c, p in CURRENCIES])
