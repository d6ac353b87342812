"""Verification by evidence: what a fetched page shows of the item that it should sell, and the first gate that it fails.

Signals are patterns that the caller gives, matched in folded text (lower case, no accents), but for those of the markup.
Whole pages are read. A page without markup has no signals.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.functions.text import fold, squeeze, strip_tags
from millrace.operators.classify import guarded

#: An amount in a title, in front of or behind its currency.
AMOUNTS = [r"(?i)(?:€|EUR)\s*(\d+(?:\.\d{1,2})?)", r"(?i)(\d+(?:\.\d{1,2})?)\s*(?:€|EUR\b)"]


@dataclass(frozen=True)
class Signs:
    """meant: names of the kind of item; aside: addresses of pages about something else; bought: words of a purchase;
    marked: markup of a purchase."""

    meant: str
    aside: str
    bought: str
    marked: str


def stated_amount(title: Column) -> Column:
    """The amount that a title names, as pages write it: ``20``, ``12.50``; null if none."""
    plain = F.replace(title, F.lit(","), F.lit("."))
    found = F.coalesce(*[F.nullif(F.regexp_extract(plain, p, 1), F.lit("")) for p in AMOUNTS]).cast("decimal(18,2)")
    return F.when(found == F.floor(found), F.floor(found).cast("string")).otherwise(found.cast("string"))


def _address(url: Column) -> Column:
    """Path and parameters, as they are and decoded."""
    parts = [F.coalesce(F.try_parse_url(url, F.lit(p)), F.lit("")) for p in ("PATH", "QUERY")]
    return F.concat_ws(" ", *parts, *[F.try_url_decode(p) for p in parts])


def signals(rows: DataFrame, signs: Signs, title: str = "title", final_url: str = "final_url", html: str = "html") -> DataFrame:
    """rows with in_url, in_title, in_heading, in_text, named, aside, bought, marked, amount, amount_found."""
    page = F.coalesce(F.col(html), F.lit(""))
    inside = lambda tag: strip_tags(F.regexp_extract(page, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))
    visible = strip_tags(F.regexp_replace(page, r"(?is)<(script|style|noscript)\b.*?</\1>|<!--.*?-->", " "))
    read = rows.withColumns({"_title": inside("title"), "_heading": inside("h1"), "_text": visible, "_address": fold(_address(F.col(final_url)))})
    says = lambda c, pattern: F.coalesce(F.rlike(fold(squeeze(c)), F.lit(pattern)), F.lit(False))
    shown = F.concat_ws(" ", "_title", "_heading", "_text")
    amount = stated_amount(F.col(title))
    found = read.withColumns(
        {
            "in_url": says(F.col("_address"), signs.meant),
            "in_title": says(F.col("_title"), signs.meant),
            "in_heading": says(F.col("_heading"), signs.meant),
            "in_text": says(F.col("_text"), signs.meant),
            "named": says(F.col(title), signs.meant),
            "bought": says(shown, signs.bought),
            "marked": F.rlike(page, F.lit(signs.marked)),
            "amount": amount,
            "amount_found": F.coalesce(F.contains(shown, amount) | F.contains(shown, F.replace(amount, F.lit("."), F.lit(","))), F.lit(False)),
        }
    )
    elsewhere = says(F.col("_address"), signs.aside) & ~F.col("in_title") & ~F.col("in_heading")
    return found.withColumn("aside", elsewhere).drop("_title", "_heading", "_text", "_address")


def decide(
    rows: DataFrame,
    signs: Signs,
    title: str = "title",
    item_url: str = "item_url",
    shop_url: str = "shop_url",
    final_url: str = "final_url",
    status: str = "status",
    error: str = "error",
    html: str = "html",
    site: Callable[[Column], Column] = urls.host,
) -> DataFrame:
    """rows with signals() and bucket (AUTO_SAFE, REVIEW or ERROR) and reason: the first gate that a page fails.

    The gates: it was fetched; its site, the item's and the shop's are known and one; it isn't a page about something
    else; title, heading, or address with text or the item's own title name the kind of item; it shows a purchase.
    """
    found = signals(rows, signs, title, final_url, html)
    mine, shop, final = (F.coalesce(site(F.col(c)), F.lit("")) for c in (item_url, shop_url, final_url))
    ok = F.coalesce(F.col(status).between(200, 299), F.lit(False))
    strong = F.col("in_title") | F.col("in_heading") | (F.col("in_url") & (F.col("in_text") | F.col("named")))
    gates = [
        (F.col(error).isNotNull(), "ERROR", "FETCH_ERROR"),
        (~ok, "ERROR", "HTTP"),
        ((mine == "") | (shop == "") | (final == ""), "REVIEW", "DOMAIN_PARSE_FAILED"),
        (mine != shop, "REVIEW", "OFFICIAL_URL_MERCHANT_DOMAIN_MISMATCH"),
        (final != shop, "REVIEW", "REDIRECT_DOMAIN_MISMATCH"),
        (F.col("aside"), "REVIEW", "TERMS_PRIVACY_GIFTSET_OR_SUPPORT_PAGE"),
        (~strong, "REVIEW", "NO_STRONG_GIFT_CARD_EVIDENCE"),
        (~(F.col("bought") | F.col("marked") | F.col("amount_found")), "REVIEW", "NO_STRONG_PURCHASE_OR_VALUE_EVIDENCE"),
    ]
    verdict = guarded(gates, ("AUTO_SAFE", "HTTP_OK_SAME_DOMAIN_STRONG_GIFT_CARD_SEMANTICS_AND_COMMERCE_EVIDENCE"))
    told = found.withColumn("_v", verdict)
    code = F.col("_v.reason")
    reason = F.when(code == "FETCH_ERROR", F.concat(F.lit("FETCH_ERROR:"), F.col(error))).when(code == "HTTP", F.concat(F.lit("HTTP_"), F.coalesce(F.col(status).cast("string"), F.lit("UNKNOWN")))).otherwise(code)
    return told.withColumns({"bucket": F.col("_v.bucket"), "reason": reason}).drop("_v")
