"""The quality audit of a catalogue: every rule over shops and their cards, each table read in one pass.

What a rule needs beside a row (how many rows share a key, whether a row has a category, the latest snapshot) is
aggregated by key and joined once; the rules then are one array of conditions, exploded. The frames have fixed roles:

    shops      shop_id, name, status, url, logo, logo_source
    cards      card_id, shop_id, title, status, verification, url, verified_at, seo_title, meta
    sources    shop_id, card_id (one of them null), kind
    variants   variant_id, card_id, active, url
    categories card_id, occasions card_id, flags card_id
    snapshots  card_id, observed_at, http_status
    files      path: the logos that are there
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numbers import whole_days
from millrace.functions.text import catalog_form, logo_problem, name_polluted, title_polluted
from millrace.functions.urls import canonical, has_tracking, host, names_amount, same_site
from millrace.operators.classify import issues

SEVERITIES = ["BLOCKER", "HIGH", "MEDIUM", "LOW"]


@dataclass(frozen=True)
class AuditRules:
    """What a catalogue decides for itself."""

    now: Column
    generic_names: tuple[str, ...]
    logo_folder: str = "/merchant-logos/"
    stale_days: int = 90


def sharing(df: DataFrame, key: Column, out: str) -> DataFrame:
    """df with how many rows have a row's key, in ``out``; null where the key is null or empty, or no other row has it."""
    keyed = df.withColumn("_key", key)
    several = keyed.filter("_key != ''").groupBy("_key").agg(F.count("*").alias(out)).filter(F.col(out) > 1)
    return keyed.join(several, "_key", "left").drop("_key")


def _has(df: DataFrame, other: DataFrame, key: str, out: str) -> DataFrame:
    """df with whether another frame has a row's key."""
    there = other.filter(F.col(key).isNotNull()).select(key).distinct().withColumn(out, F.lit(True))
    return df.join(there, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def _strangers(a: Column, b: Column) -> Column:
    """Whether two URLs are of different sites; not if either can't be read."""
    return (host(a) != "") & (host(b) != "") & ~same_site(host(a), host(b))


def shop_issues(shops: DataFrame, cards: DataFrame, sources: DataFrame, files: DataFrame, rules: AuditRules) -> DataFrame:
    """shop_id, severity, code, detail."""
    rows = sharing(sharing(shops, catalog_form(F.col("name")), "same_name"), host(F.col("url")), "same_host")
    rows = _has(_has(rows, cards, "shop_id", "has_cards"), sources.filter("kind = 'OFFICIAL'"), "shop_id", "official")
    rows = _has(rows, files.select(F.col("path").alias("logo")), "logo", "there")
    active, name, url, logo = F.col("status") == "ACTIVE", F.col("name"), F.col("url"), F.col("logo")
    generic, unread = catalog_form(name).isin(*rules.generic_names), host(url) == ""
    problem, local = logo_problem(logo), F.startswith(logo, F.lit(rules.logo_folder))
    blank = F.coalesce(url, F.lit("")) == ""
    return issues(
        rows,
        "shop_id",
        [
            ("MEDIUM", "ACTIVE_MERCHANT_WITHOUT_CARDS", active & ~F.col("has_cards"), F.lit(None)),
            ("HIGH", "GENERIC_MERCHANT_NAME", generic, name),
            ("HIGH", "SUSPICIOUS_MERCHANT_NAME", ~generic & name_polluted(name), name),
            ("HIGH", "DUPLICATE_MERCHANT_NAME", F.col("same_name") > 1, F.col("same_name")),
            ("HIGH", "DUPLICATE_MERCHANT_DOMAIN", F.col("same_host") > 1, host(url)),
            ("MEDIUM", "MISSING_MERCHANT_WEBSITE", active & blank, F.lit(None)),
            ("MEDIUM", "INVALID_MERCHANT_WEBSITE", active & unread & ~blank, url),
            ("HIGH", "LOGO_MISSING", problem == "MISSING", F.lit(None)),
            ("BLOCKER", "LOGO_FAVICON_OR_SITE_ICON", problem == "FAVICON_OR_SITE_ICON", logo),
            ("BLOCKER", "LOGO_PLACEHOLDER_OR_GENERATED", problem == "PLACEHOLDER_OR_GENERATED", logo),
            ("MEDIUM", "LOGO_NOT_LOCAL_CANONICAL", problem.isNull() & ~local, logo),
            ("BLOCKER", "LOCAL_LOGO_FILE_MISSING", problem.isNull() & local & ~F.col("there"), logo),
            ("MEDIUM", "LOGO_SOURCE_DOMAIN_MISMATCH", _strangers(F.col("logo_source"), url), F.col("logo_source")),
            ("MEDIUM", "NO_OFFICIAL_MERCHANT_SOURCE", active & ~F.col("official"), F.lit(None)),
        ],
    )


def card_issues(cards: DataFrame, shops: DataFrame, sources: DataFrame, variants: DataFrame, categories: DataFrame, occasions: DataFrame, flags: DataFrame, snapshots: DataFrame, rules: AuditRules) -> DataFrame:
    """card_id, severity, code, detail."""
    owners = shops.select("shop_id", F.col("status").alias("shop_status"), F.col("url").alias("shop_url"))
    rows = cards.join(owners, "shop_id", "left")
    title = F.when(catalog_form(F.col("title")) != "", F.concat_ws("\x1f", F.col("shop_id").cast("string"), catalog_form(F.col("title"))))
    rows = sharing(sharing(rows, title, "same_title"), canonical(F.col("url")), "same_url")
    for other, out in ((sources.filter("kind = 'OFFICIAL'"), "official"), (categories, "category"), (occasions, "occasion"), (variants.filter("active"), "variant")):
        rows = _has(rows, other, "card_id", out)
    open_flags = flags.groupBy("card_id").agg(F.count("*").alias("open_flags"))
    last = snapshots.groupBy("card_id").agg(F.max_by("http_status", "observed_at").alias("http_status"))
    rows = rows.join(open_flags, "card_id", "left").join(last, "card_id", "left")
    active, url, site = F.col("status") == "ACTIVE", F.col("url"), canonical(F.col("url"))
    blank, age = F.coalesce(url, F.lit("")) == "", whole_days(F.col("verified_at"), rules.now)
    readable = ~blank & site.isNotNull()
    found = issues(
        rows,
        "card_id",
        [
            ("BLOCKER", "ACTIVE_CARD_IN_INACTIVE_MERCHANT", active & ~F.coalesce(F.col("shop_status") == "ACTIVE", F.lit(False)), F.col("shop_status")),
            ("HIGH", "SUSPICIOUS_CARD_TITLE", title_polluted(F.col("title")), F.col("title")),
            ("HIGH", "DUPLICATE_CARD_TITLE_SAME_MERCHANT", F.col("same_title") > 1, F.col("title")),
            ("HIGH", "DUPLICATE_OFFICIAL_URL", F.col("same_url") > 1, site),
            ("BLOCKER", "MISSING_OFFICIAL_URL", blank & active, F.lit(None)),
            ("MEDIUM", "MISSING_OFFICIAL_URL", blank & ~active, F.lit(None)),
            ("BLOCKER", "INVALID_OFFICIAL_URL", ~blank & site.isNull(), url),
            ("LOW", "OFFICIAL_URL_TRACKING_PARAMS", readable & has_tracking(url), url),
            ("MEDIUM", "VERY_SPECIFIC_OFFICIAL_URL", readable & names_amount(url), url),
            ("HIGH", "OFFICIAL_URL_DOMAIN_MISMATCH", readable & _strangers(url, F.col("shop_url")), url),
            ("HIGH", "ACTIVE_CARD_NOT_VERIFIED", active & ~F.coalesce(F.col("verification") == "VERIFIED", F.lit(False)), F.col("verification")),
            ("HIGH", "ACTIVE_CARD_NEVER_VERIFIED", active & F.col("verified_at").isNull(), F.lit(None)),
            ("MEDIUM", "STALE_VERIFICATION", active & (age > rules.stale_days), age),
            ("HIGH", "NO_OFFICIAL_CARD_SOURCE", active & ~F.col("official"), F.lit(None)),
            ("MEDIUM", "NO_CATEGORY", active & ~F.col("category"), F.lit(None)),
            ("LOW", "NO_OCCASION", active & ~F.col("occasion"), F.lit(None)),
            ("MEDIUM", "NO_ACTIVE_VARIANT", active & ~F.col("variant"), F.lit(None)),
            ("LOW", "MISSING_SEO_TITLE", active & (F.coalesce("seo_title", F.lit("")) == ""), F.lit(None)),
            ("LOW", "MISSING_META_DESCRIPTION", active & (F.coalesce("meta", F.lit("")) == ""), F.lit(None)),
            ("HIGH", "OPEN_PRODUCTION_REVIEW_FLAG", F.col("open_flags") > 0, F.col("open_flags")),
            ("HIGH", "LATEST_SNAPSHOT_BAD_HTTP", active & ~F.col("http_status").between(200, 399), F.col("http_status")),
        ],
    )
    sold = variants.filter("active and url != ''").select("card_id", "variant_id", F.col("url").alias("variant_url"))
    sold = sold.join(cards.select("card_id", "shop_id"), "card_id").join(owners, "shop_id", "left")
    bought = F.col("variant_url")
    of_variants = issues(
        sold,
        "card_id",
        [
            ("HIGH", "INVALID_VARIANT_PURCHASE_URL", host(bought) == "", bought),
            ("MEDIUM", "VARIANT_PURCHASE_DOMAIN_MISMATCH", _strangers(bought, F.col("shop_url")), bought),
        ],
    )
    return found.unionByName(of_variants)


def audit(shops: DataFrame, cards: DataFrame, sources: DataFrame, variants: DataFrame, categories: DataFrame, occasions: DataFrame, flags: DataFrame, snapshots: DataFrame, files: DataFrame, rules: AuditRules) -> DataFrame:
    """entity (MERCHANT or GIFT_CARD), id, severity, code, detail of every rule that a shop or a card breaks."""
    of_shops = shop_issues(shops, cards, sources, files, rules).withColumnRenamed("shop_id", "id")
    of_cards = card_issues(cards, shops, sources, variants, categories, occasions, flags, snapshots, rules).withColumnRenamed("card_id", "id")
    return of_shops.withColumn("entity", F.lit("MERCHANT")).unionByName(of_cards.withColumn("entity", F.lit("GIFT_CARD"))).select("entity", "id", "severity", "code", "detail")


def blockers(found: DataFrame) -> DataFrame:
    """entity, errors, warnings, affected: what stops a catalogue from being published, and what doesn't."""
    stops = F.col("severity") == "BLOCKER"
    return found.groupBy("entity").agg(F.count_if(stops).alias("errors"), F.count_if(~stops).alias("warnings"), F.countDistinct("id").alias("affected"))
