"""Decision steps of a curation pipeline, as frames of actions or verdicts.

Scores are sums of weights over tests; the weights are the defaults of the functions' parameters, so that a
caller can see and replace them. Nothing here changes a table: a step returns what should be done (see
millrace.plans.changes for applying it).
"""

from __future__ import annotations

from functools import reduce

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numbers import percent, whole_days
from millrace.operators.classify import guarded
from millrace.operators.rank import first_per_key, winner_margin

# -- scores of single rows


def candidate_score(official: Column, has_url: Column, strong: Column, supporting: Column, purchase: Column) -> Column:
    """0 to 100: 30 official, 20 a URL, 30 a strong keyword and 10 for more, supporting ones up to 10, 10 a purchase page.

    strong and supporting are numbers of keywords.
    """
    points = F.when(official, 30).otherwise(0) + F.when(has_url, 20).otherwise(0) + F.when(strong > 1, 40).when(strong == 1, 30).otherwise(0)
    return F.least(F.lit(100), points + F.least(F.lit(10), supporting * 5) + F.when(purchase, 10).otherwise(0))


def link_score(text: Column, listed: list[tuple[list[str], int, bool]], patterns: list[tuple[str, int]]) -> Column:
    """Points of a link by what its URL and label contain: of each (words, points, each) list once for every word, or (each
    is false) once for any of them; and of each (pattern, points) that matches. Not clamped."""
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for words, points, each in listed:
        found = [F.contains(low, F.lit(w)) for w in words]
        total = total + (sum((F.when(f, points).otherwise(0) for f in found), F.lit(0)) if each else F.when(reduce(lambda a, b: a | b, found), points).otherwise(0))
    for pattern, points in patterns:
        total = total + F.when(F.rlike(low, F.lit(pattern)), points).otherwise(0)
    return total


def result_score(tests: list[tuple[Column, int]]) -> Column:
    """Points of what holds, clamped to 0 and 100."""
    total = F.lit(0)
    for test, points in tests:
        total = total + F.when(test, points).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def page_state(status: Column, text: Column, gone: str, denied: str, blocked: str, error: str, least: int = 80) -> Column:
    """NOT_FOUND, ACCESS_DENIED, BLOCKED, ERROR_PAGE, EMPTY or OK: by HTTP status first, then by phrases (patterns), then by length."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(status.isin(404, 410), "NOT_FOUND")
        .when(status.isin(401, 403), "ACCESS_DENIED")
        .when(status == 429, "BLOCKED")
        .when(status >= 500, "ERROR_PAGE")
        .when(F.rlike(low, F.lit(gone)), "NOT_FOUND")
        .when(F.rlike(low, F.lit(denied)), "ACCESS_DENIED")
        .when(F.rlike(low, F.lit(blocked)), "BLOCKED")
        .when(F.rlike(low, F.lit(error)), "ERROR_PAGE")
        .when(F.length(F.trim(low)) < least, "EMPTY")
        .otherwise("OK")
    )


def verification(confidence: Column, verdict: Column, canonical: Column, positive: float = 0.90, negative: float = 0.92, elsewhere: float = 0.97) -> Column:
    """VERIFIED, REJECTED, NON_CANONICAL or REVIEW of a classifier's verdict (yes / no) and confidence."""
    return (
        F.when((verdict == "yes") & canonical & (confidence >= positive), "VERIFIED")
        .when((verdict == "yes") & ~canonical & (confidence >= elsewhere), "NON_CANONICAL")
        .when((verdict == "no") & (confidence >= negative), "REJECTED")
        .otherwise("REVIEW")
    )


def tier(plan: Column, active: Column, ends: Column, now: Column, known: tuple[str, ...] = ("PREMIUM_BANNER", "FEATURED", "PARTNER")) -> Column:
    """The plan of a subscription that is active and hasn't ended (a null end is none), if it is a known one; else null."""
    return F.when(active & (ends.isNull() | (ends > now)) & plan.isin(*known), plan)


def tier_rank(name: Column, ranked: tuple[str, ...] = ("FEATURED", "PREMIUM_BANNER")) -> Column:
    """A tier's place from 1 on among those that are promoted, lowest first; 0 for all others and null."""
    return F.coalesce(*[F.when(name == t, k) for k, t in enumerate(ranked, 1)], F.lit(0))


def opportunity(impressions: Column, clicks: Column, position: Column) -> Column:
    """CTR, TOP_TEN or SECOND_PAGE of a search query's figures; null if it is none."""
    ctr = percent(clicks, impressions, 2)
    seen = (impressions >= 10) & (position > 0) & (position <= 20)
    return F.when(seen & (ctr < 3) & (position <= 10), "CTR").when(seen & position.between(4, 10), "TOP_TEN").when(seen & (position > 10), "SECOND_PAGE")


def address_class(text: Column, has_postal: Column, has_number: Column, noise: str) -> Column:
    """A struct (bucket, reason): REJECT, REVIEW or SAFE of a stretch of text as an address."""
    return guarded(
        [
            (F.length(F.trim(text)) < 8, "REJECT", "too short"),
            (F.length(text) > 220, "REJECT", "too long"),
            (F.rlike(F.lower(text), F.lit(noise)), "REJECT", "not an address"),
            (has_postal & has_number, "SAFE", "postal code and number"),
            (has_postal | has_number, "REVIEW", "one of postal code and number"),
        ],
        ("REJECT", "neither postal code nor number"),
    )


def market(host: Column, path: Column, home: str) -> Column:
    """HOME, EU_WITH_HOME, FOREIGN_ONLY or GLOBAL of a URL, by its top-level domain and path."""
    in_path = F.rlike(F.lower(path), F.lit(rf"(^|/){home}([-_/]|$)"))
    return (
        F.when(F.endswith(host, F.lit(f".{home}")), "HOME")
        .when(F.endswith(host, F.lit(".eu")) & in_path, "EU_WITH_HOME")
        .when(in_path, "HOME")
        .when(F.rlike(host, F.lit(r"\.(com|net|org|eu|io|shop)$")), "GLOBAL")
        .otherwise("FOREIGN_ONLY")
    )


# -- steps over tables


def canonicalize(candidates: DataFrame, overrides: DataFrame | None, key: str, url: str, status: str, score: Column) -> DataFrame:
    """key, url, score, source: each key's winner among its VERIFIED candidates; ties go to the shorter, then the lesser URL.

    An override (key, url) wins if it is VERIFIED itself; if it isn't, the key is left for manual review.
    """
    scored = candidates.withColumn("score", score)
    good = scored.filter(F.col(status) == "VERIFIED")
    best = first_per_key(good, [key], [F.desc("score"), F.length(url), F.col(url)]).select(key, url, "score")
    if overrides is None:
        return best.withColumn("source", F.lit("SCORE"))
    forced = overrides.groupBy(key).agg(F.min(url).alias("_forced"))
    checked = forced.join(good.select(key, F.col(url).alias("_forced"), F.col("score").alias("_score")).dropDuplicates([key, "_forced"]), [key, "_forced"], "left")
    both = best.join(checked, key, "full_outer")
    source = F.when(F.col("_forced").isNull(), "SCORE").when(F.col("_score").isNotNull(), "OVERRIDE").otherwise("MANUAL_REVIEW")
    ok = F.col("source") == "OVERRIDE"
    out = both.withColumn("source", source)
    return out.select(key, F.when(ok, F.col("_forced")).when(F.col("source") == "SCORE", F.col(url)).alias(url), F.when(ok, F.col("_score")).when(F.col("source") == "SCORE", F.col("score")).alias("score"), "source")


def promote(canonical: DataFrame, entities: DataFrame, key: str, url: str) -> DataFrame:
    """key, url, old_url, action: CREATE, KEEP, or FLAG_URL_CHANGE (never an overwrite). More than one row of a key is an error when read."""
    many = canonical.groupBy(key).agg(F.count("*").alias("_n"), F.min(url).alias(url))
    one = many.filter(F.assert_true(F.col("_n") == 1, "more than one canonical row of a key").isNull())
    old = entities.select(key, F.col(url).alias("old_url"), F.lit(True).alias("_there")).dropDuplicates([key])
    action = F.when(F.col("_there").isNull(), "CREATE").when(F.col("old_url").eqNullSafe(F.col(url)), "KEEP").otherwise("FLAG_URL_CHANGE")
    return one.join(old, key, "left").select(key, url, "old_url", action.alias("action"))


def reverify(due: DataFrame, snapshots: DataFrame, fetched: DataFrame, key: str, now: datetime, usable_only: bool = False) -> DataFrame:
    """key, outcome, next_review for what is due (next_review null or past): BASELINE, UNCHANGED, CHANGED or UNAVAILABLE.

    snapshots: key, at, digest. fetched: key, digest (null: not available). The latest snapshot counts even if it
    has no digest, which makes the next one a baseline; with usable_only the latest that has one.
    """
    kept = snapshots.filter("digest is not null") if usable_only else snapshots
    last = kept.groupBy(key).agg(F.max(F.struct("at", "digest")).alias("_last")).select(key, F.col("_last.digest").alias("_before"))
    rows = due.filter(F.col("next_review").isNull() | (F.col("next_review") <= F.lit(now))).select(key)
    rows = rows.join(last, key, "left").join(fetched.select(key, F.col("digest").alias("_now")), key, "left")
    outcome = F.when(F.col("_now").isNull(), "UNAVAILABLE").when(F.col("_before").isNull(), "BASELINE").when(F.col("_before") == F.col("_now"), "UNCHANGED").otherwise("CHANGED")
    days = F.when(F.col("outcome").isin("CHANGED", "UNAVAILABLE"), 7).otherwise(30)
    return rows.withColumn("outcome", outcome).select(key, "outcome", F.date_add(F.lit(now).cast("date"), days).alias("next_review"))


def follow_ups(rows: DataFrame, stage: Column, stage_at: str, last_sent: str, sent: str, now: datetime, first_days: int = 2, repeat_days: int = 4, most: int = 6) -> DataFrame:
    """rows with stage, age (days in it) and ``due``: the first reminder after first_days, then every repeat_days, ``most`` in all."""
    moment = F.lit(now).cast("timestamp")
    waited = F.when(F.col(last_sent).isNull(), whole_days(F.col(stage_at), moment) >= first_days).otherwise(whole_days(F.col(last_sent), moment) >= repeat_days)
    return rows.select("*", stage.alias("stage"), whole_days(F.col(stage_at), moment).alias("age"), ((F.col(sent) < most) & waited).alias("due"))


def bulk_plan(rows: DataFrame, existing: DataFrame, domain: str, name: str, order: str) -> DataFrame:
    """rows with action: SKIP_NO_DOMAIN, SKIP_IN_RUN (a row before has the domain), REUSE (domain or name exists) or CREATE, and match_id."""
    from millrace.operators.linkage import two_key_match

    matched = two_key_match(rows, existing, [(domain, domain), (name, name)], "id")
    first = first_per_key(rows.filter(F.col(domain) != ""), [domain], [F.col(order)]).select(F.col(domain).alias("_d"), F.col(order).alias("_o"))
    out = matched.join(first, F.col(domain) == F.col("_d"), "left")
    action = F.when(F.coalesce(domain, F.lit("")) == "", "SKIP_NO_DOMAIN").when(F.col(order) != F.col("_o"), "SKIP_IN_RUN").when(F.col("match_id").isNotNull(), "REUSE").otherwise("CREATE")
    return out.withColumn("action", action).drop("_d", "_o", "match_key")


def progress(rows: DataFrame, domain: str, name: str, id_col: str, statuses: list[str]) -> DataFrame:
    """One row: distinct entities (by domain, else name, else id) of each status, and those that have more than one."""
    key = F.when(F.coalesce(domain, F.lit("")) != "", F.col(domain)).when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("name:"), F.lower(F.trim(name)))).otherwise(F.concat(F.lit("id:"), F.col(id_col).cast("string")))
    per_key = rows.groupBy(key.alias("_key")).agg(*[F.max((F.col("status") == s).cast("int")).alias(s) for s in statuses])
    overlap = sum((F.col(s) for s in statuses), F.lit(0)) > 1
    return per_key.agg(F.count("*").alias("entities"), *[F.sum(s).alias(s) for s in statuses], F.count_if(overlap).alias("overlapping"))


def expand_primary(rows: DataFrame, id_col: str, category: str, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Expansions (id, to) of the rule table (category, to) for ids with exactly one category; and the others with a reason."""
    counts = rows.groupBy(id_col).agg(F.countDistinct(category).alias("_n"), F.min(category).alias(category))
    one = counts.filter("_n = 1")
    review = counts.filter("_n != 1").select(id_col, F.when(F.col("_n") == 0, "NO_PRIMARY").otherwise("SEVERAL_PRIMARIES").alias("reason"))
    return one.join(rules, category).select(id_col, "to"), review


def merge_evidence(rows: DataFrame, evidence: DataFrame, key: str, note: str, url: str, marker: str) -> DataFrame:
    """rows with evidence (key, note, url) appended to their note, once (a note with the marker stays), and their URL filled if null."""
    new = evidence.groupBy(key).agg(F.min(note).alias("_note"), F.min(url).alias("_url"))
    joined = rows.join(new, key, "left")
    has = F.contains(F.coalesce(note, F.lit("")), F.lit(marker))
    text = F.when(F.col("_note").isNull() | has, F.col(note)).otherwise(F.concat_ws("\n", note, F.concat(F.lit(f"{marker} "), F.col("_note"))))
    return joined.select(*[text.alias(c) if c == note else F.coalesce(c, "_url").alias(c) if c == url else F.col(c) for c in rows.columns])


def accepted_asset(candidates: DataFrame, key: str, asset: str, score: str, least: float, margin: float) -> DataFrame:
    """key, asset, score of the best candidate if it is good enough and far enough above the next one."""
    best = winner_margin(candidates, key, asset, score, least, margin)
    return best.filter("decided").select(key, F.col("winner").alias(asset), F.col("top").alias(score))


def capability_decision(places: Column, url: Column, fetched: Column, online_only: Column, found: Column, every_place: Column) -> Column:
    """What evidence of a page allows: the first obstacle, or SAFE_TO_APPLY.

    places: how many a row has; found: the array of capabilities that the evidence names; every_place: whether it
    speaks of all of them, which it must where there are several.
    """
    return (
        F.when(places < 1, "NO_VERIFIED_LOCATION")
        .when(~F.coalesce(F.rlike(url, F.lit("(?i)^https?://")), F.lit(False)), "NO_OFFICIAL_URL")
        .when(~fetched, "FETCH_FAILED")
        .when(online_only, "ONLINE_ONLY_SIGNAL")
        .when(F.size(found) < 1, "NO_GIFT_CARD_IN_STORE_EVIDENCE")
        .when((places > 1) & ~every_place, "AMBIGUOUS_LOCATION_SCOPE")
        .otherwise("SAFE_TO_APPLY")
    )


def capabilities(rows: DataFrame, places: DataFrame, key: str, found: Column) -> DataFrame:
    """key, place, capability: every place of a row with each of the capabilities (an array) that its evidence names."""
    named = rows.select(key, F.explode(found).alias("capability"))
    return named.join(places.select(key, "place"), key).distinct()


def branded_split(rows: DataFrame, query: str, pattern: str, clicks: str, impressions: str) -> DataFrame:
    """branded, clicks, impressions, ctr, share of clicks for queries that match a pattern and those that don't."""
    groups = rows.groupBy(F.rlike(F.lower(query), F.lit(pattern)).alias("branded")).agg(F.sum(clicks).alias("clicks"), F.sum(impressions).alias("impressions"))
    total = groups.agg(F.sum("clicks").alias("_all"))
    return groups.join(F.broadcast(total)).select("branded", "clicks", "impressions", percent(F.col("clicks"), F.col("impressions"), 2).alias("ctr"), percent(F.col("clicks"), F.col("_all")).alias("share"))


def issuers(listings: DataFrame, issuer: str, domain: Column, value: Column, kind: Column) -> DataFrame:
    """issuer, listings, domains, values, kinds (sorted lists), confidence, review: listings by issuer."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c.cast("string"))), " | ")
    groups = listings.filter(F.trim(issuer) != "").groupBy(F.trim(issuer).alias("issuer"))
    out = groups.agg(F.count("*").alias("listings"), listed(domain).alias("domains"), listed(value).alias("values"), listed(kind).alias("kinds"), F.countDistinct(domain).alias("_n"))
    confidence = F.when(F.col("_n") == 1, 90).when(F.col("_n") == 0, 40).otherwise(60) + F.when(F.col("listings") > 1, 10).otherwise(0)
    return out.withColumn("confidence", confidence).withColumn("review", F.col("confidence") < 90).drop("_n")
