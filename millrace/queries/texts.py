"""Text, URL and number functions over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import numbers, text, urls
from millrace.operators import linkage
from millrace.plans.scratch import table
from millrace.queries import Registry
from millrace.sources import files

query = Registry()


def documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", "html")


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(lower(strip_accents(text)), 'ς', 'σ'), '[^\p{L}\p{N}]+', ' ', 'g'), '\s+', ' ', 'g'))) AS form FROM documents""")
def normalize_text(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(text.catalog_form(F.col("text"))).alias("form"))


@query(r"SELECT p_partkey, trim(regexp_replace(lower(p_name || ' & Cö'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM (SELECT p_partkey, strip_accents(p_name) AS p_name FROM part) WHERE false UNION ALL SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') || '-co' FROM part")
def slugify(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.slugify(F.concat("p_name", F.lit(" & Cö"))).alias("slug"))


@query(r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') AS host FROM pages")
def url_host(spark, sf):
    return pages(spark, sf).select("page_id", urls.host(F.col("url")).alias("host"))


@query(r"""
WITH u AS (SELECT page_id, lower(split_part(url, '://', 1)) AS scheme, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') AS host,
 regexp_replace(regexp_replace(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g'), '/$', '') AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
k AS (SELECT *, list_filter(string_split(q, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), '^(utm_.*|gclid|fbclid|msclkid|dclid|mc_cid|mc_eid|igshid|ref|ref_src)$')) AS kept FROM u)
SELECT page_id, scheme || '://' || host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM k""")
def url_canonical(spark, sf):
    return pages(spark, sf).select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@query(r"SELECT page_id, regexp_matches(url, '[?&](utm_[a-z]*|gclid|fbclid|ref)=') AS tracked FROM pages")
def url_tracking_flag(spark, sf):
    return pages(spark, sf).select("page_id", urls.has_tracking(F.col("url")).alias("tracked"))


ROLES = [("HELP", r"/(help|faq|terms)"), ("ENGLISH", r"^/en/"), ("FRENCH", r"^/fr/"), ("ROOT", r"^/?$")]


@query(r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '://[^/?#]*([^?#]*)', 1)) AS path FROM pages)
SELECT page_id, CASE WHEN regexp_matches(path, '/(help|faq|terms)') THEN 'HELP' WHEN regexp_matches(path, '^/en/') THEN 'ENGLISH' WHEN regexp_matches(path, '^/fr/') THEN 'FRENCH' WHEN regexp_matches(path, '^/?$') THEN 'ROOT' ELSE 'UNKNOWN' END AS role FROM p""")
def url_role_case(spark, sf):
    return pages(spark, sf).select("page_id", urls.role(F.try_parse_url("url", F.lit("PATH")), ROLES).alias("role"))


@query(r"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') AS host FROM pages)
SELECT page_id, array_to_string(string_split(host, '.')[-2:], '.') AS site, host = 'example.org' OR ends_with(host, '.example.org') AS listed FROM h""")
def url_registrable(spark, sf):
    name = urls.host(F.col("url"))
    return pages(spark, sf).select("page_id", urls.registrable(name).alias("site"), urls.on_list(name, ["example.org"]).alias("listed"))


@query("SELECT doc_id, sha256(coalesce(lang, '') || '|' || coalesce(source, '') || '|' || coalesce(text, '')) AS digest FROM documents")
def fingerprint_sha256(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.fingerprint(F.col("lang"), F.col("source"), F.col("text")).alias("digest"))


@query("SELECT p_partkey, CAST(p_size + 0.5 AS DOUBLE) || ',' || CAST(p_size + 10 AS DOUBLE) AS amounts FROM part")
def amounts_extract(spark, sf):
    priced = F.concat(F.lit("from €"), (F.col("p_size") + 10).cast("string"), F.lit(" to "), F.col("p_size").cast("string"), F.lit(",50 euro"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(numbers.amounts(priced), lambda x: x.cast("string")), ",").alias("amounts"))


@query("""SELECT p_name, levenshtein(p_name, 'red widgte') AS distance, levenshtein(p_name, 'red widgte') <= 2 AS near FROM (SELECT DISTINCT p_name FROM part)""")
def levenshtein_match(spark, sf):
    distance = F.levenshtein("p_name", F.lit("red widgte"))
    return table(spark, sf, "part").select("p_name").distinct().select("p_name", distance.cast("bigint").alias("distance"), (distance <= 2).alias("near"))


@query("""SELECT p_name, damerau_levenshtein(p_name, 'red widgte') AS distance FROM (SELECT DISTINCT p_name FROM part)""")
def osa_match(spark, sf):
    names = table(spark, sf, "part").select("p_name").distinct()
    return names.select("p_name", text.osa_distance(F.col("p_name"), F.lit("red widgte")).cast("bigint").alias("distance"))


WORDS = ["rights reserved", "license", "the", "que", "und"]


@query("""SELECT doc_id, array_to_string(list_filter(['rights reserved', 'license', 'the', 'que', 'und'], lambda w: contains(lower(text), w)), ',') AS found FROM documents""")
def keyword_flags(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(text.keywords(F.lower("text"), WORDS), ",").alias("found"))


@query(r"""SELECT doc_id, regexp_extract(text, '(?is)((?:\bthe\b).{0,20}?(?:\bof\b)|(?:\bof\b).{0,20}?(?:\bthe\b))', 1) AS snippet,
 len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?;])\s+', '\1' || chr(10), 'g'), '[\r\n]+'), lambda x: trim(x) <> '')) AS sentences FROM documents""")
def proximity_snippets(spark, sf):
    return documents(spark, sf).select("doc_id", text.near(F.col("text"), r"\bthe\b", r"\bof\b", 20).alias("snippet"), F.size(text.sentences(F.col("text"))).alias("sentences"))


@query("""
WITH n AS (SELECT DISTINCT p_name AS f, string_split(p_name, ' ') AS w FROM part)
SELECT f AS p_name, round(CASE WHEN f = 'blue bolt' THEN 1 WHEN starts_with(f, 'blue bolt') THEN 0.88 WHEN contains(f, 'blue bolt') THEN 0.7
 ELSE greatest(len(list_intersect(['blue', 'bolt'], w)) / 2 * 0.76, coalesce(list_max([CASE WHEN levenshtein(x, 'blue bolt') <= 2 THEN 0.46 + (2 - levenshtein(x, 'blue bolt')) * 0.08 ELSE 0 END for x in w]), 0)) END, 4) AS strength FROM n""")
def match_strengths(spark, sf):
    asked = text.search_form(F.lit("blue bolt"))
    return table(spark, sf, "part").select("p_name").distinct().select("p_name", F.round(text.match_strength(text.search_form(F.col("p_name")), asked), 4).alias("strength"))


@query("SELECT event_id, CAST(floor(epoch_ms(TIMESTAMP '2024-02-15' - ts) / 86400000) AS BIGINT) AS days, strftime(ts, '%Y-%m-%d') AS day, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, floor(value + 0.5) AS rounded FROM (SELECT event_id, value, ts FROM events) WHERE false UNION ALL SELECT event_id, CAST(floor((epoch_ms(TIMESTAMP '2024-02-15') - epoch_ms(ts)) / 86400000) AS BIGINT), strftime(ts, '%Y-%m-%d'), CAST(date_trunc('month', ts) AS TIMESTAMP), CAST(floor(value + 0.5) AS BIGINT) FROM events")
def days_and_rounding(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    end = F.to_timestamp(F.lit("2024-02-15"))
    return e.select(
        "event_id", numbers.whole_days(F.col("ts"), end).cast("bigint").alias("days"), F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month"), numbers.round_half_up(F.col("value")).cast("double").alias("rounded"),
    )


@query(r"""
WITH c AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS plain FROM pages),
t AS (SELECT page_id, plain, replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&nbsp;', ' '), '&quot;', '"'), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS title FROM c)
SELECT page_id, left(trim(regexp_replace(title, '\s+', ' ', 'g')), 300) AS title,
 CAST(least(30, len(list_filter(regexp_extract_all(plain, '(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]>', 1), lambda x: trim(regexp_replace(x, '<[^>]*>', ' ', 'g')) <> ''))) AS INT) AS headings,
 CAST(least(50, len(list_filter(regexp_extract_all(plain, '(?is)<(?:a|button)\b[^>]*>(.*?)</(?:a|button)>', 1), lambda x: length(trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) BETWEEN 2 AND 120))) AS INT) AS actions FROM t""")
def page_evidence(spark, sf):
    found = files.page_evidence(F.col("html"))["evidence"]
    return pages(spark, sf).select("page_id", found["title"].alias("title"), F.size(found["headings"]).alias("headings"), F.size(found["actions"]).alias("actions"))


@query(r"""SELECT page_id, href, label FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]+)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]+)">([^<]*)</a>', 2)) AS label, unnest(range(len(regexp_extract_all(html, '<a href="([^"]+)">([^<]*)</a>', 1)))) AS i FROM pages) QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY i DESC) = 1""")
def page_links(spark, sf):
    return pages(spark, sf).select("page_id", F.inline(files.page_links(F.col("html"))))


@query(r"""
WITH n AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'www.' || p_name || '.gr' WHEN 1 THEN '12345' WHEN 2 THEN 'Gift Card 12345' WHEN 3 THEN p_name || ' | Home' ELSE p_name END AS x FROM part)
SELECT p_partkey, regexp_matches(x, '^www|^12345|^Gift Card|Home$') AS bad_name, regexp_matches(x, '^www|^Gift Card|Home$') AS bad_title,
 CASE p_partkey % 4 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'FAVICON_OR_SITE_ICON' WHEN 2 THEN 'PLACEHOLDER_OR_GENERATED' END AS logo, p_size % 5 IN (1, 2, 3) AS amount FROM n JOIN part USING (p_partkey)""")
def pollution_flags(spark, sf):
    kind, key, n = F.col("p_size") % 6, F.col("p_partkey") % 4, F.col("p_size") % 5
    name = F.when(kind == 0, F.concat(F.lit("www."), "p_name", F.lit(".gr"))).when(kind == 1, "12345").when(kind == 2, "Gift Card 12345").when(kind == 3, F.concat("p_name", F.lit(" | Home"))).otherwise(F.col("p_name"))
    logo = F.when(key == 1, "/FavIcon.ico").when(key == 2, "/img/default_logo.png").when(key == 3, "/img/brand.png")
    url = F.when(n == 1, "https://a.gr/gift-card-50").when(n == 2, "https://a.gr/x?amount=7").when(n == 3, "https://a.gr/kit/100/").otherwise("https://a.gr/gifts?x=7")
    return table(spark, sf, "part").select("p_partkey", text.name_polluted(name).alias("bad_name"), text.title_polluted(name).alias("bad_title"), text.logo_problem(logo).alias("logo"), urls.names_amount(url).alias("amount"))


@query("""SELECT DISTINCT s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'supplier' ELSE 'acme' END AS tokens FROM supplier""")
def brand_tokens(spark, sf):
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("The Official "), F.split("s_name", "#")[0], F.lit(" & Hotels"))).otherwise("Acme e-shop of AE")
    return table(spark, sf, "supplier").select("s_name", F.array_join(text.brand_tokens(name), ",").alias("tokens"))


@query(r"""
WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') AS host FROM pages), l AS (SELECT *, string_split(host, '.') AS l FROM h),
n AS (SELECT *, CASE WHEN host = 'm.example.net' OR ends_with(host, '.m.example.net') THEN 2 WHEN ends_with(host, '.example.net') THEN 3 WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN 2 ELSE 1 END AS n FROM l)
SELECT page_id, CASE WHEN len(l) > n THEN array_to_string(l[-(n + 1):], '.') END AS site FROM n""")
def registrable_by_list(spark, sf):
    rules = spark.createDataFrame([("com",), ("net",), ("org",), ("example.com",), ("*.example.net",), ("!m.example.net",)], "rule string")
    rows = pages(spark, sf).select("page_id", urls.host(F.col("url")).alias("host"))
    return linkage.registrable_domains(rows, "host", rules).select("page_id", "site")
