"""Queries over single functions: normal forms of texts, numbers, addresses, URLs, validity, choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import numbers, offers, places, text, urls
from millrace.operators import crawl, curation, find, linkage, rank
from millrace.plans.scratch import table
from millrace.queries import Registry

query = Registry()


def part(spark, sf):
    return table(spark, sf, "part")


@query("""
SELECT p_partkey, p_name || ' and ομιλοσ e shop b ' || t || ' b οε ltd' AS search, p_name || ' and omilos e shop b ' || t || ' b oe ltd' AS latin, p_name || ' & ομιλος e-shop <b>' || t || '</b> οε ltd' AS label,
 p_name || ' and ομιλοσ b ' || t || ' b οε ltd' AS shop, p_name || ' ομιλοσ e shop b ' || t || ' b οε' AS firm, p_name || ' & Όμιλος E-Shop ' || p_type || ' ΟΕ Ltd' AS plain
FROM (SELECT *, lower(p_type) AS t FROM part)""")
def text_forms(spark, sf):
    """Each normal form of one text with Greek, accents, marks and tags in it."""
    x = F.concat("p_name", F.lit("  &amp; Όμιλος E-Shop <b>"), "p_type", F.lit("</b> ΟΕ Ltd"))
    raw = F.replace(x, F.lit("&amp;"), F.lit("&"))
    return part(spark, sf).select(
        "p_partkey",
        text.search_form(raw).alias("search"),
        text.greek_to_latin(raw).alias("latin"),
        text.label_form(raw).alias("label"),
        text.shop_name(raw).alias("shop"),
        text.firm_name(x).alias("firm"),
        text.strip_tags(x).alias("plain"),
    )


@query("""SELECT p_partkey, lower(p_type) || CASE p_type WHEN 'SMALL' THEN ',tiny,mini' WHEN 'ECONOMY' THEN ',cheap,budget' ELSE '' END AS forms FROM part""")
def alias_expansion(spark, sf):
    groups = [["small", "tiny", "mini"], ["cheap", "economy", "budget"]]
    return part(spark, sf).select("p_partkey", F.array_join(F.array_distinct(text.alias_forms(F.lower("p_type"), groups)), ",").alias("forms"))


@query(r"""
WITH h AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') AS host FROM pages)
SELECT page_id, host <> '' AND starts_with(url, 'http') AS plain, false AS with_password, false AS by_ftp, false AS script, host = 'example.net' OR ends_with(host, '.example.net') AS listed FROM h""")
def url_safety(spark, sf):
    """Which URLs are public, as they stand and with a password, another scheme, a script; and which are on a list of hosts."""
    url = F.col("url")
    other = lambda x: F.regexp_replace(url, "^https?://", x)
    kinds = {"plain": url, "with_password": other("https://u:p@"), "by_ftp": other("ftp://"), "script": F.concat(F.lit("javascript:"), url)}
    listed = urls.on_list(urls.host(url), ["example.net", "nowhere.example.org"])
    return table(spark, sf, "pages").select("page_id", *[urls.is_public_http(u).alias(n) for n, u in kinds.items()], listed.alias("listed"))


@query("""
SELECT p_partkey, CAST(p_size * 1000 + p_partkey % 1000 AS DOUBLE) AS thousands, CAST(p_size + 0.5 AS DOUBLE) AS decimals, CAST(NULL AS DOUBLE) AS none, p_name AS first_part, CAST(p_size AS VARCHAR) AS last_number,
 CASE p_size % 5 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'INCOMPLETE' WHEN 2 THEN 'ZERO' WHEN 3 THEN 'OUTSIDE' ELSE 'OK' END AS place,
 p_type NOT IN ('SMALL', 'PROMO') AS valid, 'street ' || p_size || ' 10563|odos 7' AS chunks,
 CASE p_size % 4 WHEN 0 THEN 'SAFE' WHEN 1 THEN 'REVIEW' ELSE 'REJECT' END AS address FROM part""")
def value_forms(spark, sf):
    """Numbers with either mark, parts of lists, coordinates, names, and addresses."""
    size, name = F.col("p_size"), F.col("p_name")
    text_of = lambda c: c.cast("string")
    kind = size % 5
    lat = F.when(kind == 0, F.lit(None)).when(kind == 2, 0.0).when(kind == 3, 60.0).otherwise(38.0)
    lon = F.when(kind.isin(0, 1), F.lit(None)).when(kind == 2, 0.0).otherwise(23.7)
    shop = F.when(F.col("p_type") == "SMALL", " SHOP ").when(F.col("p_type") == "PROMO", "Online  Store").otherwise(name)
    address = F.concat(F.lit("Welcome to us street "), text_of(size), F.lit(" 10563 odos without one odos 7"))
    line = F.when(size % 4 == 3, "returns policy 12 10563").otherwise(name)
    sort = curation.address_class(F.concat(line, F.lit(" street")), size % 4 == 0, size % 4 < 2, "returns policy")
    return part(spark, sf).select(
        "p_partkey",
        numbers.parse_number(F.concat(text_of(size), F.lit("."), F.lpad(text_of(F.col("p_partkey") % 1000), 3, "0"))).alias("thousands"),
        numbers.parse_number(F.concat(text_of(size), F.lit(" ,5"))).alias("decimals"),
        numbers.parse_number(name).alias("none"),
        text.first_of_pipes(F.concat(F.lit(" |  | "), name, F.lit(" | x"))).alias("first_part"),
        text.last_match(F.concat(F.lit("#1 of #"), text_of(size), F.lit(" #")), r"#(\d+)").alias("last_number"),
        numbers.coordinates_state(lat, lon, (34.0, 19.0, 42.0, 29.0)).alias("place"),
        places.valid_name(shop, ["shop"], ["online", "store"]).alias("valid"),
        F.array_join(places.address_chunks(address, "street|odos"), "|").alias("chunks"),
        sort["bucket"].alias("address"),
    )


@query("""
SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1997-06-01' AND (o_orderstatus = 'P' OR o_orderdate + INTERVAL 90 DAY > TIMESTAMP '1997-06-01')""")
def valid_intervals(spark, sf):
    """Orders in force at a moment: open ones without an end, others for 90 days."""
    end = F.when(F.col("o_orderstatus") != "P", F.expr("o_orderdate + INTERVAL 90 DAYS"))
    return table(spark, sf, "orders").filter(numbers.covers(F.col("o_orderdate"), end, F.to_timestamp(F.lit("1997-06-01")).cast("timestamp_ntz"))).select("o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_totalprice DESC, o_orderkey) = 1")
def best_by_status(spark, sf):
    return linkage.best_match(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "F", "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def find_first_row(spark, sf):
    found = find.find_first(table(spark, sf, "orders"), {"o_orderstatus": "F"}, [{"o_totalprice": "desc"}, {"o_orderkey": "asc"}])
    return found.select("o_orderkey", "o_custkey")


@query("""
WITH RECURSIVE s AS (SELECT user_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) AS k, count(*) OVER (PARTITION BY user_id) AS c FROM events QUALIFY k <= 12),
f AS (SELECT user_id, k, c, t AS last, [event_type] AS kinds FROM s WHERE k = 1 UNION ALL
 SELECT s.user_id, s.k, s.c, CASE WHEN len(kinds) < 3 AND last - t >= 14400000000 THEN t ELSE last END, CASE WHEN len(kinds) < 3 AND last - t >= 14400000000 THEN list_append(kinds, event_type) ELSE kinds END FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1),
e AS (SELECT user_id, arg_max(kinds, k) AS kinds, least(any_value(c), 12) AS n FROM f GROUP BY 1)
SELECT user_id, CASE WHEN n < 3 THEN 'NOT_ENOUGH_OBSERVATIONS' WHEN len(kinds) < 3 THEN 'SPACING_NOT_MET' WHEN len(list_distinct(kinds)) = 1 THEN 'STABLE' ELSE 'UNSTABLE_FETCH' END AS reason,
 n >= 3 AND len(kinds) = 3 AND len(list_distinct(kinds)) = 1 AS stable, CAST(CASE WHEN n < 3 THEN n ELSE len(kinds) END AS INT) AS count FROM e""")
def fetch_stability(spark, sf):
    """Whether each user's last events, four hours apart, are of one kind."""
    return rank.fetch_stability(table(spark, sf, "events"), "user_id", "ts", "event_type", 4 * 3600).select("user_id", "reason", "stable", "count")


@query(r"""
WITH u AS (SELECT page_id, regexp_extract(lower(url), '://([^/?#]*)', 1) AS host, regexp_replace(url, '^[^:]*://[^/?#]*', '') AS path FROM pages),
r AS (SELECT *, CASE WHEN regexp_matches(path, '^/fr/.*1.*0') THEN 8 ELSE 0 END AS yes, greatest(CASE WHEN starts_with(path, '/fr/') THEN 4 ELSE 0 END, CASE WHEN contains(path, 'ref=x') THEN 7 ELSE 0 END, CASE WHEN regexp_matches(path, '^/en/.*5$') THEN 7 ELSE 0 END) AS no FROM u),
a AS (SELECT *, host IN (SELECT host FROM u GROUP BY 1 HAVING min(page_id) % 2 = 0) AS ruled FROM r), v AS (SELECT page_id, host, NOT ruled OR yes >= no AS allowed FROM a),
s AS (SELECT page_id, row_number() OVER (PARTITION BY host ORDER BY page_id) AS slot FROM v WHERE allowed QUALIFY slot <= 12)
SELECT page_id, allowed, slot FROM v LEFT JOIN s USING (page_id)""")
def robots_plan(spark, sf):
    """Which pages may be fetched by their hosts' robots.txt, and the turn of each: twelve of a host."""
    url = F.col("url")
    urls = table(spark, sf, "pages").select("page_id", F.regexp_extract(F.lower(url), "://([^/?#]*)", 1).alias("site"), F.regexp_replace(url, "^[^:]*://[^/?#]*", "").alias("path"))
    mine = "User-agent: *\nDisallow: /\n\n# ours\nUser-Agent: other\nUSER-AGENT: Mill\nDisallow: /fr/\nAllow: /fr/*1*0 # these\ncrawl-delay: 5\nDisallow: /*ref=x\nDisallow: /en/*5$\nDisallow:\n"
    texts = urls.groupBy("site").agg(F.when(F.min("page_id") % 2 == 0, mine).otherwise("User-agent: elsewhere\r\nDisallow: /\r\n").alias("text"))
    rules = crawl.robots_rules(texts, "site", "text", "mill")
    return crawl.fetch_plan(crawl.may_fetch(urls, "page_id", "site", "path", rules), "page_id", "site", []).select("page_id", "allowed", "slot")


@query("""
SELECT p_partkey, array_to_string(list_transform(list_sort(list_distinct(CASE WHEN p_size >= 5 THEN [p_size, p_size + 1000] ELSE [p_size + 1000] END)), lambda x: CAST(x AS VARCHAR)), ',') AS title,
 array_to_string(list_transform(CASE WHEN p_size >= 5 THEN [p_size] ELSE [] END, lambda x: CAST(x AS VARCHAR)), ',') AS url, CASE p_size % 4 WHEN 0 THEN 'GBP' WHEN 1 THEN 'EUR' WHEN 2 THEN 'CHF' END AS currency,
 CASE WHEN p_size % 7 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) || 'B' END AS number FROM part""")
def offer_amounts(spark, sf):
    """Amounts in titles and URLs, currencies in the order of their list, and street numbers before postal codes."""
    size = F.col("p_size").cast("string")
    title = F.concat(F.lit("Gift  Card no "), size, F.lit(" or 1."), F.lpad(size, 3, "0"), F.lit(" € of 20000 eur"))
    url = F.concat(F.lit("https://x.example/gift-card/"), size, F.lit("eur/p123x"))
    money = F.when(F.col("p_size") % 4 == 0, "5 eur or £").when(F.col("p_size") % 4 == 1, "5 e").when(F.col("p_size") % 4 == 2, "$ CHF").otherwise("5 of them")
    address = F.when(F.col("p_size") % 7 == 0, "Plateia 0, 105 63").otherwise(F.concat(F.lit("Stoa 7, Ermou "), size, F.lit("B, 700 steps, 105 63 Athens 12")))
    whole = lambda xs: F.array_join(F.transform(xs, lambda x: x.cast("bigint").cast("string")), ",")
    return part(spark, sf).select("p_partkey", whole(offers.title_amounts(title)).alias("title"), whole(offers.url_amounts(url)).alias("url"), offers.currency(money).alias("currency"), places.number_near_postal(address).alias("number"))


@query(r"""
WITH l AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)
SELECT doc_id, CASE WHEN contains(t, 'the') THEN 18 ELSE 0 END + CASE WHEN contains(t, 'and') THEN 18 ELSE 0 END + CASE WHEN contains(t, 'que') OR contains(t, 'und') THEN -60 ELSE 0 END
 + CASE WHEN regexp_matches(t, 'licen[sc]e|rights') THEN -18 ELSE 0 END + CASE WHEN regexp_matches(t, '@[a-z]') THEN 22 ELSE 0 END AS score FROM l""")
def link_scores(spark, sf):
    """Points by hints: each of some, one for any of others, and patterns."""
    score = curation.link_score(F.col("text"), [(["the", "and"], 18, True), (["que", "und"], -60, False)], [("licen[sc]e|rights", -18), ("@[a-z]", 22)])
    return table(spark, sf, "documents").select("doc_id", score.alias("score"))


@query("SELECT p_partkey FROM part WHERE p_size > 5 AND contains(p_name, 'ring') AND p_type = 'SMALL' ORDER BY p_partkey LIMIT 10 OFFSET 10")
def optional_filters(spark, sf):
    """The second page of a filter made of the parameters that a request has."""
    given = {"q": [" RING ", "x"], "type": "SMALL", "brand": "  ", "page": " 2 "}
    builders = {
        "q": lambda v: {"OR": [{"p_name": {"contains": v, "mode": "insensitive"}}, {"p_brand": {"contains": v, "mode": "insensitive"}}]},
        "type": lambda v: {"p_type": v},
        "brand": lambda v: {"p_brand": v},
    }
    spec = find.optional_filter({"p_size": {"gt": 5}}, given, builders)
    start = (find.page_number(given["page"]) - 1) * 10
    return find.find_many(part(spark, sf), spec, order_by=[{"p_partkey": "asc"}], skip=start, take=10).select("p_partkey")
