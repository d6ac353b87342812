"""The curation steps over the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from millrace.functions import text, urls
from millrace.operators import curation
from millrace.plans.scratch import table
from millrace.queries import Registry

query = Registry()
NOW = datetime(2001, 1, 1)


def parts(spark, sf):
    return table(spark, sf, "part")


@query("""
WITH c AS (SELECT p_brand, p_name || '-' || CAST(p_partkey AS VARCHAR) AS url, CASE WHEN p_size % 3 = 0 THEN 'VERIFIED' ELSE 'DRAFT' END AS status, p_size * 2 AS score FROM part),
o AS (SELECT p_brand, min(url) AS forced FROM c WHERE ends_with(url, '7') GROUP BY 1),
b AS (SELECT p_brand, url, score FROM c WHERE status = 'VERIFIED' QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, length(url), url) = 1),
k AS (SELECT o.p_brand, forced, c.score AS s FROM o LEFT JOIN c ON c.p_brand = o.p_brand AND c.url = forced AND status = 'VERIFIED')
SELECT coalesce(b.p_brand, k.p_brand) AS p_brand, CASE WHEN forced IS NULL THEN b.url WHEN s IS NOT NULL THEN forced END AS url, CASE WHEN forced IS NULL THEN b.score WHEN s IS NOT NULL THEN s END AS score,
 CASE WHEN forced IS NULL THEN 'SCORE' WHEN s IS NOT NULL THEN 'OVERRIDE' ELSE 'MANUAL_REVIEW' END AS source FROM b FULL JOIN k ON b.p_brand = k.p_brand""")
def canonicalize(spark, sf):
    rows = parts(spark, sf).select("p_brand", F.concat_ws("-", "p_name", F.col("p_partkey").cast("string")).alias("url"), F.when(F.col("p_size") % 3 == 0, "VERIFIED").otherwise("DRAFT").alias("status"), (F.col("p_size") * 2).alias("points"))
    return curation.canonicalize(rows, rows.filter(F.endswith("url", F.lit("7"))).select("p_brand", "url"), "p_brand", "url", "status", F.col("points"))


@query("""SELECT s_suppkey AS id, s_name AS url, c_name AS old_url, CASE WHEN c_custkey IS NULL THEN 'CREATE' WHEN c_custkey % 2 = 0 THEN 'KEEP' ELSE 'FLAG_URL_CHANGE' END AS action
 FROM supplier LEFT JOIN (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') ELSE c_name END AS c_name FROM customer WHERE c_mktsegment = 'BUILDING') ON c_custkey = s_suppkey""")
def promote(spark, sf):
    known = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Supplier#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))).otherwise(F.col("c_name")).alias("url"))
    return curation.promote(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("url")), known, "id", "url")


@query("""
WITH s AS (SELECT o_custkey AS id, arg_max(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END, (o_orderdate, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END)) AS x,
  max(o_orderdate) AS m FROM orders GROUP BY 1),
last AS (SELECT o_custkey AS id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS digest FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, (CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END) DESC NULLS LAST) = 1),
j AS (SELECT c_custkey AS id, l.digest AS before, CASE WHEN c_custkey % 5 > 0 THEN CASE WHEN c_custkey % 2 = 0 THEN '1-URGENT' ELSE '2-HIGH' END END AS now FROM customer LEFT JOIN last l ON l.id = c_custkey WHERE c_custkey % 3 > 0),
r AS (SELECT id, CASE WHEN now IS NULL THEN 'UNAVAILABLE' WHEN before IS NULL THEN 'BASELINE' WHEN before = now THEN 'UNCHANGED' ELSE 'CHANGED' END AS outcome FROM j)
SELECT id, outcome, CAST(DATE '2001-01-01' + CASE WHEN outcome IN ('CHANGED', 'UNAVAILABLE') THEN 7 ELSE 30 END AS DATE) AS next_review FROM r""")
def reverify(spark, sf):
    due = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.lit("2001-05-01")).when(F.col("c_custkey") % 3 == 1, F.lit("2000-05-01")).cast("timestamp").alias("next_review"))
    old = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("at"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("digest"))
    new = due.select("id", F.when(F.col("id") % 5 > 0, F.when(F.col("id") % 2 == 0, "1-URGENT").otherwise("2-HIGH")).alias("digest"))
    return curation.reverify(due, old, new, "id", NOW)


@query("""SELECT p_partkey, least(100, CASE WHEN p_size > 25 THEN 30 ELSE 0 END + 20 + CASE WHEN p_size % 4 > 1 THEN 40 WHEN p_size % 4 = 1 THEN 30 ELSE 0 END + least(10, p_size % 3 * 5) + CASE WHEN contains(p_name, 'ring') THEN 10 ELSE 0 END) AS score,
 greatest(0, least(100, CASE WHEN contains(p_name, 'red') THEN 45 ELSE 0 END + CASE WHEN p_size > 10 THEN 35 ELSE 0 END - CASE WHEN p_size > 45 THEN 70 ELSE 0 END)) AS found FROM part""")
def candidate_scores(spark, sf):
    size = F.col("p_size")
    score = curation.candidate_score(size > 25, F.lit(True), size % 4, size % 3, F.contains("p_name", F.lit("ring")))
    found = curation.result_score([(F.contains("p_name", F.lit("red")), 45), (size > 10, 35), (size > 45, -70)])
    return parts(spark, sf).select("p_partkey", score.alias("score"), found.alias("found"))


@query("""SELECT page_id, CASE WHEN page_id % 50 = 1 THEN 'NOT_FOUND' WHEN page_id % 50 = 2 THEN 'ACCESS_DENIED' WHEN page_id % 50 = 3 THEN 'ERROR_PAGE' WHEN contains(lower(html), 'access denied') THEN 'ACCESS_DENIED' WHEN contains(lower(html), 'captcha') THEN 'BLOCKED' WHEN length(trim(html)) < 80 THEN 'EMPTY' ELSE 'OK' END AS state FROM pages""")
def page_states(spark, sf):
    n = F.col("page_id") % 50
    status = F.when(n == 1, 404).when(n == 2, 403).when(n == 3, 503).otherwise(200)
    state = curation.page_state(status, F.col("html"), "page not found anywhere", "access denied", "captcha", "internal server error")
    return table(spark, sf, "pages").select("page_id", state.alias("state"))


@query("""SELECT event_id, CASE WHEN event_type IN ('view', 'click') AND user_id % 2 = 0 AND value >= 20 THEN 'VERIFIED' WHEN event_type IN ('view', 'click') AND user_id % 2 = 1 AND value >= 30 THEN 'NON_CANONICAL' WHEN event_type NOT IN ('view', 'click') AND value >= 25 THEN 'REJECTED' ELSE 'REVIEW' END AS verdict FROM events""")
def verification_table(spark, sf):
    verdict = F.when(F.col("event_type").isin("view", "click"), "yes").otherwise("no")
    out = curation.verification(F.col("value"), verdict, F.col("user_id") % 2 == 0, 20, 25, 30)
    return table(spark, sf, "events").select("event_id", out.alias("verdict"))


@query("""
WITH g AS (SELECT user_id, count(*) AS impressions, count(*) FILTER (event_type = 'click') AS clicks, user_id % 25 AS position FROM events GROUP BY 1),
o AS (SELECT *, CASE WHEN NOT (impressions >= 10 AND position > 0 AND position <= 20) THEN NULL WHEN floor(clicks / impressions * 10000 + 0.5) / 100 < 3 AND position <= 10 THEN 'CTR' WHEN position BETWEEN 4 AND 10 THEN 'TOP_TEN' WHEN position > 10 THEN 'SECOND_PAGE' END AS kind FROM g)
SELECT user_id, kind, impressions, clicks, position FROM o WHERE kind IS NOT NULL ORDER BY kind, impressions DESC, clicks DESC, position, user_id LIMIT 50""")
def seo_opportunities(spark, sf):
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("impressions"), F.count_if(F.col("event_type") == "click").alias("clicks")).withColumn("position", F.col("user_id") % 25)
    kinds = rows.withColumn("kind", curation.opportunity(F.col("impressions"), F.col("clicks"), F.col("position"))).filter("kind is not null")
    return kinds.orderBy("kind", F.desc("impressions"), F.desc("clicks"), "position", "user_id").limit(50)


@query("""
WITH g AS (SELECT starts_with(p_name, 'red') AS branded, CAST(sum(p_size) AS BIGINT) AS clicks, CAST(sum(p_size * 10) AS BIGINT) AS impressions FROM part GROUP BY 1)
SELECT branded, clicks, impressions, floor(clicks / impressions * 10000 + 0.5) / 100 AS ctr, floor(clicks / (SELECT sum(clicks) FROM g) * 1000 + 0.5) / 10 AS share FROM g""")
def branded_split(spark, sf):
    rows = parts(spark, sf).select("p_name", F.col("p_size").alias("c"), (F.col("p_size") * 10).alias("i"))
    return curation.branded_split(rows, "p_name", "^red", "c", "i")


@query("""
WITH r AS (SELECT s_suppkey AS seq, CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE 'd' || CAST(s_nationkey AS VARCHAR) END AS domain, 'n' || CAST(s_suppkey % 50 AS VARCHAR) AS name FROM supplier),
e AS (SELECT n_nationkey AS id, 'd' || CAST(n_nationkey * 2 AS VARCHAR) AS domain, 'n' || CAST(n_nationkey AS VARCHAR) AS name FROM nation), f AS (SELECT domain, min(seq) AS o FROM r WHERE domain <> '' GROUP BY 1)
SELECT seq, CASE WHEN r.domain = '' THEN 'SKIP_NO_DOMAIN' WHEN seq <> o THEN 'SKIP_IN_RUN' WHEN a.id IS NOT NULL OR b.id IS NOT NULL THEN 'REUSE' ELSE 'CREATE' END AS action
FROM r LEFT JOIN f ON f.domain = r.domain LEFT JOIN e a ON a.domain = r.domain LEFT JOIN e b ON b.name = r.name""")
def bulk_plan(spark, sf):
    s = table(spark, sf, "supplier")
    rows = s.select(F.col("s_suppkey").alias("seq"), F.when(F.col("s_suppkey") % 9 == 0, "").otherwise(F.concat(F.lit("d"), F.col("s_nationkey").cast("string"))).alias("domain"), F.concat(F.lit("n"), (F.col("s_suppkey") % 50).cast("string")).alias("name"))
    known = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("d"), (F.col("n_nationkey") * 2).cast("string")).alias("domain"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"))
    return curation.bulk_plan(rows, known, "domain", "name", "seq").select("seq", "action")


@query("""
WITH k AS (SELECT o_custkey, max(CAST(o_orderstatus = 'F' AS INT)) AS f, max(CAST(o_orderstatus = 'O' AS INT)) AS o, max(CAST(o_orderstatus = 'P' AS INT)) AS p FROM orders GROUP BY 1)
SELECT count(*) AS entities, CAST(sum(f) AS BIGINT) AS F, CAST(sum(o) AS BIGINT) AS O, CAST(sum(p) AS BIGINT) AS P, count(*) FILTER (f + o + p > 1) AS overlapping FROM k""")
def progress_audit(spark, sf):
    rows = table(spark, sf, "orders").select(F.lit("").alias("domain"), F.lit(None).cast("string").alias("name"), F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return curation.progress(rows, "domain", "name", "id", ["F", "O", "P"])


@query("""
WITH l AS (SELECT p_name, count(*) AS listings, string_agg(DISTINCT p_brand, ' | ' ORDER BY p_brand) AS domains, count(DISTINCT p_brand) AS n, string_agg(DISTINCT p_type, ' | ' ORDER BY p_type) AS kinds FROM part GROUP BY 1)
SELECT p_name AS issuer, listings, domains, kinds, CASE WHEN n = 1 THEN 90 WHEN n = 0 THEN 40 ELSE 60 END + CASE WHEN listings > 1 THEN 10 ELSE 0 END AS confidence FROM l""")
def issuer_groups(spark, sf):
    return curation.issuers(parts(spark, sf), "p_name", F.col("p_brand"), F.col("p_size"), F.col("p_type")).select("issuer", "listings", "domains", "kinds", "confidence")


@query("""
WITH c AS (SELECT l_orderkey, count(DISTINCT l_returnflag) AS n, min(l_returnflag) AS s FROM lineitem GROUP BY 1)
SELECT l_orderkey, t AS "to" FROM c JOIN (VALUES ('A', 'done'), ('A', 'paid'), ('N', 'open')) AS r(s, t) USING (s) WHERE n = 1""")
def expand_primary(spark, sf):
    rules = spark.createDataFrame([("A", "done"), ("A", "paid"), ("N", "open")], "l_returnflag string, to string")
    return curation.expand_primary(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag", rules)[0]


@query("""
WITH v AS (SELECT p_brand, p_type, max(p_size) AS s FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY s DESC, p_type DESC) AS k FROM v)
SELECT p_brand, max(p_type) FILTER (k = 1) AS p_type, max(s) FILTER (k = 1) AS s FROM r GROUP BY 1 HAVING max(s) FILTER (k = 1) >= 40 AND max(s) FILTER (k = 1) - coalesce(max(s) FILTER (k = 2), 0) >= 1""")
def accepted_assets(spark, sf):
    best = parts(spark, sf).groupBy("p_brand", "p_type").agg(F.max("p_size").alias("s"))
    return curation.accepted_asset(best, "p_brand", "p_type", "s", 40, 1)


@query(r"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') AS host, lower(regexp_extract(url, '://[^/?#]*([^?#]*)', 1)) AS path FROM pages)
SELECT page_id, CASE WHEN regexp_matches(path, '(^|/)fr([-_/]|$)') THEN 'HOME' WHEN regexp_matches(host, '\.(com|net|org|eu|io|shop)$') THEN 'GLOBAL' ELSE 'FOREIGN_ONLY' END AS market FROM h""")
def url_market(spark, sf):
    return table(spark, sf, "pages").select("page_id", curation.market(urls.host(F.col("url")), F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")), "fr").alias("market"))


@query("""SELECT s.s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'note [E] x' WHEN s_suppkey % 4 = 1 THEN 'note' || chr(10) || '[E] seen' ELSE 'note' END AS note, CASE WHEN s_suppkey % 2 = 0 THEN 'u' WHEN s_suppkey % 4 = 1 THEN 'new' END AS url FROM supplier s""")
def merge_evidence(spark, sf):
    k = F.col("s_suppkey") % 4
    rows = table(spark, sf, "supplier").select("s_suppkey", F.when(k == 0, "note [E] x").otherwise("note").alias("note"), F.when(F.col("s_suppkey") % 2 == 0, "u").alias("url"))
    new = rows.filter(k.isin(0, 1)).select("s_suppkey", F.lit("seen").alias("note"), F.lit("new").alias("url"))
    return curation.merge_evidence(rows, new, "s_suppkey", "note", "url", "[E]")


@query("""SELECT DISTINCT n_nationkey, r_name AS place, c AS capability FROM nation JOIN region ON n_regionkey = r_regionkey, unnest(CASE WHEN n_nationkey % 2 = 0 THEN ['pay', 'collect'] ELSE ['pay'] END) AS t(c)""")
def capability_rows(spark, sf):
    n = table(spark, sf, "nation")
    places = n.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("place"))
    found = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("pay"), F.lit("collect"))).otherwise(F.array(F.lit("pay")))
    return curation.capabilities(n, places, "n_nationkey", found)


@query("""
WITH r AS (SELECT user_id, epoch_ms(max(ts)) AS stage_at, epoch_ms(max(ts) FILTER (event_type = 'click')) AS sent_at, count(*) FILTER (event_type = 'signup') AS sent FROM events GROUP BY 1),
a AS (SELECT *, greatest(0, floor((epoch_ms(TIMESTAMP '2024-02-02') - stage_at) / 86400000)) AS age, greatest(0, floor((epoch_ms(TIMESTAMP '2024-02-02') - sent_at) / 86400000)) AS waited FROM r)
SELECT user_id, CASE WHEN sent > 10 THEN 'LATE' ELSE 'EARLY' END AS stage, CAST(age AS BIGINT) AS age, sent < 6 AND CASE WHEN sent_at IS NULL THEN age >= 2 ELSE waited >= 4 END AS due FROM a""")
def follow_up_list(spark, sf):
    kind = F.col("event_type")
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("stage_at"), F.max(F.when(kind == "click", F.col("ts").cast("timestamp"))).alias("last_sent"), F.count_if(kind == "signup").alias("sent"))
    return curation.follow_ups(rows, F.when(F.col("sent") > 10, "LATE").otherwise("EARLY"), "stage_at", "last_sent", "sent", datetime(2024, 2, 2)).select("user_id", "stage", "age", "due")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'NO_VERIFIED_LOCATION' WHEN c_custkey % 5 = 0 THEN 'NO_OFFICIAL_URL' WHEN c_custkey % 11 = 0 THEN 'FETCH_FAILED' WHEN c_nationkey = 3 THEN 'ONLINE_ONLY_SIGNAL'
 WHEN c_nationkey > 20 THEN 'NO_GIFT_CARD_IN_STORE_EVIDENCE' WHEN c_custkey % 7 > 1 AND c_acctbal < 0 THEN 'AMBIGUOUS_LOCATION_SCOPE' ELSE 'SAFE_TO_APPLY' END AS decision FROM customer""")
def capability_decisions(spark, sf):
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    url = F.when(c % 5 == 0, F.when(c % 2 == 0, "ftp://a.gr")).otherwise("HTTPS://a.gr")
    found = F.when(n > 20, F.array().cast("array<string>")).otherwise(F.array(F.lit("pay")))
    decision = curation.capability_decision(c % 7, url, c % 11 != 0, n == 3, found, F.col("c_acctbal") >= 0)
    return table(spark, sf, "customer").select("c_custkey", decision.alias("decision"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'a |  b | [REVIEW:ACCEPTED]' WHEN 1 THEN '[REVIEW:ACCEPTED]' ELSE 'Score=' || CAST(s_suppkey AS VARCHAR) || ' confidence: 7 | [REVIEW:ACCEPTED]' END AS notes,
 CASE s_suppkey % 3 WHEN 2 THEN s_suppkey END AS number FROM supplier""")
def tagged_notes(spark, sf):
    k = F.col("s_suppkey")
    notes = F.when(k % 3 == 0, "a | [REVIEW:REJECTED] | b").when(k % 3 == 2, F.concat(F.lit("Score="), k.cast("string"), F.lit(" confidence: 7")))
    set_notes = text.set_tag(notes, "REVIEW", F.lit("ACCEPTED"))
    return table(spark, sf, "supplier").select("s_suppkey", set_notes.alias("notes"), text.first_number(set_notes, [r"(?i)score=(\d+)", r"(?i)confidence[=:]\s*(\d+)"]).alias("number"))
