"""Linkage, classification, search and the decision steps of the curation pipeline."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.functions import numbers, text, urls
from millrace.operators import anchors, classify, linkage, recommend, search
from millrace.operators.postings import SearchIndex
from millrace.operators.rank import first_per_key, hash_changes
from millrace.plans import scratch
from millrace.plans.changes import Plan, upsert
from millrace.plans.scratch import table
from millrace.queries import Registry

query = Registry()


def part(spark, sf):
    return table(spark, sf, "part")


@query("SELECT sha256(coalesce(text, '')) AS fingerprint, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedupe_fingerprint(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return linkage.dedupe_fingerprint(docs, text.fingerprint(F.col("text")), [F.col("doc_id")]).select("fingerprint", "doc_id")


@query("""SELECT p_name, arg_max(p_brand, (p_size, -p_partkey)) AS p_brand, arg_max(p_size, (p_size, -p_partkey)) FILTER (p_size < 40) AS small, count(*) AS n_merged FROM part GROUP BY 1""")
def merge_by_priority(spark, sf):
    rows = part(spark, sf).withColumn("small", F.when(F.col("p_size") < 40, F.col("p_size")))
    return linkage.merge_by_priority(rows, "p_name", F.col("p_size"), "p_partkey", ["p_brand", "small"])


@query("SELECT p_brand, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS p_partkey FROM part GROUP BY 1")
def best_per_key(spark, sf):
    return linkage.best_per_key(part(spark, sf), "p_brand", "p_retailprice", "p_partkey").select("p_brand", "p_partkey")


@query("""
WITH l AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey + 100 ELSE s_nationkey END AS k, 'NATION_' || CAST(s_suppkey % 40 AS VARCHAR) AS name FROM supplier)
SELECT s_suppkey, coalesce(a.n_nationkey, b.n_nationkey) AS match_id, CASE WHEN a.n_nationkey IS NOT NULL THEN 'k' WHEN b.n_nationkey IS NOT NULL THEN 'name' END AS match_key
FROM l LEFT JOIN nation a ON l.k = a.n_nationkey LEFT JOIN nation b ON l.name = b.n_name""")
def two_key_match(spark, sf):
    key = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_nationkey") + 100).otherwise(F.col("s_nationkey"))
    left = table(spark, sf, "supplier").select("s_suppkey", key.alias("k"), F.concat(F.lit("NATION_"), (F.col("s_suppkey") % 40).cast("string")).alias("name"))
    out = linkage.two_key_match(left, table(spark, sf, "nation"), [("k", "n_nationkey"), ("name", "n_name")], "n_nationkey")
    return out.select("s_suppkey", "match_id", "match_key")


@query("""
WITH p AS (SELECT p_partkey, p_brand || '#' || CAST(p_size AS VARCHAR) AS strong, p_name || CAST(p_size AS VARCHAR) AS weak FROM part),
s AS (SELECT strong, count(*) AS n FROM p GROUP BY 1 HAVING count(*) > 1), w AS (SELECT weak, count(*) AS n FROM p GROUP BY 1 HAVING count(*) > 1 AND NOT (min(strong) = max(strong) AND min(strong) IN (SELECT strong FROM s)))
SELECT 'strong' AS kind, strong AS key, n, p_partkey AS id FROM p JOIN s USING (strong) UNION ALL SELECT 'weak', weak, n, p_partkey FROM p JOIN w USING (weak)""")
def clusters_exact(spark, sf):
    rows = part(spark, sf).select("p_partkey", F.concat("p_brand", F.lit("#"), F.col("p_size").cast("string")).alias("strong"), F.concat("p_name", F.col("p_size").cast("string")).alias("weak"))
    return linkage.duplicate_clusters(rows, "p_partkey", "strong", "weak")


@query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey WHERE abs(a.p_size - b.p_size) <= 3")
def pairs_similarity(spark, sf):
    return linkage.pairs_in_block(part(spark, sf), "p_partkey", ["p_name", "p_brand"], ["p_size"], lambda a, b: F.abs(a("p_size") - b("p_size")) <= 3, near=("p_size", 3))


@query("""
WITH RECURSIVE e AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey WHERE abs(a.p_size - b.p_size) <= 3),
r AS (SELECT a AS node, a AS g FROM e UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.node)
SELECT node, min(g) AS "group" FROM r GROUP BY node""")
def components(spark, sf):
    return linkage.components(linkage.chain_links(part(spark, sf), "p_partkey", ["p_name", "p_brand"], ("p_size", 3)))


@query("""SELECT p_partkey, CASE WHEN p_size < 5 THEN 'REJECT' WHEN contains(p_name, 'red') AND p_retailprice > 950 THEN 'AUTO' WHEN p_size > 45 THEN 'AUTO' ELSE 'REVIEW' END AS bucket,
 CASE WHEN p_size < 5 THEN 'too small' WHEN contains(p_name, 'red') AND p_retailprice > 950 THEN 'red and dear' WHEN p_size > 45 THEN 'large' ELSE 'no rule' END AS reason FROM part""")
def rule_bucket(spark, sf):
    size = F.col("p_size")
    clauses = [(size < 5, "REJECT", "too small"), (F.contains("p_name", F.lit("red")) & (F.col("p_retailprice") > 950), "AUTO", "red and dear"), (size > 45, "AUTO", "large")]
    return part(spark, sf).select("p_partkey", classify.guarded(clauses, ("REVIEW", "no rule")).alias("v")).select("p_partkey", "v.*")


@query("""SELECT p_partkey, least(CASE WHEN p_size < 10 THEN 35 ELSE 100 END, CAST(contains(p_name, 'blue') AS INT) * 45 + CAST(p_retailprice > 1000 AS INT) * 35 + CAST(p_size >= 20 AS INT) * 10) AS score,
 array_to_string(list_filter([CASE WHEN contains(p_name, 'blue') THEN 'blue' END, CASE WHEN p_retailprice > 1000 THEN 'dear' END, CASE WHEN p_size >= 20 THEN 'large' END], lambda x: x IS NOT NULL), ',') AS reasons FROM part""")
def additive_score(spark, sf):
    parts = [(F.contains("p_name", F.lit("blue")), 45, "blue"), (F.col("p_retailprice") > 1000, 35, "dear"), (F.col("p_size") >= 20, 10, "large")]
    scored = classify.additive(parts, 100, [(F.col("p_size") < 10, 35)])
    return part(spark, sf).select("p_partkey", scored.alias("v")).select("p_partkey", "v.score", F.array_join("v.reasons", ",").alias("reasons"))


@query("""
WITH s AS (SELECT p_partkey, 'colour' AS c, CASE WHEN regexp_matches(p_name, 'red|blue') THEN 98 END AS x FROM part UNION ALL
 SELECT p_partkey, 'colour', CASE WHEN regexp_matches(p_type, 'ECO') THEN 105 WHEN regexp_matches(p_name, 'ECO') THEN 108 END FROM part UNION ALL
 SELECT p_partkey, 'thing', CASE WHEN regexp_matches(p_name, 'bolt|ring') THEN 128 END FROM part),
g AS (SELECT p_partkey, c, max(x) + 3 * (count(x) - 1) AS points FROM s WHERE x IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY points DESC, c DESC) AS k FROM g)
SELECT p_partkey, max(c) FILTER (k = 1) AS winner, max(points) FILTER (k = 1) AS top, coalesce(max(points) FILTER (k = 2), 0) AS second,
 max(points) FILTER (k = 1) >= 100 AND max(points) FILTER (k = 1) - coalesce(max(points) FILTER (k = 2), 0) >= 18 AS decided FROM r GROUP BY 1""")
def taxonomy_margin(spark, sf):
    rules = [("colour", "red|blue", 90), ("colour", "ECO", 100), ("thing", "bolt|ring", 120)]
    return classify.taxonomy(part(spark, sf), "p_partkey", rules, {"p_name": 8, "p_type": 5})


@query("""
WITH s AS (SELECT c_custkey, 25 * CAST(c_acctbal > 0 AS INT) + 25 * CAST(c_acctbal > 1000 AS INT) + 15 * CAST(c_mktsegment <> 'FURNITURE' AS INT) + 35 * CAST(c_nationkey < 20 AS INT) AS score, c_acctbal, c_mktsegment FROM customer)
SELECT c_custkey, score, score >= 80 AND c_acctbal > 0 AS ready, concat_ws(',', CASE WHEN c_acctbal <= 0 THEN 'balance' END, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'segment' END) AS issues FROM s""")
def readiness_score(spark, sf):
    c = table(spark, sf, "customer")
    balance = F.col("c_acctbal")
    score = numbers.checklist([(balance > 0, 25), (balance > 1000, 25), (F.col("c_mktsegment") != "FURNITURE", 15), (F.col("c_nationkey") < 20, 35)])
    found = numbers.issues([(balance <= 0, "balance"), (F.col("c_mktsegment") == "FURNITURE", "segment")])
    return c.select("c_custkey", score.alias("score"), F.array_join(found, ",").alias("issues"), "c_acctbal").select("c_custkey", "score", ((F.col("score") >= 80) & (F.col("c_acctbal") > 0)).alias("ready"), "issues")


@query("""SELECT p_partkey, CAST(floor(50 * CAST(p_size > 40 AS INT) + 25 * CAST(p_retailprice > 1000 AS INT) + greatest(0, p_size - 20) / 5.0 + 0.5) AS BIGINT) AS priority FROM part ORDER BY priority DESC, p_partkey LIMIT 50""")
def priority_queue(spark, sf):
    points = numbers.checklist([(F.col("p_size") > 40, 50), (F.col("p_retailprice") > 1000, 25)])
    priority = numbers.round_half_up(points + F.greatest(F.lit(0), F.col("p_size") - 20) / 5)
    return part(spark, sf).select("p_partkey", priority.alias("priority")).orderBy(F.desc("priority"), "p_partkey").limit(50)


@query("""
WITH i AS (SELECT p_partkey, 'HIGH' AS severity, 'SMALL' AS code FROM part WHERE p_size < 3 UNION ALL SELECT p_partkey, 'LOW', 'CHEAP' FROM part WHERE p_retailprice < 910 UNION ALL SELECT p_partkey, 'LOW', 'SMALL_RED' FROM part WHERE p_size < 10 AND contains(p_name, 'red'))
SELECT severity, code, count(*) AS n, count(DISTINCT p_partkey) AS entities FROM i GROUP BY ALL""")
def quality_issues(spark, sf):
    size = F.col("p_size")
    rules = [("HIGH", "SMALL", size < 3, size), ("LOW", "CHEAP", F.col("p_retailprice") < 910, F.col("p_retailprice")), ("LOW", "SMALL_RED", (size < 10) & F.contains("p_name", F.lit("red")), F.col("p_name"))]
    return classify.issue_histogram(classify.issues(part(spark, sf), "p_partkey", rules), "p_partkey")


#: Strength times weight of 'blue bolt' in name, type and brand, as SQL.
STRENGTHS = """
WITH f AS (SELECT p_partkey, p_name, p_size, unnest([lower(p_name), lower(p_type), regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ')]) AS f, unnest([300, 250, 100]) AS weight FROM part),
s AS (SELECT *, weight * CASE WHEN f = 'blue bolt' THEN 1 WHEN starts_with(f, 'blue bolt') THEN 0.88 WHEN contains(f, 'blue bolt') THEN 0.7
 ELSE greatest(len(list_intersect(['blue', 'bolt'], string_split(f, ' '))) / 2 * 0.76, coalesce(list_max([CASE WHEN levenshtein(x, 'blue bolt') <= 2 THEN 0.46 + (2 - levenshtein(x, 'blue bolt')) * 0.08 ELSE 0 END for x in string_split(f, ' ')]), 0)) END AS x FROM f),
raw AS (SELECT p_partkey, p_name, p_size, max(x) AS raw FROM s GROUP BY ALL)
"""
FIELDS = {"p_name": 300, "p_type": 250, "p_brand": 100}


@query(STRENGTHS + "SELECT p_partkey, CAST(floor(raw + CASE WHEN p_size > 40 THEN 55 ELSE 0 END + 0.5) AS BIGINT) AS score FROM raw WHERE raw >= 110")
def search_weighted(spark, sf):
    found = search.weighted_search(part(spark, sf), "blue bolt", FIELDS, least=110, boosts=[(F.col("p_size") > 40, 55.0)])
    return found.select("p_partkey", "score")


@query(STRENGTHS + """, b AS (SELECT *, raw + CASE WHEN p_size > 40 THEN 55 ELSE 0 END AS boosted FROM raw)
SELECT p_partkey, CAST(floor(boosted + 0.5) AS BIGINT) AS score FROM b WHERE boosted >= 240 ORDER BY score DESC, p_name, p_partkey LIMIT 7""")
def search_suggestions(spark, sf):
    return search.suggestions(part(spark, sf), " blue bolt", FIELDS, "p_name", "p_partkey", boosts=[(F.col("p_size") > 40, 55.0)]).select("p_partkey", "score")


@query("""
WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, 95.0 AS weight FROM part UNION ALL SELECT p_partkey, lower(p_type), 90.0 FROM part),
t(term) AS (VALUES ('bleu'), ('econmoy')), s AS (SELECT p_partkey, term, max(CASE WHEN word = term THEN weight WHEN starts_with(word, term) THEN 0.6 * weight
 WHEN length(word) >= 4 AND damerau_levenshtein(word, term) <= 1 THEN 0.35 * weight ELSE 0 END) AS x FROM w, t GROUP BY ALL)
SELECT p_partkey, CAST(sum(x) AS DOUBLE) AS score, true AS approximate FROM s GROUP BY 1 HAVING min(x) > 0""")
def search_tiered_fallback(spark, sf):
    found = search.conjunctive_search(part(spark, sf), "bleu econmoy", "p_brand", "p_name", ["p_type"], "p_name", "p_partkey")
    return found.select("p_partkey", "score", "approximate")


@query("""
SELECT p_partkey, CAST(95.0 + 0.6 * 90 AS DOUBLE) AS score, false AS approximate FROM part WHERE starts_with(p_name, 'blue ') AND p_type = 'ECONOMY'""")
def search_conjunctive(spark, sf):
    return search.conjunctive_search(part(spark, sf), "BLUE eco", "p_brand", "p_name", ["p_type"], "p_brand", "p_partkey").select("p_partkey", "score", "approximate")


#: Scores of instant search for a query of two words, as SQL: first letter, then words, as parameters.
INSTANT = """
WITH f AS (SELECT *, regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ') AS brand FROM part),
e AS (SELECT *, CASE WHEN p_name = '{q}' THEN 2070 WHEN starts_with(p_name, '{q}') THEN 1980 WHEN contains(p_name, '{q}') THEN 1820 ELSE 0 END AS exact FROM f),
w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, 1180 AS base FROM e UNION ALL SELECT p_partkey, unnest(string_split(brand, ' ')), 1120 FROM e),
n AS (SELECT p_partkey, max(base + 110 - 45 * levenshtein(word, q) + least(length(word), length(q))) AS near FROM w, (SELECT unnest(string_split('{q}', ' ')) AS q) WHERE length(word) >= 3 AND length(q) >= 3
 AND abs(length(word) - length(q)) <= 2 AND levenshtein(word, q) <= CASE WHEN greatest(length(word), length(q)) >= 8 THEN 2 ELSE 1 END GROUP BY 1)
SELECT p_partkey, CAST(CASE WHEN exact > 0 THEN exact ELSE near END AS INT) AS score FROM e LEFT JOIN n USING (p_partkey)
WHERE exact > 0 OR (near > 0 AND '{q}'[1] IN (p_name[1], brand[1]) AND (SELECT count(*) FROM e WHERE exact > 0) < 8) ORDER BY score DESC, p_brand, p_name, p_partkey LIMIT 8
"""


@query(INSTANT.replace("{q}", "red ring"))
def instant_topk(spark, sf):
    return search.instant_search(part(spark, sf), "Red Ring", "p_name", "p_brand", "p_type", "p_partkey").select("p_partkey", F.col("score").cast("int").alias("score"))


@query(INSTANT.replace("{q}", "redd rinng"))
def instant_typos(spark, sf):
    return search.instant_search(part(spark, sf), "Redd Rinng", "p_name", "p_brand", "p_type", "p_partkey").select("p_partkey", F.col("score").cast("int").alias("score"))


@query("""
WITH me AS (SELECT * FROM part WHERE p_partkey = 7), s AS (SELECT p.p_partkey, p.p_brand, 12 * CAST(p.p_brand = me.p_brand AS INT) + 8 * CAST(p.p_type = me.p_type AS INT) + CAST(p.p_name = me.p_name AS INT) AS score FROM part p, me WHERE p.p_partkey <> 7),
o AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS k FROM s WHERE score > 0)
SELECT p_partkey, CAST(score AS DOUBLE) AS score FROM o WHERE k = 1 ORDER BY score DESC, p_partkey LIMIT 6""")
def related_items(spark, sf):
    p = part(spark, sf)
    me = p.filter("p_partkey = 7").first().asDict()
    links = {"type": (p.select("p_partkey", F.col("p_type").alias("key")), 8), "name": (p.select("p_partkey", F.col("p_name").alias("key")), 1)}
    return search.related(p, me, links, "p_partkey", "p_brand", 12, 6).select("p_partkey", "score")


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 50 ELSE 15 END + CASE o_orderpriority WHEN '1-URGENT' THEN 40 WHEN '2-HIGH' THEN 10 ELSE -40 END AS score, o_orderstatus, o_totalprice FROM orders)
SELECT o_custkey, o_orderkey, score FROM r WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_totalprice, o_orderkey) = 1""")
def canonical_winner(spark, sf):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    score = F.when(status == "F", 50).otherwise(15) + F.when(priority == "1-URGENT", 40).when(priority == "2-HIGH", 10).otherwise(-40)
    done = table(spark, sf, "orders").withColumn("score", score).filter(status == "F")
    return first_per_key(done, ["o_custkey"], [F.desc("score"), F.col("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "score")


@query("""SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'toxic' END, d.lang) AS lang, coalesce(l.toxic = 1, false) AS overridden FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def override_join(spark, sf):
    manual = table(spark, sf, "labels").select("doc_id", (F.col("toxic") == 1).alias("active"), F.lit("toxic").alias("lang"))
    return linkage.override(table(spark, sf, "documents").select("doc_id", "lang"), manual, "doc_id", "lang")


@query("""
WITH c AS (SELECT s_suppkey AS id, s_name AS name, s_acctbal FROM supplier), p AS (SELECT c_custkey AS id, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT c.id, CASE WHEN p.id IS NULL THEN 'CREATE' WHEN abs(p.c_acctbal - c.s_acctbal) > 5000 THEN 'FLAG' ELSE 'UPDATE' END AS action FROM c LEFT JOIN p ON c.id = p.id""")
def promote_actions(spark, sf):
    new = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal")
    old = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), "c_acctbal", F.lit(True).alias("there"))
    action = F.when(F.col("there").isNull(), "CREATE").when(F.abs(F.col("c_acctbal") - F.col("s_acctbal")) > 5000, "FLAG").otherwise("UPDATE")
    return new.join(old, "id", "left").select("id", action.alias("action"))


@query("""
WITH e AS (SELECT user_id, ts, event_type, lag(event_type) OVER w AS before, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT user_id, CASE WHEN event_type = 'error' THEN 'UNAVAILABLE' WHEN before IS NULL THEN 'BASELINE' WHEN before = event_type THEN 'UNCHANGED' ELSE 'CHANGED' END AS outcome,
 CAST(CAST(ts AS DATE) + CASE WHEN event_type = 'error' OR before <> event_type THEN 7 ELSE 30 END AS DATE) AS next_review FROM e WHERE k = 1""")
def reverify_outcome(spark, sf):
    seen = hash_changes(table(spark, sf, "events"), "user_id", "ts", "event_type")
    last = first_per_key(seen, ["user_id"], [F.desc("ts")])
    outcome = F.when(F.col("event_type") == "error", "UNAVAILABLE").when(F.col("state") == "NEW", "BASELINE").when(F.col("state") == "SAME", "UNCHANGED").otherwise("CHANGED")
    wait = F.when(F.col("outcome").isin("UNAVAILABLE", "CHANGED"), 7).otherwise(30)
    return last.withColumn("outcome", outcome).select("user_id", "outcome", F.date_add(F.to_date("ts"), wait).alias("next_review"))


@query("""
WITH s AS (SELECT user_id, count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'purchase') AS p, max(ts) AS last FROM events GROUP BY 1)
SELECT user_id, CASE WHEN p >= 10 THEN 'ACTIVE' WHEN p > 0 THEN 'BOUGHT' WHEN c > 0 THEN 'CLICKED' WHEN v > 0 THEN 'VIEWED' WHEN s > 0 THEN 'SIGNED' ELSE 'NEW' END AS stage,
 CAST(floor((epoch_ms(TIMESTAMP '2024-02-01') - epoch_ms(last)) / 86400000) AS BIGINT) AS age FROM s""")
def activation_stage(spark, sf):
    kind = F.col("event_type")
    counts = table(spark, sf, "events").groupBy("user_id").agg(*[F.count_if(kind == k).alias(k) for k in ("signup", "view", "click", "purchase")], F.max(F.col("ts").cast("timestamp")).alias("last"))
    stage = F.when(F.col("purchase") >= 10, "ACTIVE").when(F.col("purchase") > 0, "BOUGHT").when(F.col("click") > 0, "CLICKED").when(F.col("view") > 0, "VIEWED").when(F.col("signup") > 0, "SIGNED").otherwise("NEW")
    return counts.select("user_id", stage.alias("stage"), numbers.whole_days(F.col("last"), F.to_timestamp(F.lit("2024-02-01"))).cast("bigint").alias("age"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN -1 ELSE s_nationkey END AS s_nationkey, s_name FROM supplier")
def plan_and_apply(spark, sf):
    """A plan that moves every seventh supplier, applied to the rows that it was made from."""
    target = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    actions = target.filter("s_suppkey % 7 = 0").select("s_suppkey", F.lit(-1).alias("s_nationkey"))
    return Plan(actions, target, ["s_suppkey"]).apply(target)


@query("SELECT coalesce(a.c_custkey, b.k) AS c_custkey, coalesce(b.bal, a.c_acctbal) AS c_acctbal FROM (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') a FULL JOIN (SELECT o_custkey AS k, max(o_totalprice) AS bal FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON a.c_custkey = b.k")
def upsert_rows(spark, sf):
    old = table(spark, sf, "customer").filter("c_mktsegment != 'BUILDING'").select("c_custkey", "c_acctbal")
    new = table(spark, sf, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return upsert(old, new, ["c_custkey"])


#: The walk through each block, a row of every block at a time, as SQL.
FOLD = """
WITH RECURSIVE r AS (SELECT p_brand, p_type, p_partkey, list_distinct([string_split(p_name, ' ')[1], p_type, 's' || CAST(p_size % 4 AS VARCHAR)]) AS w, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY {order}, p_partkey) AS k FROM ({rows})),
f AS (SELECT p_brand, p_type, k, p_partkey, p_partkey AS anchor, [struct_pack(id := p_partkey, w := w)] AS anchors FROM r WHERE k = 1
 UNION ALL
 SELECT p_brand, p_type, k, p_partkey, coalesce(found, p_partkey), CASE WHEN found IS NULL THEN list_append(anchors, struct_pack(id := p_partkey, w := w)) ELSE anchors END FROM (
  SELECT r.*, f.anchors, list_filter(f.anchors, lambda a: len(list_intersect(a.w, r.w)) / least(len(a.w), len(r.w)) >= {share})[1].id AS found FROM f JOIN r ON r.p_brand = f.p_brand AND r.p_type = f.p_type AND r.k = f.k + 1))
"""


@query(FOLD.format(order="p_size", rows="FROM part", share=0.6) + "SELECT p_brand, p_type, p_partkey, anchor FROM f")
def greedy_address_groups(spark, sf):
    words = F.concat_ws(" ", F.split("p_name", " ")[0], "p_type", F.concat(F.lit("s"), (F.col("p_size") % 4).cast("string")))
    rows = part(spark, sf).select("p_brand", "p_type", "p_partkey", words.alias("words"), F.col("p_size").alias("place"))
    return anchors.greedy_groups(rows, ["p_brand", "p_type"], "p_partkey", "words", "place", 0.6)


@query(FOLD.format(order="rank", rows="SELECT *, -(p_size % 5) AS rank FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_type, p_name, p_size % 4 ORDER BY rank, p_partkey) = 1", share=0.6)
 + "SELECT p_brand, p_type, p_partkey FROM f WHERE anchor = p_partkey")
def two_pass_places(spark, sf):
    """One row of each exact point, by source; then one of those in a block that are much alike."""
    words = F.concat_ws(" ", F.split("p_name", " ")[0], "p_type", F.concat(F.lit("s"), (F.col("p_size") % 4).cast("string")))
    rows = part(spark, sf).withColumn("words", words).withColumn("point", F.concat_ws("|", "p_brand", "p_type", "p_name", F.col("p_size") % 4))
    return anchors.two_pass_places(rows, ["point"], ["p_brand", "p_type"], "p_partkey", "words", F.col("p_size") % 5, 0.6).select("p_brand", "p_type", "p_partkey")


@query("""SELECT c_nationkey, CASE WHEN n_cust >= 60 AND n_big > 0 THEN 'COVERED' WHEN n_cust > 0 THEN 'PARTIAL' ELSE 'MISSING' END AS coverage FROM (SELECT n_nationkey AS c_nationkey, count(c_custkey) AS n_cust, count(*) FILTER (c_acctbal > 9000) AS n_big FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)""")
def coverage_buckets(spark, sf):
    counts = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 9000).alias("big"))
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey")).join(counts, "c_nationkey", "left").fillna(0)
    return rows.select("c_nationkey", F.when((F.col("n") >= 60) & (F.col("big") > 0), "COVERED").when(F.col("n") > 0, "PARTIAL").otherwise("MISSING").alias("coverage"))


@query("""SELECT p_name, max(p_size) AS p_size, count(*) AS occurrences, arg_max(p_brand, (p_size, -p_partkey)) AS p_brand FROM part GROUP BY 1""")
def best_fold(spark, sf):
    return linkage.best_fold(part(spark, sf), "p_name", "p_size", "p_partkey", ["p_brand"]).select("p_name", "p_size", "occurrences", "p_brand")


@query("""
WITH r(pattern, kind) AS (VALUES ('rights', 'license'), ('the', 'english'), ('que', 'romance')), m AS (SELECT doc_id, kind FROM documents, r WHERE contains(lower(text), pattern))
SELECT doc_id, kind FROM m WHERE (doc_id, kind) NOT IN (SELECT doc_id, 'english' FROM labels WHERE toxic = 1)""")
def rule_mapping_minus_existing(spark, sf):
    rules = [("rights", "license"), ("the", "english"), ("que", "romance")]
    low = F.lower("text")
    kinds = F.filter(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(k)) for p, k in rules]), lambda x: x.isNotNull())
    existing = table(spark, sf, "labels").filter("toxic = 1").select("doc_id", F.lit("english").alias("kind"))
    return table(spark, sf, "documents").select("doc_id", F.explode(kinds).alias("kind")).join(existing, ["doc_id", "kind"], "left_anti")


@query("""
WITH n AS (SELECT DISTINCT p_name || ' of ' || lower(p_type) AS b FROM part), m AS (SELECT DISTINCT p_name || ' of ' || lower(p_type) || CASE WHEN p_size % 3 = 0 THEN 's' ELSE '' END AS a FROM part)
SELECT a, b, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS similarity FROM m, n WHERE 1 - levenshtein(a, b) / greatest(length(a), length(b)) >= 0.85""")
def similar_names(spark, sf):
    """Similar names among all distinct names of parts, and the same with some endings."""
    name = F.concat("p_name", F.lit(" of "), F.lower("p_type"))
    left = part(spark, sf).select(F.concat(name, F.when(F.col("p_size") % 3 == 0, "s").otherwise("")).alias("x")).distinct().withColumn("a", F.col("x"))
    right = part(spark, sf).select(name.alias("x")).distinct().withColumn("b", F.col("x"))
    return linkage.similar_names(left, right, "a", "b", "x", 85).withColumn("similarity", F.round("similarity", 6))


@query("""
WITH s AS (SELECT s_suppkey AS a, 'd' || CAST(s_suppkey % 50 AS VARCHAR) AS domain, 'r' || CAST(s_suppkey % 20 AS VARCHAR) AS root, 'firm number ' || CAST(s_suppkey AS VARCHAR) AS name FROM supplier),
c AS (SELECT c_custkey AS b, 'd' || CAST(c_custkey % 70 AS VARCHAR) AS domain, 'r' || CAST(c_custkey % 90 AS VARCHAR) AS root, 'firm number ' || CAST(c_custkey AS VARCHAR) AS name FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT a, b, CASE WHEN s.domain = c.domain THEN 100 WHEN s.root = c.root THEN 98 WHEN s.name = c.name THEN 97 ELSE 92 END AS confidence FROM s, c
WHERE s.domain = c.domain OR s.root = c.root OR s.name = c.name OR 1 - levenshtein(s.name, c.name) / greatest(length(s.name), length(c.name)) >= 0.92""")
def duplicate_audit(spark, sf):
    def rows(df, key, out, domains, roots):
        kind = lambda letter, n: F.concat(F.lit(letter), (F.col(key) % n).cast("string"))
        return df.select(F.col(key).alias(out), kind("d", domains).alias("domain"), kind("r", roots).alias("root"), F.concat(F.lit("firm number "), F.col(key).cast("string")).alias("name"))

    new = rows(table(spark, sf, "supplier"), "s_suppkey", "a", 50, 20)
    known = rows(table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'"), "c_custkey", "b", 70, 90)
    return linkage.duplicate_audit(new, known, "a", "b", "domain", "root", "name")


@query(r"""
WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') AS host FROM pages), d AS (SELECT DISTINCT array_to_string(string_split(host, '.')[-3:], '.') AS site FROM h UNION SELECT 'a.b.' || host FROM h)
SELECT page_id, site FROM h, d WHERE host = site OR ends_with(host, '.' || site) OR ends_with(site, '.' || host)""")
def site_pairs(spark, sf):
    hosts = table(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    sites = hosts.select(F.array_join(F.slice(F.split("host", r"\."), -3, 3), ".").alias("site")).unionByName(hosts.select(F.concat(F.lit("a.b."), "host").alias("site"))).distinct()
    return linkage.site_pairs(hosts, sites, "host", "site").select("page_id", "site")


@query("""
WITH i AS (SELECT c_custkey, 'd' || CAST(c_custkey % 400 AS VARCHAR) AS domain, 'n' || CAST(c_custkey % 150 AS VARCHAR) AS name, c_acctbal, c_nationkey FROM customer WHERE c_custkey % 5 > 0
 UNION ALL SELECT c_custkey, '', 'n' || CAST(c_custkey % 150 AS VARCHAR), c_acctbal, c_nationkey FROM customer WHERE c_custkey % 5 = 0),
k AS (SELECT s_suppkey, 'd' || CAST(s_suppkey * 7 AS VARCHAR) AS domain, 'n' || CAST(s_suppkey AS VARCHAR) AS name FROM supplier),
r AS (SELECT i.*, (SELECT min(s_suppkey) FROM k WHERE k.domain = i.domain) AS by_domain, (SELECT min(s_suppkey) FROM k WHERE k.name = i.name) AS by_name,
 first_value(c_custkey) OVER (PARTITION BY domain ORDER BY CASE WHEN c_acctbal > 0 THEN 50 ELSE 0 END DESC, c_nationkey, c_custkey) AS keeper FROM i),
a AS (SELECT *, CASE WHEN domain <> '' AND by_domain IS NOT NULL THEN 'MARK_DUPLICATE_PRODUCTION' WHEN domain <> '' AND c_custkey <> keeper THEN 'MARK_DUPLICATE_DISCOVERY' WHEN by_name IS NOT NULL THEN 'REVIEW_NAME_MATCH' END AS action FROM r)
SELECT action, c_custkey, CASE WHEN action = 'MARK_DUPLICATE_DISCOVERY' THEN keeper END AS keep_id, CASE action WHEN 'MARK_DUPLICATE_PRODUCTION' THEN by_domain WHEN 'REVIEW_NAME_MATCH' THEN by_name END AS match_id FROM a WHERE action IS NOT NULL""")
def dedupe_plan(spark, sf):
    c = F.col("c_custkey")
    domain = F.when(c % 5 > 0, F.concat(F.lit("d"), (c % 400).cast("string"))).otherwise("")
    items = table(spark, sf, "customer").select("c_custkey", domain.alias("domain"), F.concat(F.lit("n"), (c % 150).cast("string")).alias("name"), "c_acctbal", "c_nationkey")
    k = F.col("s_suppkey")
    known = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("d"), (k * 7).cast("string")).alias("domain"), F.concat(F.lit("n"), k.cast("string")).alias("name"))
    return linkage.dedupe_plan(items, known, "c_custkey", "s_suppkey", "domain", "name", F.when(F.col("c_acctbal") > 0, 50).otherwise(0), "c_nationkey")


@query("""
SELECT c_custkey, CASE WHEN n.n_nationkey IS NOT NULL THEN 'NATION' WHEN r.r_regionkey IS NOT NULL THEN 'REGION' ELSE 'NEW' END AS bucket, coalesce(n.n_nationkey, r.r_regionkey) AS match_id,
 CASE WHEN n.n_nationkey IS NOT NULL OR r.r_regionkey IS NOT NULL THEN 'name' END AS match_key FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'NATION_' || CAST(c_custkey % 40 AS VARCHAR) WHEN 1 THEN 'ASIA' ELSE 'x' END AS name FROM customer)
 LEFT JOIN nation n ON n_name = name LEFT JOIN region r ON r_name = name""")
def cascading_match(spark, sf):
    c = F.col("c_custkey")
    name = F.when(c % 3 == 0, F.concat(F.lit("NATION_"), (c % 40).cast("string"))).when(c % 3 == 1, "ASIA").otherwise("x")
    left = table(spark, sf, "customer").select("c_custkey", name.alias("name"))
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("own"))
    regions = table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("own"))
    return linkage.cascading_match(left, [("NATION", nations), ("REGION", regions)], [("name", "own")], "id").drop("name")


#: Queries over parts: a name with a type's first letters, names with two letters swapped, brands without their sign.
ASKED = """SELECT DISTINCT p_name || ' ' || lower(p_type[1:3]) AS query FROM part UNION SELECT DISTINCT p_name[2] || p_name[1] || p_name[3:] || ' ' || lower(p_type) FROM part
 UNION SELECT DISTINCT replace(lower(p_brand), '#', '') FROM part"""


@query(f"""
WITH q AS ({ASKED}), t AS (SELECT DISTINCT query, unnest(string_split(query, ' ')) AS term FROM q), n AS (SELECT query, count(*) AS n FROM t GROUP BY 1),
w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, 95.0 AS weight FROM part UNION ALL SELECT p_partkey, lower(p_type), 90.0 FROM part UNION ALL SELECT p_partkey, unnest(string_split(lower(p_brand), '#')), 120.0 FROM part),
m AS (SELECT term, word, CASE WHEN word = term THEN 1.0 WHEN length(term) >= 3 AND starts_with(word, term) THEN 0.6 ELSE 0 END AS plain,
 CASE WHEN least(length(term), length(word)) >= 4 AND damerau_levenshtein(word, term) <= CASE WHEN length(term) >= 8 THEN 2 ELSE 1 END THEN 0.35 ELSE 0 END AS near FROM (SELECT DISTINCT term FROM t), (SELECT DISTINCT word FROM w)),
s AS (SELECT query, p_partkey, term, max(weight * plain) AS plain, max(weight * greatest(plain, near)) AS best FROM t JOIN m USING (term) JOIN w USING (word) WHERE plain + near > 0 GROUP BY ALL),
o AS (SELECT query, p_partkey, 1000.0 AS owns FROM q JOIN part ON replace(lower(p_brand), '#', '') = replace(query, ' ', '')),
r AS (SELECT query, p_partkey, sum(plain) AS plain, count(*) FILTER (plain > 0) AS k, sum(best) AS best, count(*) AS met FROM s GROUP BY ALL),
f AS (SELECT query, p_partkey, coalesce(owns, 0) + coalesce(plain, 0) AS plain, coalesce(owns, 0) + coalesce(best, 0) AS best, coalesce(k = n, false) OR owns IS NOT NULL AS exact, coalesce(met = n, false) OR owns IS NOT NULL AS near
 FROM r FULL JOIN o USING (query, p_partkey) JOIN n USING (query))
SELECT query, p_partkey, CAST(CASE WHEN exact THEN plain ELSE best END AS DOUBLE) AS score, NOT exact AS approximate FROM f WHERE exact OR (near AND query NOT IN (SELECT query FROM f WHERE exact))""")
def search_many(spark, sf):
    """Conjunctive search for a frame of queries, by a written index."""
    rows = part(spark, sf)
    named = rows.select(F.concat_ws(" ", "p_name", F.lower(F.substring("p_type", 1, 3))).alias("query"))
    name = F.col("p_name")
    swapped = rows.select(F.concat(F.substring(name, 2, 1), F.substring(name, 1, 1), F.substr(name, F.lit(3)), F.lit(" "), F.lower("p_type")).alias("query"))
    brands = rows.select(F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")).alias("query"))
    return part_index(spark, sf).conjunctive(named.union(swapped).union(brands), "query")


def part_index(spark, sf):
    path = f"{scratch.shared_dir(spark)}/millrace/part-index-{uuid.uuid4().hex}"
    scratch.remember(path)
    SearchIndex.build(part(spark, sf), path, "p_brand", "p_name", ["p_type"], "p_name", "p_partkey", context="p_type", shards=8)
    return SearchIndex.open(spark, path)


def _points(text: str, base: int) -> str:
    return f"CASE WHEN {text} = q THEN {base + 420} WHEN starts_with({text}, q) THEN {base + 330} WHEN contains(' ' || {text}, ' ' || q) THEN {base + 250} WHEN contains({text}, q) THEN {base + 170} ELSE 0 END"


@query(f"""
WITH a AS (SELECT DISTINCT p_name[1:5] AS query FROM part UNION SELECT DISTINCT p_name[1:3] || p_name[3:] FROM part UNION SELECT DISTINCT p_type[1:2] FROM part), q AS (SELECT query, trim(lower(query)) AS q FROM a),
f AS (SELECT *, regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ') AS brand FROM part),
x AS (SELECT query, q, p_partkey, p_name, p_brand, brand, greatest({_points('p_name', 1650)}, {_points('brand', 1580)}, CASE WHEN length(q) > 1 THEN {_points('lower(p_type)', 760)} ELSE 0 END) AS exact FROM q, f),
full_ones AS (SELECT query FROM x WHERE exact > 0 GROUP BY 1 HAVING count(*) >= 8),
v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM f UNION SELECT DISTINCT unnest(string_split(brand, ' ')) FROM f), u AS (SELECT query, unnest(string_split(q, ' ')) AS own FROM q),
p AS (SELECT query, word, max(110 - 45 * levenshtein(word, own) + least(length(word), length(own))) AS points FROM u, v WHERE length(word) >= 3 AND length(own) >= 3 AND abs(length(word) - length(own)) <= 2
 AND levenshtein(word, own) <= CASE WHEN greatest(length(word), length(own)) >= 8 THEN 2 ELSE 1 END GROUP BY ALL),
w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, 1180 AS base FROM f UNION ALL SELECT p_partkey, unnest(string_split(brand, ' ')), 1120 FROM f),
n AS (SELECT query, p_partkey, max(base + points) AS near FROM w JOIN p USING (word) GROUP BY ALL),
s AS (SELECT query, p_partkey, p_name, p_brand, exact AS score FROM x WHERE exact > 0 UNION ALL SELECT query, p_partkey, p_name, p_brand, near FROM x JOIN n USING (query, p_partkey)
 WHERE exact = 0 AND length(q) >= 3 AND q[1] IN (p_name[1], brand[1]) AND query NOT IN (FROM full_ones))
SELECT query, p_partkey, CAST(score AS INT) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, p_brand, p_name, p_partkey) AS rank FROM s QUALIFY rank <= 8""")
def instant_many(spark, sf):
    """Search as one types for a frame of queries (beginnings, doubled letters, two letters of a type), by a written index."""
    rows, name = part(spark, sf), F.col("p_name")
    doubled = rows.select(F.concat(F.substring(name, 1, 3), F.substr(name, F.lit(3))).alias("query"))
    asked = rows.select(F.substring(name, 1, 5).alias("query")).union(doubled).union(rows.select(F.substring("p_type", 1, 2).alias("query")))
    return part_index(spark, sf).instant(asked, "query").select("query", "p_partkey", F.col("score").cast("int").alias("score"), "rank")


@query("""
WITH s AS (SELECT a.p_partkey, b.p_partkey AS other, b.p_brand, CASE WHEN a.p_brand = b.p_brand THEN 12 ELSE 0 END + CASE WHEN a.p_type = b.p_type THEN 4 ELSE 0 END + CASE WHEN a.p_size = b.p_size THEN 6 ELSE 0 END AS score
 FROM part a JOIN part b ON a.p_partkey <> b.p_partkey AND (a.p_brand = b.p_brand OR a.p_type = b.p_type OR a.p_size = b.p_size)),
o AS (FROM s QUALIFY row_number() OVER (PARTITION BY p_partkey, p_brand ORDER BY score DESC, other) = 1)
SELECT p_partkey, other, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, other) AS rank FROM o QUALIFY rank <= 6""")
def related_all(spark, sf):
    """The six best others for every part: brand, type and size in common, types too common to be paired."""
    rows = part(spark, sf)
    links = [(rows.select("p_partkey", F.col("p_type").alias("key")), 4), (rows.select("p_partkey", F.col("p_size").alias("key")), 6)]
    return recommend.related_items(rows, "p_partkey", "p_brand", links, 12, 6, hot=150)
