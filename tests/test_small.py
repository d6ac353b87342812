from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.functions import offers, places
from millrace.operators import audit, crawl, curation, find, rank


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_amounts_and_currencies(spark):
    got = lambda f, x: one(spark, f(F.lit(x).cast("string")))
    assert got(offers.explicit_amounts, "€ 20, 15,50 ευρώ, usd 1.250 and 3 eur, 20000 eur, 30e 40ex") == [15.5, 20, 30, 1250]
    assert got(offers.title_amounts, "Gift Card no. 25 of 2024") == [25] and got(offers.title_amounts, "Gift card A25, 50") == []
    assert got(offers.explicit_amounts, None) == [] and got(offers.title_amounts, "δωροκάρτα 100") == [100]
    assert got(offers.url_amounts, "https://x.gr/gift-card-50/e-30eur_7") == [7, 30, 50] and got(offers.url_amounts, "https://x.gr/shop/50") == []
    assert got(offers.url_amounts, "https://x.gr/%CE%B4%CF%89%CF%81%CE%BF-20/") == [20] and got(offers.url_amounts, "no url") == []
    assert [got(offers.currency, x) for x in ("£5 or 5 eur", "chf $", "$", "5 e", "europe", None)] == ["GBP", "CHF", "USD", "EUR", None, None]


def test_number_near_a_postal_code(spark):
    got = lambda x: one(spark, places.number_near_postal(F.lit(x).cast("string")))
    assert got("Ermou 12, 34B  105 63 Athens 7") == "34B" and got("Ermou 12") == "12" and got("700 10563") == "" and got(None) == ""
    assert got("Stoa 9 " + "x" * 100 + " 10563") == "" and got("0 Ermou 5Α, 105 63") == "5Α"


def test_parameters(spark):
    assert [find.parameter(x) for x in (None, "", "  ", " a ", [" b", "c"], [])] == [None, None, None, "a", "b", None]
    assert [find.page_number(x) for x in (None, "3", " 4 ", "0", "-1", "1.5", "x", "٣", ["7", "8"], "9" * 17, "9" * 30)] == [1, 3, 4, 1, 1, 1, 1, 1, 7, 1, 1]
    assert find.optional_filter({"a": 1}, {"q": " x "}, {"q": lambda v: {"b": v}, "r": lambda v: {"c": v}}) == {"AND": [{"a": 1}, {"b": "x"}]}


def test_stability(spark):
    start = datetime(2024, 1, 1)
    rows = [("few", 0, "A"), ("few", 10, "A")] + [("close", m, "A") for m in range(5)] + [("same", m, "A") for m in (0, 2, 5, 9)] + [("mixed", m, k) for m, k in ((0, "B"), (5, "A"), (9, "A"), (9, "B"), (20, "A"))]
    df = spark.createDataFrame([(k, start + timedelta(minutes=m), x) for k, m, x in rows], "k string, at timestamp, kind string")
    got = {r.k: (r.stable, r.reason, r["count"]) for r in rank.fetch_stability(df, "k", "at", "kind", 180).collect()}
    assert got == {"few": (False, "NOT_ENOUGH_OBSERVATIONS", 2), "close": (False, "SPACING_NOT_MET", 2), "same": (True, "STABLE", 3), "mixed": (True, "STABLE", 3)}


def test_robots(spark):
    text = "﻿junk\nDisallow: /before\nuser-agent: Bot\nUser-agent: *\ndisallow: /a\nAllow: /a/b$\n\nUser-agent: Mill\nDisallow:\nDisallow: /x*.php$ # c\nAllow: /x(1)+y\nDisallow: /x(1)\n"
    robots = spark.createDataFrame([("h", text), ("none", None), ("empty", ""), ("named", "User-agent: mill\n\nUser-agent: *\nDisallow: /")], "host string, text string")
    rules = lambda agent: sorted((r.host, r.allow, r.pattern) for r in crawl.robots_rules(robots, "host", "text", agent).collect())
    assert rules("other")[:2] == [("h", False, "/a"), ("h", True, "/a/b$")] and ("named", False, "/") in rules("other")
    assert [r for r in rules("MILL") if r[0] == "h"] == [("h", False, "/x(1)"), ("h", False, "/x*.php$"), ("h", True, "/x(1)+y")]
    urls = spark.createDataFrame([(1, "h", "/x/a.php"), (2, "h", "/x/a.php?q"), (3, "h", "/x(1)z"), (4, "h", "/x(1)+yz"), (5, "gone", "/"), (6, "h", "/a")], "id int, site string, path string")
    judged = crawl.may_fetch(urls, "id", "site", "path", crawl.robots_rules(robots, "host", "text", "mill"))
    assert {r.id: r.allowed for r in judged.collect()} == {1: False, 2: True, 3: False, 4: True, 5: True, 6: True}
    plan = crawl.fetch_plan(judged, "id", "site", [F.desc("path")], budget=2)
    assert {r.id: r.slot for r in plan.collect()} == {1: None, 2: 1, 3: None, 4: 2, 5: 1, 6: None}


def test_link_scores_and_shared_keys(spark):
    score = lambda x: one(spark, curation.link_score(F.lit(x).cast("string"), [(["gift", "voucher"], 18, True), (["xbox", "steam"], -60, False)], [("terms|faq", -18)]))
    assert [score(x) for x in ("GIFT voucher gift", "xbox steam", "faq terms gift", None)] == [36, -60, 0, 0]
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None), (6, ""), (7, "")], "id int, k string")
    assert {r.id: r.n for r in audit.sharing(df, F.col("k"), "n").collect()} == {1: 2, 2: 2, 3: None, 4: None, 5: None, 6: None, 7: None}
