from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.operators import aliases
from millrace.sources import offers
from millrace.streaming import replay


def test_mentions_by_both_ways(spark):
    docs = spark.createDataFrame([(1, "Η Σεφόρα & H&M, sephora SEPHORA!"), (2, None), (3, "a a a"), (4, "hm h-m"), (5, "gift card giftcard")], "id long, text string")
    names = spark.createDataFrame([("s", "Sephora"), ("s", "σεφορα"), ("h", "H&M"), ("a", "a a"), ("a", "a  A"), ("n", None), ("n", "!!"), ("g", "gift card"), ("c", "card")], "key string, alias string")
    want = [(1, "h", 1), (1, "s", 3), (3, "a", 2), (4, "h", 1), (5, "c", 1), (5, "g", 1)]
    for most in (2 << 20, 0):
        got = aliases.mentions(docs, "id", "text", names, "key", "alias", max_bytes=most).collect()
        assert sorted(map(tuple, got)) == want, most
        assert aliases.mentions(docs, "id", "text", names.limit(0), "key", "alias", max_bytes=most).collect() == []


def test_coverage_classes(spark):
    brands = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "key string")
    names = spark.createDataFrame([("a", "Alpha"), ("b", "Βήτα"), ("c", "Gamma"), ("d", "delta")], "key string, alias string")
    domains = spark.createDataFrame([("c", "gamma.GR"), ("d", "delta.gr")], "key string, domain string")
    shops = spark.createDataFrame([(1, "ALPHA", None), (2, "βητα", ""), (3, "x", "https://shop.gamma.gr/y"), (4, "y", "https://notdelta.gr")], "shop long, name string, url string")
    cards = spark.createDataFrame([(1, True, True), (1, False, True), (2, True, False), (3, False, True)], "shop long, active boolean, verified boolean")
    found = aliases.brand_coverage(brands, "key", names, "alias", domains, "domain", shops, "shop", "name", "url", cards, F.col("active"), F.col("verified"))
    assert {r.key: (r.classification, r.cards) for r in found.collect()} == {
        "a": ("ACTIVE_VERIFIED_CARD_PRESENT", 2), "b": ("ACTIVE_CARD_PRESENT", 1), "c": ("MERCHANT_ONLY", 1), "d": ("MISSING_MERCHANT", 0), "e": ("MISSING_MERCHANT", 0)}


def test_offers_in_json_ld(spark):
    blocks = [
        '{"@graph": [{"name": " Gift \\n card ", "headline": "H", "offers": {"priceCurrency": "EUR", "price": "1.250,00"}}]}',
        '{"priceCurrency": "pounds", "offers": [{"price": 20}, {"price": 4.99, "lowPrice": "€ 12,50", "priceCurrency": "£"}, {"price": true, "highPrice": null, "minPrice": -7}]}',
        "{broken",
        '{"priceCurrency": "chf", "a": {"b": [{"maxPrice": "1.250"}, {"priceCurrency": "?", "price": 10000}, {"price": 10001}]}}',
        "[" * 100_000,
        '["name", 5, null]',
        "",
    ]
    html = "".join(f"<script data-x TYPE='application/ld+json'>{b}</script>" for b in blocks)
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>no</p>")], "id long, html string")
    got = sorted((r.kind, r.source, r.name, r.amount, r.currency) for r in offers.page_offers(pages, "id", "html").select("kind", "source", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("amount", F.lit(0.0)).alias("amount"), F.coalesce("currency", F.lit("")).alias("currency")).collect())
    assert got == sorted([
        ("name", "name", "Gift card", 0, ""), ("name", "headline", "H", 0, ""), ("price", "JSONLD_PRICE", "", 20, ""), ("price", "JSONLD_LOWPRICE", "", 12.5, "GBP"),
        ("price", "JSONLD_MAXPRICE", "", 1250, "CHF"), ("price", "JSONLD_PRICE", "", 10000, "CHF"),
    ])


def test_runs_go_on_where_they_ended(spark, tmp_path):
    start = datetime(2024, 1, 1)
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "k string, ts timestamp"

    def add(minutes):
        rows = [("a", start + timedelta(minutes=m)) for m in minutes]
        replay.write_in_order(spark.createDataFrame(rows, schema), "ts", source, 2)

    def run():
        found = replay.count_views(spark, source, schema, ["k"], "ts", out, check)
        return sorted((r.ts - start).seconds // 60 for r in found.collect())

    add([0, 10, 20])
    assert run() == [0] and run() == [0]  # nothing new: nothing counted twice
    add([25, 31, 40, 62])
    assert run() == [0, 31, 62]
    # a batch whose commit was lost is run again, and leaves the same rows
    commits = sorted((tmp_path / "check" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    assert run() == [0, 31, 62]
