from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions import numbers, places, text, urls
from millrace.operators import anchors, find, linkage, measure, rank, search
from millrace.operators.where import Ref, Relation, where
from millrace.plans import changes
from millrace.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_filters_in_three_valued_logic(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, None, 7), (3, "B%", None), (4, "b_", 1)], "id int, s string, n int")
    ids = lambda spec, rel=None: sorted(r.id for r in where(df, spec, rel).collect())
    assert ids({"s": None}) == [2] and ids({"s": {"not": None}}) == [1, 3, 4]
    assert ids({"s": {"not": "a"}}) == [3, 4] and ids({"NOT": {"s": "a"}}) == [3, 4]
    assert ids({"n": {"in": []}}) == [] and ids({"n": {"notIn": []}}) == [1, 2, 3, 4] and ids({"OR": []}) == [] and ids({"AND": []}) == [1, 2, 3, 4]
    assert ids({"s": {"contains": "%"}}) == [3] and ids({"s": {"contains": "_"}}) == [4] and ids({"s": {"startsWith": "B", "mode": "insensitive"}}) == [3, 4]
    assert ids({"n": {"lt": Ref("id")}}) == [4] and ids({"AND": [{"OR": [{"id": 1}, {"id": 4}]}, {"n": {"gte": 5}}]}) == [1]
    kids = spark.createDataFrame([(1, 5), (1, 1), (2, 9), (4, None)], "pid int, v int")
    rel = {"kids": Relation(kids, "id", "pid")}
    assert ids({"kids": {"some": {"v": {"gt": 4}}}}, rel) == [1, 2] and ids({"kids": {"none": {"v": {"gt": 4}}}}, rel) == [3, 4]
    assert ids({"kids": {"every": {"v": {"gt": 4}}}}, rel) == [2, 3] and ids({"kids": {"none": {}}}, rel) == [3]
    assert ids({"OR": [{"id": 3}, {"kids": {"some": {"v": 9}}}]}, rel) == [2, 3] and ids({"NOT": {"kids": {"some": {}}}}, rel) == [3]
    nested = {"kids": Relation(kids, "id", "pid", {"up": Relation(df, "pid", "id")})}
    assert ids({"kids": {"every": {"up": {"s": "a"}}}}, nested) == [1, 3]
    assert ids({}) == ids(None) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        ids({"n": {"near": 3}})


def test_order_paging_and_cursor(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, "b"), (4, "a"), (5, "c")], "id int, s string")
    ids = lambda **k: [r.id for r in find.find_many(df, **k).collect()]
    assert ids(order_by=[{"s": "asc"}, {"id": "asc"}]) == [2, 4, 3, 5, 1] and ids(order_by=[{"s": "desc"}, {"id": "asc"}]) == [1, 5, 3, 2, 4]
    assert ids(order_by={"s": {"sort": "asc", "nulls": "first"}}, take=1) == [1]
    assert ids(order_by={"s": "asc"}, enums={"s": ["c", "b", "a"]})[:2] == [5, 3]
    assert ids(order_by={"id": "asc"}, take=-2) == [4, 5] and ids(order_by={"id": "asc"}, cursor={"id": 3}, take=-2) == [2, 3]
    assert ids(order_by=[{"s": "asc"}, {"id": "asc"}], cursor={"s": "a", "id": 4}) == [4, 3, 5]
    assert ids(order_by={"id": "desc"}, distinct=["s"]) == [5, 4, 3, 1]
    rows, number, pages = find.page(df, [{"id": "asc"}], 9, 2)
    assert (number, pages, [r.id for r in rows.collect()]) == (3, 3, [5]) and find.page(df.limit(0), [{"id": "asc"}], 1, 2)[1:] == (1, 1)
    with pytest.raises(Exception, match="no such row"):
        find.find_unique(df, {"id": 99}, or_throw=True).collect()
    assert find.find_unique(df, {"id": 99}).count() == 0


def test_numbers(spark):
    assert [one(spark, numbers.round_half_up(F.lit(x))) for x in (-2.5, 2.5, 2.4)] == [-2, 3, 2]
    assert one(spark, numbers.percent(F.lit(1), F.lit(0))) == 0 and one(spark, numbers.percent(F.lit(1), F.lit(3))) == 33.3
    assert [one(spark, numbers.change(F.lit(a), F.lit(b))) for a, b in ((5, 0), (0, 0), (3, 2))] == [None, 0, 50]
    assert [one(spark, numbers.parse_number(F.lit(x))) for x in ("1.234", "12,5", "1,234,567", "x")] == [1234, 12.5, 1234567, None]
    assert one(spark, numbers.amounts(F.lit("€ 20, 15 euro or eur 20; 99999 eur"))) == [15, 20]
    t = F.to_timestamp
    assert one(spark, numbers.whole_days(t(F.lit("2024-01-01 12:00:00")), t(F.lit("2024-01-03 11:00:00")))) == 1
    assert one(spark, numbers.coordinates_state(F.lit(0.0), F.lit(0.0), (34, 19, 42, 30))) == "ZERO"


def test_texts_and_urls(spark):
    assert one(spark, text.search_form(F.lit("  ΚΌΣΜΟΣ & Café-Bar "))) == "κοσμοσ and cafe bar" == one(spark, text.search_form(F.lit("κοσμος & CAFE bar")))
    assert one(spark, text.catalog_form(F.lit("H&M ΐ"))) == "h m ι" and one(spark, text.slugify(F.lit("Ένα Δύο!"))) == "ενα-δυο"
    assert one(spark, text.shop_name(F.lit("The Official Shop Greece"))) == "the" and one(spark, text.firm_name(F.lit("Άλφα A.E. Ltd"))) == "αλφα a e"
    assert one(spark, text.greek_to_latin(F.lit("Μπουγάτσα"))) == "bougatsa"
    assert [one(spark, text.osa_distance(F.lit("sephroa"), F.lit(x))) for x in ("sephora", "sephroa", "")] == [1, 0, 7]
    assert one(spark, text.fingerprint(F.lit("a"), F.lit(None).cast("string"))) == one(spark, F.sha2(F.lit("a|"), 256))
    assert one(spark, text.near(F.lit("gift for your mother"), "gift", "mother", 10)) == "gift for your mother"
    assert one(spark, text.last_match(F.lit("[X:1] [X:2]"), r"\[X:(\d)\]")) == "2" and one(spark, text.first_of_pipes(F.lit(" | b | c"))) == "b"
    assert one(spark, urls.canonical(F.lit("HTTP://www.A.gr//x/?utm_source=1&b=2#f"))) == "http://a.gr/x?b=2" and one(spark, urls.host(F.lit("no url%%"))) == ""
    assert one(spark, urls.registrable(F.lit("shop.a.com.gr"))) == "a.com.gr" and one(spark, urls.has_tracking(F.lit("http://a/?gclid=1")))
    assert not one(spark, urls.is_public_http(F.lit("http://u:p@a.gr/"))) and one(spark, urls.is_public_http(F.lit("https://a.gr")))
    assert one(spark, urls.same_site(F.lit("a.b.gr"), F.lit("b.gr"))) and not one(spark, urls.same_site(F.lit("ab.gr"), F.lit("b.gr")))


def test_places(spark):
    line = F.lit("Ερμού 12Α, Αθήνα 105 63, τηλ 2101234567")
    assert one(spark, places.postal_code(line)) == "10563" and one(spark, places.street_numbers(line)) == ["12Α"]
    assert one(spark, places.locality(line, [("Πάτρα", "Patras"), ("αθηνα", "Athens")])) == "Athens"
    assert one(spark, places.region_label(F.lit(" "), F.lit("Αττική"), aliases={"αττικη": "Attica"})) == "Attica"
    assert [one(spark, places.valid_name(F.lit(x), ["home"], ["shop", "the"])) for x in ("Home", "The shop", "Acme shop", "x", None)] == [False, False, True, False, False]
    assert one(spark, F.size(places.address_chunks(F.lit("intro Οδός Α 12 Οδός χωρίς Οδός Β 7"), "Οδός"))) == 2


CARDS = [
    ("noise", "AAA Gifts", "AAA Gifts", "", "everything but Sephora", True),
    ("sephora", "Sephora", "Sephora card", "Καλλυντικά beauty Γενέθλια birthday", "", False),
    ("gaming", "Game Shop", "Gaming", "games birthday Γενέθλια", "", False),
    ("spa", "Calm", "Spa day", "", "", False),
    ("parts", "Spareparts", "Spare parts", "", "", True),
    ("hm", "H&M", "Card", "", "", False),
    ("archive", "Αρχεία - Wellness Spa", "Αρχεία - Wellness Spa card", "", "", True),
    ("old", "Archives: Spa", "x", "", "", True),
]


def test_catalogue_search(spark):
    cards = spark.createDataFrame(CARDS, "id string, owner string, title string, taxonomy string, description string, featured boolean")
    found = lambda q: [(r.id, r.approximate) for r in search.conjunctive_search(cards, q, "owner", "title", ["taxonomy"], "description", "id").orderBy(F.desc("score"), "id").collect()]
    assert found("SEPHORA")[0] == ("sephora", False) and found("καλλυντικα") == [("sephora", False)]
    assert found("gaming birthday") == [("gaming", False)] and len(found("γενεθλια")) == 2 and found("gaming nonexistent") == []
    assert found("sephroa") == [("sephora", True)] and found("qq") == [] and found("spa")[0] == ("spa", False)
    assert found("hm") == [("hm", False)] and found("h m")[0] == ("hm", False)
    assert found("!!!") == [] == found("a" * 161) == found(" ".join(f"t{i}" for i in range(13)))
    scores = lambda q: {r.id: r.score for r in search.conjunctive_search(cards, q, "owner", "title", ["taxonomy"], "description", "id").collect()}
    # every near term counts by its best field; two terms are two near scores
    assert scores("sephroa birhtday") == {"sephora": 0.35 * (120 + 90)} and scores("spa") == {"spa": 95.0, "archive": 120.0 - 50, "parts": 120 * 0.6, "old": 120.0 - 50}
    assert scores("sephora") == {"sephora": 1120.0, "noise": 8.0} and scores("Sephora card") == {"sephora": 120 + 95 + 400.0}
    instant = lambda q, **k: [(r.id, r.score) for r in search.instant_search(cards, q, "title", "owner", "taxonomy", "id", **k).collect()]
    assert instant("sephora") == [("sephora", 2000.0)] and instant("sephroa") == [] and instant("sephorra") == [("sephora", 1180 + 110 - 45 + 7.0)]
    assert instant("s")[:3] == [("spa", 1980.0), ("sephora", 1980.0), ("parts", 1980.0)]
    assert instant("gamign", limit=1) == [] and instant("xyz", forms=["spa"], bonuses=[(F.col("featured"), 20.0)])[0][1] >= 1930
    assert search.suggestions(cards, "s", {"title": 1160}, "title", "id").count() == 0 < search.suggestions(cards, "spa", {"title": 1160}, "title", "id").count()


def test_ranking(spark):
    start = datetime(2024, 1, 1)
    at = lambda *minutes: [(i, "k", start + timedelta(minutes=m)) for i, m in enumerate(minutes)]
    kept = lambda *m: sorted(r.id for r in rank.accepted(spark.createDataFrame(at(*m), "id int, k string, ts timestamp"), ["k"], "ts", "id", 1800).collect())
    assert kept(0, 20, 40) == [0, 2] and kept(10, 35, 45) == [0, 2] and kept(0, 30, 61) == [0, 2] and kept(5) == [0]
    seen = spark.createDataFrame(at(0, 1, 3, 4, 9), "id int, k string, ts timestamp")
    assert [t.minute for t in rank.spaced_selection(seen, "k", "ts", 120).first().kept] == [9, 4, 1]
    votes = spark.createDataFrame([("a", "x", 120), ("a", "y", 110), ("b", "x", 100)], "k string, c string, s int")
    assert {(r.k, r.winner, r.decided) for r in rank.winner_margin(votes, "k", "c", "s", 100, 18).collect()} == {("a", "x", False), ("b", "x", True)}
    slugs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, slug string")
    taken = spark.createDataFrame([("b",)], "slug string")
    assert [r.unique_slug for r in rank.numbered_slugs(slugs, "slug", [F.col("id")], taken).orderBy("id").collect()] == ["a", "a-2", "b-2"]
    number = lambda given, gone: [r.unique_slug for r in rank.numbered_slugs(spark.createDataFrame(list(enumerate(given)), "id int, slug string"), "slug", [F.col("id")], spark.createDataFrame([(g,) for g in gone], "slug string")).orderBy("id").collect()]
    assert number(["a", "a", "a-2"], []) == ["a", "a-3", "a-2"] and number(["a", "a", "a-2"], ["a", "a-2"]) == ["a-3", "a-4", "a-2-2"]
    assert number(["a"] * 5, ["a-2", "a-4", "a-5", "a-02", "a-1"]) == ["a", "a-3", "a-6", "a-7", "a-8"] and number(["-2", "-2", ""], [""]) == ["-2", "-2-2", "-3"]
    import random

    rnd = random.Random(2)
    for _ in range(5):
        given = [rnd.choice("ab") + "".join(rnd.choice(["", "-2", "-3"]) for _ in range(2)) for _ in range(30)]
        gone = {rnd.choice("ab") + rnd.choice(["", "-2", "-4", "-2-2"]) for _ in range(3)}
        got = number(given, gone)
        assert len(set(got) | gone) == len(got) + len(gone) and all(g == s or g.startswith(f"{s}-") for g, s in zip(got, given, strict=True))
        assert all(s in got or s in gone for s in given)
    rows = spark.createDataFrame([(i, f"o{i % 3}", i) for i in range(8)], "id int, owner string, place int")
    assert [r.id for r in rank.merge_ranked(rows.filter("id > 4"), rows, "id", "owner", "place", 5).collect()] == [5, 6, 7, 0, 1]


def test_linkage(spark):
    rows = spark.createDataFrame([("k", 1, None, "x"), ("k", 3, "b", None), ("k", 3, "c", "z"), ("m", 1, None, None)], "k string, p int, a string, note string")
    rows = rows.withColumn("seq", F.monotonically_increasing_id())
    got = {r.k: (r.a, r.n_merged, r.note) for r in linkage.merge_by_priority(rows, "k", F.col("p"), "seq", ["a"], "note").collect()}
    assert got == {"k": ("b", 3, "z | x"), "m": (None, 1, "")}
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(90, 99)], "a int, b int")
    assert {r.node: r.group for r in linkage.components(links).collect()} == {**{i: 0 for i in range(31)}, 90: 90, 99: 90}
    places = spark.createDataFrame([("c", 1, "a b c d", 1), ("c", 2, "a b c x", 2), ("c", 3, "x y z a", 3), ("d", 4, "a b", 1), ("c", 5, None, 9)], "city string, id int, words string, place int")
    assert {(r.id, r.anchor) for r in anchors.greedy_groups(places, ["city"], "id", "words", "place", 0.6).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)}
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted((r.x, r.side) for r in measure.reconcile(a, b).collect()) == [(1, "left"), (2, "left"), (3, "right")]


def test_changes_and_plans(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3)], "id int, s string, n int")
    new = spark.createDataFrame([(2, None, 9), (4, "d", 4)], "id int, s string, n int")
    rows = lambda f: sorted(map(tuple, f.collect()), key=lambda r: r[0])
    assert rows(changes.upsert(df, new, ["id"])) == [(1, "a", 1), (2, "b", 9), (3, None, 3), (4, "d", 4)]
    assert rows(changes.insert(df, new, ["id"], skip_duplicates=True))[-1] == (4, "d", 4)
    with pytest.raises(Exception, match="duplicate key"):
        changes.insert(df, new, ["id"]).collect()
    assert rows(changes.delete(df, F.col("s") == "a")) == [(2, "b", 2), (3, None, 3)]
    assert rows(changes.update(df, F.col("n") > 1, {"s": F.lit("z")}))[1] == (2, "z", 2)
    events = spark.createDataFrame([(1, 5), (1, 1), (3, 2)], "id int, amount int")
    assert [r[2] for r in rows(changes.increment(df, "id", events, "amount", "n", F.col("s").isNotNull()))] == [7, 2, 3]
    kids = spark.createDataFrame([(10, 1), (11, 2), (12, 2)], "kid int, id int")
    assert rows(changes.cascade(kids, "id", df.filter("id = 2"), "id")) == [(10, 1)]
    assert rows(changes.cascade(kids, "id", df.filter("id = 2"), "id", set_null=True)) == [(10, 1), (11, None), (12, None)]
    bridge = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y")], "id int, tag string")
    mapping = spark.createDataFrame([(2, 1)], "loser int, winner int")
    assert sorted(map(tuple, changes.merge_entities(bridge, "id", mapping, ["id", "tag"]).collect())) == [(1, "x"), (1, "y")]
    plan = changes.Plan(spark.createDataFrame([(1, "q")], "id int, s string"), df, ["id"])
    after = plan.apply(df)
    assert rows(after)[0] == (1, "q", 1) and plan.audit(after).count() == 0 and plan.audit(df).count() == 1
    assert plan.plan_id == changes.Plan(spark.createDataFrame([(1, "q")], "id int, s string"), df, ["id"]).plan_id
    assert plan.report_name("r", "csv") == f"r-{plan.plan_id[:16]}.csv"
    with pytest.raises(changes.StalePlan):
        plan.apply(changes.update(df, F.col("id") == 1, {"s": F.lit("changed")}))
    plan.apply(changes.update(df, F.col("id") == 2, {"s": F.lit("elsewhere")}))


def test_names_hosts_and_json_ld(spark, tmp_path):
    import random

    rnd = random.Random(5)
    names = ["".join(rnd.choices("ab c", k=rnd.randint(1, 30))) for _ in range(40)]
    names += [n[:k] + rnd.choice("abx") + n[k + rnd.randint(0, 1) :] for n in names for k in [rnd.randrange(len(n))]]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    for percent in (92, 80, 60):
        got = {(r.a, r.b) for r in linkage.similar_names(rows.withColumnRenamed("id", "a"), rows.withColumnRenamed("id", "b"), "a", "b", "name", percent).collect()}
        want = {(i, j) for i, x in enumerate(names) for j, y in enumerate(names) if 100 * (max(len(x), len(y)) - _edits(x, y)) >= percent * max(len(x), len(y))}
        assert got == want
    hosts = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.y.ck",), ("www.ck",), ("z.www.ck",), ("y.ck",), ("q.zz",), ("",)], "host string")
    rules = spark.createDataFrame([("co.uk",), ("uk",), ("*.ck",), ("!www.ck",)], "rule string")
    found = {r.host: r.site for r in linkage.registrable_domains(hosts, "host", rules).collect()}
    assert found == {"a.b.co.uk": "b.co.uk", "co.uk": None, "x.y.ck": "x.y.ck", "www.ck": "www.ck", "z.www.ck": "www.ck", "y.ck": None, "q.zz": "q.zz", "": None}
    page = '<script type="application/ld+json">{"@graph": [{"@type": "A", "b": {"c": [{"d": 1}]}}]}</script><script type="application/ld+json">{bad</script>'
    assert one(spark, files.json_ld_objects(files.json_ld(F.lit(page))))[1:] == ['{"@type": "A", "b": {"c": [{"d": 1}]}}', '{"c": [{"d": 1}]}', '{"d": 1}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "rows.csv").write_text('id,s\n1,"a, ""b"""\n,x\n')
    (tmp_path / "in" / "rows.json").write_text('[{"id": 2, "s": "c"}]')
    (tmp_path / "in" / "skip.json").write_text('[{"id": 3, "s": "d"}]')
    read = files.read_folder(spark, str(tmp_path / "in"), "id int, s string", "id", named="^rows", with_csv=True)
    assert sorted((r.id, r.s) for r in read.collect()) == [(1, 'a, "b"'), (2, "c")]
    files.write_csv(read.select("id", "s"), str(tmp_path / "out"), mark=True)
    texts = [p.read_bytes() for p in (tmp_path / "out").glob("*.csv")]
    assert texts and all(t.startswith(b"\xef\xbb\xbfid,s") for t in texts)


def _edits(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        row, old = [i], row
        for j, b in enumerate(y, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (a != b)))
    return row[-1]


def test_sitemaps_and_plain_csv(spark, tmp_path):
    locs = lambda kind, *urls: f"<{kind}>" + "".join(f"<x><loc> {u} </loc></x>" for u in urls) + f"</{kind}>"
    files_ = spark.createDataFrame(
        [("r", locs("sitemapindex", "a", "b", "r")), ("a", locs("urlset", "p1", "p2")), ("b", locs("sitemapindex", "c", "a")), ("c", locs("urlset", "p2", "p3")), ("z", locs("urlset", "p9"))], "url string, xml string"
    )
    walk = lambda n: sorted(r.url for r in files.walk_sitemaps(files_, spark.createDataFrame([("r",)], "url string"), n).collect())
    assert walk(5) == ["p1", "p2", "p3"] and walk(2) == ["p1", "p2"] and walk(1) == []
    (tmp_path / "a.csv").write_text("domain,name\nx.gr,one\ny.gr,two\nx.gr,three\n")
    (tmp_path / "b.csv").write_text("domain,name\nx.gr,four\nz.gr,five\n")
    read = files.read_plain_csv(spark, str(tmp_path), ["domain", "name"], "domain")
    assert sorted((r.domain, r.name) for r in read.collect()) == [("x.gr", "one"), ("y.gr", "two"), ("z.gr", "five")]
    assert files.read_plain_csv(spark, str(tmp_path), ["domain", "name"]).count() == 5
