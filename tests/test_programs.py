import random

import pytest
from pyspark.errors import PySparkException

from millrace.operators import linkage, programs, verify


def words(text):
    return set((text or "").split())


def alike(a, b, percent):
    return bool(a and b) and 100 * len(a & b) >= percent * max(len(a), len(b))


def plain(rows, percent):
    """{id: program} by trying all pairs of each block (id, block, amounts, texts)."""
    head = {r[0]: r[0] for r in rows}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    tied = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] is not None and a[1] == b[1] and a[2] and b[2] and set(a[2]) != set(b[2]):
                if any(alike(words(x), words(y), percent) for x, y in zip(a[3:], b[3:], strict=True)):
                    tied |= {a[0], b[0]}
                    x, y = sorted((find(a[0]), find(b[0])))
                    head[y] = x
    return {i: find(i) for i in tied}


@pytest.mark.parametrize("percent", [50, 72, 100])
def test_programs_as_by_all_pairs(spark, percent):
    rng = random.Random(percent)
    text = lambda kinds: rng.choice([" ".join(f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(1, 6))), None, " "]) if rng.random() < 0.3 else " ".join(f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(1, 6)))
    rows = []
    for i in range(240):
        amounts = rng.choice([None, [], [5], [5], [5], [10, 5], [5, 10, 10], [20]])
        rows.append((i, rng.choice(["a", "a", "b", "c", None]), amounts, text(14), text(30)))
    df = spark.createDataFrame(rows, "id long, block string, amounts array<int>, x string, y string").repartition(3)
    got = {r.id: r.program for r in programs.programs(df, "id", "block", "amounts", ["x", "y"], percent).collect()}
    assert got == plain(rows, percent) and len(set(got.values())) > 1


def test_alike_sets(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), " ".join(f"w{min(rng.randrange(20), rng.randrange(20))}" for _ in range(rng.randrange(0, 9)))) for i in range(150)]
    members, links = programs.alike_sets(spark.createDataFrame(rows, "id long, block string, text string"), "id", "block", "text", 60)
    least = {}
    for i, block, text in rows:
        if words(text):
            least.setdefault((block, frozenset(words(text))), i)
    assert {r.id: r["class"] for r in members.collect()} == {i: least[block, frozenset(words(text))] for i, block, text in rows if words(text)}
    want = {(i, j) for (p, x), i in least.items() for (q, y), j in least.items() if i < j and p == q and alike(x, y, 60)}
    assert sorted((r.a, r.b) for r in links.collect()) == sorted(want)


def test_a_crowded_block_and_empty_tables(spark):
    schema = "id long, block string, amounts array<int>, text string"
    # one block of 20,000 rows: 6,000 copies of one text with two amounts, and as many texts that share a word
    df = spark.range(20_000).selectExpr("id", "'a' AS block", "array(int(id % 2)) AS amounts", "if(id < 6000, 'one two three', concat('one x', id)) AS text")
    found = programs.programs(df, "id", "block", "amounts", ["text"])
    assert found.selectExpr("count(*) AS n", "max(program) AS p").first() == (6000, 0)
    assert programs.programs(spark.createDataFrame([], schema), "id", "block", "amounts", ["text"]).count() == 0
    assert programs.programs(spark.createDataFrame([(1, "a", [1], "x")], schema), "id", "block", "amounts", ["text"]).count() == 0


SIGNS = verify.Signs(meant=r"\bgift ?cards?\b", aside=r"terms|privacy", bought=r"€|buy|αγορα", marked=r'itemprop="price"')


def page(title="", heading="", body="", head=""):
    return f"<html><head><title>{title}</title>{head}</head><body><h1>{heading}</h1><p>{body}</p></body></html>"


def test_every_gate(spark):
    own = "https://www.shop.example/gift-cards"
    good = page("Gift Card", "", "buy now")
    cases = [
        (("A", own, own, own, 200, "AbortError", good), ("ERROR", "FETCH_ERROR:AbortError")),
        (("A", own, own, own, 404, None, good), ("ERROR", "HTTP_404")),
        (("A", own, own, own, None, None, good), ("ERROR", "HTTP_UNKNOWN")),
        (("A", own, None, own, 200, None, good), ("REVIEW", "DOMAIN_PARSE_FAILED")),
        (("A", own, "https://else.example", own, 200, None, good), ("REVIEW", "OFFICIAL_URL_MERCHANT_DOMAIN_MISMATCH")),
        (("A", own, own, "https://else.example/", 200, None, good), ("REVIEW", "REDIRECT_DOMAIN_MISMATCH")),
        (("A", own, own, "https://shop.example/privacy", 200, None, page("Shop", "", "gift card buy")), ("REVIEW", "TERMS_PRIVACY_GIFTSET_OR_SUPPORT_PAGE")),
        (("A", own, own, "https://shop.example/privacy", 200, None, good), ("AUTO_SAFE", None)),
        (("A", own, own, "https://shop.example/x", 200, None, page("Shop", "", "a gift card, buy")), ("REVIEW", "NO_STRONG_GIFT_CARD_EVIDENCE")),
        (("A", own, own, "https://shop.example/gift%20card", 200, None, page("Shop", "", "a gift card, buy")), ("AUTO_SAFE", None)),
        (("Gift Card", own, own, "https://shop.example/?p=gift%20card", 200, None, page("Shop", "", "buy")), ("AUTO_SAFE", None)),
        (("A", own, own, own, 200, None, page("Gíft CARDS", "", "nothing")), ("REVIEW", "NO_STRONG_PURCHASE_OR_VALUE_EVIDENCE")),
        (("A 12,50 EUR", own, own, own, 200, None, page("Gift cards", "", "for 12,50 each")), ("AUTO_SAFE", None)),
        (("A €20.00", own, own, own, 200, None, page("Gift cards", "", "worth 20")), ("AUTO_SAFE", None)),
        (("A €20", own, own, own, 200, None, page("", "Gift card", "<script>20 €</script>none")), ("REVIEW", "NO_STRONG_PURCHASE_OR_VALUE_EVIDENCE")),
        (("A", own, own, own, 200, None, page("", "Gift card", "none", '<meta itemprop="price">')), ("AUTO_SAFE", None)),
        (("A", own, own, own, 200, None, page("Gift card", "", "ΑΓΟΡΆ")), ("AUTO_SAFE", None)),
        ((None, own, own, own, 200, None, None), ("REVIEW", "NO_STRONG_GIFT_CARD_EVIDENCE")),
    ]
    rows = [(i, *r) for i, (r, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, title string, item_url string, shop_url string, final_url string, status int, error string, html string")
    got = {r.id: (r.bucket, r.reason) for r in verify.decide(df, SIGNS).collect()}
    for i, (_, (bucket, reason)) in enumerate(cases):
        assert got[i][0] == bucket and (reason is None or got[i][1] == reason), (i, got[i])


def test_evidence_must_be_complete(spark):
    rows = spark.createDataFrame([(1,), (2,)], "id long")
    whole = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, note string")
    assert sorted(map(str, linkage.with_evidence(rows, whole, "id").collect())) == ["Row(id=1, note='a')", "Row(id=2, note=None)"]
    for bad in (whole.filter("id != 2"), whole.unionByName(whole)):
        with pytest.raises(PySparkException):
            linkage.with_evidence(rows, bad, "id").collect()
