import hashlib
import re

from millrace.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, width=13):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        n = min(width, len(b))
        for i in range(len(b) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == b[i : i + n]:
                    hit.update(range(j, j + n))
                    if item is not None:
                        found.add(item)
    return len(w), hit, found


def tables(spark):
    base = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(base)), (2, "Short One!"), (10, "short one"), (3, None), (4, "..."), (None, "x y z"), (5, "É a b " * 9)]
    docs = [
        (1, "pre " + ", ".join(base[3:20]).upper() + " post", "a"),
        (2, None, "b"),
        (3, "", None),
        (4, "a short-one and SHORT\tone", "c"),
        (5, " ".join(base[:12]), "d"),
        (6, "É A B " * 5000, "e"),
        (None, "short one", "f"),
        (1, "clean text", "g"),
    ]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, items string"),
        spark.createDataFrame(items, "item_id long, text string"),
        docs,
        items,
    )


def test_against_brute_force(spark):
    docs, bench, rows, items = tables(spark)
    for block in (8_000_000, 20):
        got = decontam.contamination_digest(decontam.find_contamination(docs, bench, block_chars=block)).collect()
        want = []
        for doc_id, text, _ in rows:
            n, hit, found = brute(text if len(text or "") < 9000 else text[:600], items)
            if len(text or "") >= 9000:
                n, hit = len(words(text)), range(len(words(text)))
            sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
            want.append((doc_id, n, len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= n))
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_spans_and_empty_tables(spark):
    docs, bench, _, _ = tables(spark)
    found = decontam.find_contamination(docs, bench)
    texts = {r[1] for r in decontam.remove_spans(found).filter("doc_id = 1").collect()}
    assert texts == {"pre  post", "clean text"}
    assert decontam.find_contamination(docs.limit(0), bench).count() == 0
    assert decontam.contamination_digest(decontam.find_contamination(docs, bench.limit(0))).filter("n_hit > 0").count() == 0


def test_clashing_names_and_a_long_text(spark):
    docs, bench, rows, _ = tables(spark)
    docs = docs.withColumn("n_words", docs.doc_id).withColumn("spans", docs.doc_id).unionByName(
        spark.createDataFrame([(50, "日" * 1_000_000 + " w " + "b " * 200_000, "z", 1, 1)], docs.withColumn("n_words", docs.doc_id).withColumn("spans", docs.doc_id).schema)
    )
    for block in (8_000_000, 20):
        left = decontam.drop_contaminated(docs, bench, block_chars=block)
        assert left.columns == docs.columns
        assert sorted(r.items for r in left.collect() if r.items) == ["b", "d", "g", "z"]


def test_blocks_meet_by_text(spark, monkeypatch):
    """Texts that repeat, and items of several blocks in one text, with earlier hits broadcast and shuffled."""
    items = [(k, " ".join(f"w{k}x{j}" for j in range(13))) for k in range(6)] + [(None, "free words")]
    both = f"{items[0][1]} and {items[3][1]} and {items[5][1]} free words"
    rows = [(i, both if i % 3 else items[i % 6][1]) for i in range(60)] + [(60, None), (61, ""), (62, "free words"), (63, "nothing here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (8_000_000, 0):
        monkeypatch.setattr(decontam, "_BROADCAST_BYTES", most)
        got = {r.doc_id: r for r in decontam.find_contamination(docs, bench, block_chars=100).collect()}
        assert len(got) == len(rows)
        for doc_id, text in rows:
            n, hit, found = brute(text, items)
            r = got[doc_id]
            assert (r.n_words, {k for s in r.spans for k in range(s.start, s.end)}, set(r["items"])) == (n, hit, found)
