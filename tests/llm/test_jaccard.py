import random

import numpy as np
import pyarrow as pa

from millrace.llm import jaccard
from millrace.plans.graph import connected


def shingles(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def brute(docs, width, percent):
    sets = [(i, shingles(t, width)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    least = {}
    for i in parent:
        least[root(i)] = min(i, least.get(root(i), i))
    return sorted((i, len(s), least[root(i)]) for i, s in sets)


def corpus(seed, n=150):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "and"] * 6 + [f"w{k}" for k in range(60)])
    base = [[word() for _ in range(rnd.choice([3, 9, 30, 60]))] for _ in range(5)]
    docs = []
    for i in range(n):
        w = list(rnd.choice(base)) if rnd.random() < 0.8 else [word() for _ in range(rnd.randint(0, 40))]
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 4])):
            if w:
                w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 400)}"
        docs.append((1000 - i, rnd.choice([" ", "  ", "\n"]).join(w).title()))
    return [*docs, (2000, ""), (2001, None), (2002, "One two"), (2003, "one TWO"), (2004, "É"), (2005, "é")]


def test_against_brute_force(spark):
    for seed, width, percent in ((0, 3, 90), (1, 3, 90), (2, 5, 80), (3, 2, 60)):
        docs = corpus(seed)
        frame = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, n long").repartition(4)
        found = jaccard.link_groups(frame, width, percent).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, found)) == brute(docs, width, percent), (seed, width, percent)


def test_bounds():
    rnd = random.Random(0)
    for _ in range(500):
        pool = np.arange(rnd.randint(1, 60), dtype=np.uint64)
        x, y = (np.sort(np.array(rnd.sample(list(pool), rnd.randint(1, len(pool))), np.uint64)) for _ in range(2))
        both = len(set(x) & set(y))
        for percent in (60, 80, 90):
            assert jaccard.similar(x, y, percent) == (100 * both >= percent * (len(x) + len(y) - both))


def test_nulls_repeats_and_empty_table(spark):
    frame = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (5, "q r s t"), (7, "q r s t")], "doc_id long, text string")
    got = sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link_groups(frame, 3, 90).collect())))
    assert got == sorted(["(None, 2, None)", "(5, 2, 5)", "(5, 2, 5)", "(5, 2, 5)", "(7, 2, 5)"])
    assert jaccard.link_groups(frame.limit(0), 3, 90).count() == 0


def test_connected(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r.node: r.group for r in connected(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90}


def test_sets_of_a_batch():
    rnd = random.Random(3)
    texts = ["".join(rnd.choices("aAbÉé \n\t\x0b\x1c　", k=rnd.randint(0, 40))) for _ in range(400)] + [None, "", " ", "x"]
    for width in (1, 2, 5):
        found, sizes = jaccard.shingle_sets(pa.array([*texts, "y"])[:-1], width)
        parts, at = np.split(found, np.cumsum(sizes)[:-1]), {}
        for text, own in zip(texts, parts, strict=True):
            want = shingles(text, width)
            assert len(own) == len(want) and list(own) == sorted(set(own.tolist()))
            assert at.setdefault(tuple(own.tolist()), want) == want  # equal hashes only for equal sets
        for at_once in (1, 200, 1 << 40):
            again, n = jaccard.shingle_sets(pa.array(texts), width, at_once)
            assert (again == found).all() and (n == sizes).all()
        classes = jaccard.set_classes(found, sizes)
        assert len(set(classes.tolist())) == len(at)


def test_packed_tokens():
    rnd = np.random.default_rng(0)
    for top in (3, 1 << 20, 1 << 47):
        for n in (0, 1, 2, 500):
            values = np.sort(rnd.integers(0, top, n))
            assert jaccard.unpack_sorted(jaccard.pack_sorted(values)).tolist() == values.tolist()


def test_one_word_without_blanks_and_clashing_columns(spark):
    long = "日" * 1_000_000
    rows = [(1, long, 1), (2, long + " x", 2), (3, long, 3), (4, "a b c d e f", 4), (None, "a b c d e f", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, gone long")
    left = jaccard.drop_near_copies(frame.withColumn("row", frame.gone).withColumn("label", frame.gone))
    assert left.columns == ["doc_id", "text", "gone", "row", "label"]
    assert sorted((r.gone, r.row) for r in left.collect()) == [(1, 1), (2, 2), (4, 4), (5, 5)]
    assert jaccard.drop_near_copies(frame.limit(0)).count() == 0


def test_words_made_to_collide_and_ids_with_several_texts(spark):
    x, y = "a", "b"
    for _ in range(10):  # Thue-Morse words: equal under any polynomial modulo a power of two
        x, y = x + y, y + x
    docs = spark.createDataFrame([(1, f"{x} p q"), (2, f"{y} p q")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.link_groups(docs, width=3, percent=90).collect()} == {1: 1, 2: 2}
    rows = [(5, "one two three four"), (5, "six seven eight nine"), (3, "one two three four"), (9, "six seven eight nine"), (7, "ten eleven twelve"), (None, "one two three four")]
    found = jaccard.link_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=90).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in found if r.doc_id) == [(3, 3), (5, 3), (5, 3), (7, 7), (9, 3)]
