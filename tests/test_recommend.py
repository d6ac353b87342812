import random

import pytest

from millrace.operators import recommend


def brute(items, links, same_owner, k):
    owners, out = dict(items), []
    for i, own in items:
        scores = {}
        for j, theirs in items:
            s = (same_owner if own is not None and own == theirs else 0) + sum(w * len({x for a, x in rows if a == i and x is not None} & {x for a, x in rows if a == j}) for rows, w in links)
            if i != j and s > 0:
                scores[j] = s
        best = {}
        for j, s in sorted(scores.items(), key=lambda x: (-x[1], x[0])):
            best.setdefault(owners[j], (j, s))
        ranked = sorted(best.values(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(i, j, s, r + 1) for r, (j, s) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("hot", [500, 6, 0])
def test_same_as_all_pairs(spark, hot):
    rng = random.Random(hot)
    items = [(i, rng.choice([None, "a", "b", "c", "d", "e"])) for i in range(120)]
    tags = [(i, rng.choice(["x", "y", "z", "rare%d" % rng.randrange(30), None])) for i, _ in items for _ in range(rng.randrange(4))]
    kinds = [(i, rng.randrange(3)) for i, _ in items[:80]]
    frame = lambda rows, kind: spark.createDataFrame(rows, f"id long, key {kind}")
    df = spark.createDataFrame(items, "id long, owner string")
    got = recommend.related_items(df, "id", "owner", [(frame(tags, "string"), 3), (frame(kinds, "int"), 2.5)], 4, 5, hot)
    assert sorted(tuple(r) for r in got.collect()) == brute(items, [(tags, 3), (kinds, 2.5)], 4, 5)


def test_nothing_in_common(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, None)], "id long, owner string")
    none = spark.createDataFrame([], "id long, key string")
    assert recommend.related_items(df, "id", "owner", [(none, 1)], 2, 3).collect() == []
    assert recommend.related_items(df.limit(0), "id", "owner", [(none, 1)], 2, 3).collect() == []
