import random

import pytest

from millrace.operators import anchors


def fold(rows, threshold):
    """(block, id, anchor) by one walk through the rows (block, id, words, order)."""
    out, heads = [], {}
    for block, i, text, _ in sorted(rows, key=lambda r: (r[3] is None, r[3] or 0, r[1])):
        mine = set((text or "").split())
        found = next((a for a, words in heads.setdefault(block, []) if mine and words and len(mine & words) / min(len(mine), len(words)) >= threshold), None)
        if found is None:
            found = i
            heads[block].append((i, mine))
        out.append((block, i, found))
    return out


def key(r):
    return str(tuple(r))


@pytest.mark.parametrize("threshold,most", [(0.45, 50_000), (0.6, 0), (1.0, 50_000), (0.6, 50_000)])
def test_same_as_the_walk(spark, threshold, most):
    rng = random.Random(int(threshold * 100) + most)
    rows, n = [], 0
    for block, size, kinds in (("a", 150, 12), ("b", 60, 40), (None, 40, 6), ("c", 1, 3)):
        for _ in range(size):
            words = " ".join(f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(0, 6)))
            rows.append((block, n, rng.choice([words, words, words, None if rng.random() < 0.1 else words]), rng.choice([None, *range(9)])))
            n += 1
    # a chain: each row is like the next alone
    rows += [("chain", 1000 + i, f"c{i} c{i + 1}", i) for i in range(40)]
    df = spark.createDataFrame(rows, "block string, id long, words string, place int").repartition(3)
    got = anchors.greedy_groups(df, ["block"], "id", "words", "place", threshold, most).collect()
    assert sorted(map(tuple, got), key=key) == sorted(fold(rows, threshold), key=key)


def test_a_large_block_of_rows_that_are_alike(spark):
    rng = random.Random(2)
    rows = [("x", i, " ".join(["street", "athens", f"n{rng.randrange(30)}", f"p{rng.randrange(30)}", f"k{rng.randrange(30)}"]), i % 77) for i in range(3000)]
    df = spark.createDataFrame(rows, "block string, id long, words string, place int")
    got = anchors.greedy_groups(df, ["block"], "id", "words", "place", 0.8).collect()
    assert sorted(map(tuple, got), key=key) == sorted(fold(rows, 0.8), key=key)


def test_empty_and_bad_threshold(spark):
    df = spark.createDataFrame([], "block string, id long, words string, place int")
    assert anchors.greedy_groups(df, ["block"], "id", "words", "place", 0.5).collect() == []
    with pytest.raises(ValueError):
        anchors.greedy_groups(df, ["block"], "id", "words", "place", 0)
