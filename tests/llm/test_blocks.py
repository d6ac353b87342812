import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import blocks, registry
from tests.sql import SF, views


def brute(rows, width=35):
    """(id, words, words removed, digest of the kept ones) of each row."""
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = {i + k for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for k in range(width)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def by(rows):
    return sorted(map(tuple, rows), key=str)


def corpus(rng, width):
    fresh = iter(f"u{i}" for i in range(10**9))
    new = lambda n: [next(fresh) for _ in range(n)]
    docs = [(i, new(rng.randrange(0, 4 * width))) for i in range(60)]
    passages = [new(n) for n in (width - 1, width, width + 1, 3 * width)]
    for i in range(60, 140):  # passages at any place, cut off at any end
        p = rng.choice(passages)
        a = rng.randrange(0, 3)
        docs.append((i, new(rng.randrange(0, width)) + p[a : len(p) - rng.randrange(0, 3)] + new(rng.randrange(0, 5))))
    docs.append((200, passages[3] * 3))
    docs.append((201, ["same"] * (3 * width)))
    docs.append((202, ["a", "b"] * width))
    near = new(5 * width)
    for i in range(300, 360):  # near copies
        w = list(near)
        w[rng.randrange(len(w))] = f"edit{i}"
        docs.append((i, w))
    rows = [(i, rng.choice([" ", "  ", "\n", "\t\r"]).join(w)) for i, w in docs]
    rows += [(400 + i, rows[5][1]) for i in range(30)] + [(7, rows[6][1]), (7, rows[7][1]), (7, rows[7][1]), (None, rows[8][1]), (None, "x " * 40), (None, None), (900, ""), (901, " \n "), (902, "é日 " * (width + 5))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("run,width", [(1, 35), (3, 35), (5, 35), (2, 7), (1, 1)])
def test_against_plain_version(spark, monkeypatch, run, width):
    rows = corpus(random.Random(run * 100 + width), width)
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, ord int, digest string").repartition(5)
    for unit, words in ((1_500_000, 400_000), (300, 50)):
        monkeypatch.setattr(blocks, "_UNIT", unit)
        monkeypatch.setattr(blocks, "_WORDS", words)
        for max_broadcast in (100_000, 0):
            got = blocks.blocks_digest(docs, width, run, max_broadcast=max_broadcast).collect()
            assert by(got) == by(brute(rows, width)), (unit, max_broadcast)
    left = blocks.remove_repeats(docs, width, run)
    assert left.columns == docs.columns
    want = Counter((i, sha) for i, n, gone, sha in brute(rows, width) if gone < n or n == 0)
    assert Counter((r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in left.collect()) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=7, max_size=80), st.integers(1, 3), st.integers(5, 40))
def test_pieces_of_a_text_make_no_difference(words, run, piece):
    width = 7
    size = blocks.block_size(width, run)
    h = np.random.default_rng(0).integers(0, 2**63, (4, 2), np.uint64)[words]
    join = lambda xs: [np.concatenate(x) for x in zip(*xs, strict=True)]
    whole, parts = join(blocks.probes(h[:, 0], size, run)), join(blocks.probes(h[:, 0], size, run, piece))
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    hits = np.zeros(len(h), bool)
    hits[whole[0]] = True
    a, b = join(blocks.windows(h, hits, width, size, run)), join(blocks.windows(h, hits, width, size, run, piece))
    assert all((x == y).all() for x, y in zip(a, b, strict=True)) and len(a[0]) == len(h) - width + 1  # all may repeat if all are hits


def test_long_text_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(blocks, "_PIECE", 1000)
    monkeypatch.setattr(blocks, "_WORDS", 700)
    text = " ".join(f"w{i}" for i in range(20_000)) + " " * 3000 + " ".join(f"w{i}" for i in range(9_000, 9_500)) + " " + "日" * 5000
    rows = [(1, text), (2, "z " * 30 + " ".join(f"w{i}" for i in range(15_000, 15_040)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert by(blocks.blocks_digest(docs).collect()) == by(brute(rows))
    assert blocks.blocks_digest(docs.limit(0)).collect() == [] and blocks.remove_repeats(docs.limit(0)).collect() == []


def test_block_sizes():
    for width in range(1, 60):
        for run in range(1, width + 1):
            size = blocks.block_size(width, run)
            assert run * size + size - 1 <= width < run * (size + 1) + size
    with pytest.raises(ValueError):
        blocks.block_size(3, 5)


@pytest.mark.parametrize("name", ["op13_repeated_windows"])
def test_query_against_plain_version(spark, name):
    rows = views().sql("SELECT doc_id, text FROM documents").fetchall()
    assert by(registry.QUERIES[name](spark, SF).collect()) == by(brute(rows))
