import hashlib
import random

import numpy as np

from millrace.llm import repeats


def brute(docs, length):
    """doc rows in order -> (n_bytes, n_removed, n_spans, sha) by a dictionary of all strings."""
    seen, out = {}, []
    for place, (doc_id, text) in sorted(enumerate(docs), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                gone[i : i + length] = True
            seen.setdefault(raw[i : i + length], (doc_id, i))
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc_id, len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=120):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé ") for _ in range(rnd.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(rnd.randint(15, 60)) for _ in range(6)]
    base = text(120)
    docs = []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.25:
            t = base
            for _ in range(rnd.randint(0, 4)):
                a = rnd.randint(0, len(t))
                t = t[:a] + word() + t[a + rnd.randint(0, 5) :]
        elif kind < 0.6:
            t = text(rnd.randint(0, 40)) + rnd.choice(passages) + text(rnd.randint(0, 40)) + rnd.choice(passages)
        elif kind < 0.7:
            t = "ab " * rnd.randint(10, 120)
        elif kind < 0.8 and docs:
            t = rnd.choice(docs)[1]
        else:
            t = text(rnd.randint(0, 60))
        docs.append((i * 3 + 1, t))
    docs += [(2, None), (5, ""), (None, passages[0] + "x")]
    return docs


def check(spark, docs, length=100):
    frame = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, th string").repartition(5)
    got = sorted(map(tuple, repeats.repeats_digest(frame, length).collect()), key=str)
    assert got == sorted(brute(docs, length), key=str)


def test_against_brute_force(spark):
    for seed in range(3):
        check(spark, corpus(seed))


def test_an_anchor_in_many_ranges(spark):
    rnd = random.Random(9)
    line = "one very common line that stands in nearly all of the texts of this corpus, give or take a few, at some place"
    tail = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    tails = [tail(60) for _ in range(8)]
    check(spark, [(i, tail(rnd.randint(0, 30)) + line[rnd.randint(0, 9) :] + rnd.choice(tails)[: rnd.randint(1, 60)] + tail(40)) for i in range(400)])


def test_small_pieces_and_runs(spark, monkeypatch):
    found = list(repeats.anchors(b"abc " * 300, 100))
    assert len(found) == 1
    pieces = list(repeats.anchors(b"abc " * 300, 100, piece=100))
    starts = {p for _, _, a, b in pieces for i, j in zip(a, b) for p in range(i, j + 1)}
    assert starts == set(range(1200 - 99))


def test_loser_tree():
    rnd = random.Random(4)
    for k in (1, 2, 5, 9):
        runs = [sorted((bytes(rnd.choices(b"ab", k=rnd.randint(1, 9))), (r, i, 0, 1)) for i in range(rnd.randint(0, 30))) for r in range(k)]
        coded = []
        for run in runs:
            row = repeats._front_coded([x[0] for x in run], [x[1] for x in run], 0)
            coded.append(repeats.decode_run(*row[1:7]))
        out = list(repeats.LoserTree(coded))
        keys = [x[0] for x in out]
        assert keys == sorted(x[0] for run in runs for x in run)
        for a, b in zip(out, out[1:]):
            n = b[1]
            assert a[0][:n] == b[0][:n] and (n == min(len(a[0]), len(b[0])) or a[0][n] != b[0][n])


def test_repeated_rows_and_empty_table(spark):
    text = "some words that go on for more than a hundred bytes so that a string can be found in here, and then some more"
    frame = spark.createDataFrame([(1, text), (1, text), (2, text), (3, "short")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in repeats.repeats_digest(frame).collect())
    assert got == [(1, 0), (1, 0), (2, len(text)), (3, 0)]
    assert sorted(r.doc_id for r in repeats.remove_repeats(frame).collect()) == [1, 1, 3]
    assert repeats.repeats_digest(frame.limit(0)).count() == 0
