import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import registry, resample
from tests.sql import SF, views

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def buckets_of(text, n=10_000):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % n for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target, percent=5, min_words=20, seed=42, n=10_000):
    s, t = [0] * n, [0] * n
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for b in buckets_of(text, n):
                counts[b] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + n) / ((s[b] + 1) * (T + n)))) for b in range(n)]
    rows = []
    for k, (doc_id, text) in enumerate(docs):
        found = buckets_of(text, n)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)) >= min_words])
    long_ones = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(long_ones[: percent * len(long_ones) // 100]):
        r[4] = rank + 1
    return [tuple(r[:5]) for r in rows]


def by(rows):
    return sorted(map(tuple, rows), key=str)


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(60)] + ["Ärger", "日本", "MIXED-case", "a.b", "x" * 90]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 19, 20, 21, 60])))) for i in range(n)]
    hot = " ".join(rng.choices(vocabulary, k=40))
    docs += [(10_000 + i, hot) for i in range(n // 2)] + [(7, hot)] * (n // 4) + [(None, hot), (None, None), (20_000, None), (20_001, ""), (20_002, "...")]
    return docs, [" ".join(rng.choices(vocabulary[:20], k=30)) for _ in range(5)] + [None]


def test_against_plain_version(spark, monkeypatch):
    docs, target = corpus(random.Random(5), 300)
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string").repartition(7)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for percent, run_rows, range_rows, pieces, n in ((5, 200_000, 100_000, 1024, 10_000), (40, 20, 10, 3, 10_000), (100, 50, 7, 8, 50), (0, 50, 7, 8, 50), (63, 9, 1, 2, 50)):
        monkeypatch.setattr(resample, "_ROWS", pieces)
        got = resample.resample(frame, goal, percent, run_rows=run_rows, range_rows=range_rows, buckets=n).collect()
        assert by(got) == by(brute(docs, target, percent, n=n)), (percent, run_rows)


def test_features_in_stretches(monkeypatch):
    rng = random.Random(3)
    docs, _ = corpus(rng, 40)
    texts = [t for _, t in docs] + ["one two three four five " * 400]
    for stretch, piece, most in ((400_000, 4 << 20, 500_000), (1, 1, 1), (7, 30, 20)):
        for name, value in (("_WORDS", stretch), ("_PIECE", piece), ("_VOCABULARY", most)):
            monkeypatch.setattr(resample, name, value)
        n_words, found = np.zeros(len(texts), int), [[] for _ in texts]
        for owners, mine, buckets in resample.features(texts, 997, resample.Vocabulary()):
            n_words += np.bincount(owners, minlength=len(texts))
            for o, b in zip(mine.tolist(), buckets.tolist(), strict=True):
                found[o].append(b)
        assert n_words.tolist() == [len(words(t)) for t in texts]
        assert [sorted(f) for f in found] == [sorted(buckets_of(t, 997)) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=300))
def test_checksums_of_appended_texts(a, b):
    got = resample.append_crc(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)], np.int64))
    assert got[0] == zlib.crc32(a + b)


def test_tournament_tree():
    rng = random.Random(1)
    for k in (1, 2, 3, 9):
        runs = [sorted(rng.choices(range(50), k=rng.randint(1, 30))) for _ in range(k)]
        tree = resample.TournamentTree()
        for n, r in enumerate(runs):
            keys = [(v, n, i) for i, v in enumerate(r)]
            half = max(1, len(keys) // 2)
            tree.add(n, keys[:half], keys[:half])
            if keys[half:]:
                tree.add(n, keys[half:], keys[half:])
        out = []
        while tree.peek() is not None:
            out.append(tree.pop())
        assert out == sorted((v, n, i) for n, r in enumerate(runs) for i, v in enumerate(r))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    none = docs.select("text").limit(0)
    assert resample.resample(docs.limit(0), none).collect() == []
    assert by(resample.resample(docs, none, 100).collect()) == by(brute([(1, "a b c " * 10)], [], 100))


@pytest.mark.parametrize("name", ["op12_importance_resampling"])
def test_query_against_plain_version(spark, name):
    con = views()
    docs, target = con.sql("SELECT doc_id, text FROM documents").fetchall(), [r[0] for r in con.sql("SELECT text FROM benchmark").fetchall()]
    assert by(registry.QUERIES[name](spark, SF).collect()) == by(brute(docs, target))
