import random

import corpus_pipeline
from millrace.llm import langid
from tests.llm import test_decontam, test_jaccard, test_repeats


def corpus():
    rnd = random.Random(5)
    langs = {"en": ["the", "and", "house", "shining", "with", "river", "thought", "weather"], "de": ["der", "und", "schön", "Häuser", "nicht", "Straße", "über", "zwölf"]}
    docs = []
    for i in range(60):
        lang = rnd.choice(list(langs))
        w = [rnd.choice(langs[lang]) + rnd.choice(["", "", "s", "e", "t"]) for _ in range(rnd.randint(30, 90))]
        docs.append([i, " ".join(w), lang, f"s{i % 3}"])
    passage = docs[3][1][:180]
    docs += [[100, docs[5][1], "en", "s0"], [101, docs[6][1] + " more", "de", "s1"], [102, None, None, "s1"], [103, "", "en", None], [104, "12 34 --", "en", "s2"]]
    docs += [[105 + i, f"{docs[20 + i][1][:90]} {passage} {docs[30 + i][1][:120]}", docs[3][2], "s0"] for i in range(3)]
    docs += [[120, " ".join(f"item{k} word{k}" for k in range(20)) + " house und river", "en", "s1"]]
    return docs, [(1, " ".join(f"item{k} word{k}" for k in range(9))), (2, None)]


def test_against_brute_force(spark, tmp_path):
    docs, items = corpus()
    frame = spark.createDataFrame([(i, t, lang, s, len(t or ""), 1.5) for i, t, lang, s in docs], "doc_id long, text string, lang string, source string, n_chars long, start double")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    now, rows = spark.read.parquet(f"{sf}/documents.parquet"), sorted((i, t) for i, t, *_ in docs)

    model = langid.fit(frame)
    rejected = {i for (i, t) in rows if model.predict([t])[0][3]}
    assert {102, 103, 104} <= rejected and len(rejected) < 6
    expected = [[r for r in rows if r[0] not in rejected]]
    groups = {i: c for i, _, c in test_jaccard.brute(expected[-1], 5, 80)}
    expected.append([r for r in expected[-1] if groups[r[0]] == r[0]])
    assert {100, 101} & {i for i, _ in expected[-1]} == set()
    kept = []
    for (i, t), (_, _, removed, _, sha) in zip(expected[-1], test_repeats.brute(expected[-1], 100)):
        if removed < len(t.encode()):
            kept.append((i, (t, removed, sha)))
    stages = dict(corpus_pipeline.STAGES)
    for name, want in zip(("language", "near_copies"), expected):
        stages[name](spark, now, sf).write.parquet(f"{sf}/{name}")
        now = spark.read.parquet(f"{sf}/{name}")
        assert sorted((r.doc_id, r.text) for r in now.collect()) == want and now.columns == frame.columns
    stages["repeats"](spark, now, sf).write.parquet(f"{sf}/repeats")
    now = spark.read.parquet(f"{sf}/repeats")
    got = {r.doc_id: r for r in now.collect()}
    assert set(got) == {i for i, _ in kept} and any(removed for _, (_, removed, _) in kept)
    for i, (t, removed, _) in kept:
        assert len(t.encode()) - removed - 4 <= len(got[i].text.encode()) <= len(t.encode()) - removed and got[i].n_chars == len(got[i].text)
    stages["benchmarks"](spark, now, sf).write.parquet(f"{sf}/benchmarks")
    left = {r.doc_id for r in spark.read.parquet(f"{sf}/benchmarks").collect()}
    bad = set()
    for i, r in got.items():
        n, hit, _ = test_decontam.brute(r.text, items)
        if hit and 20 * len(hit) >= n:
            bad.add(i)
    assert bad == {120} and left == set(got) - bad
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {p.doc_id for p in pieces} == left
    sizes = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == sizes.get(p.sequence_id, 0)
        sizes[p.sequence_id] = p.offset + p.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes.values())


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    names = ["gone", "row", "label", "ord", "th", "digest", "kept", "first_ord", "n_words", "spans", "items", "_n_words", "size", "bits", "cls"]
    docs, items = corpus()
    frame = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in docs], "doc_id long, text string, lang string, source string, n_chars long")
    for n, name in enumerate(names):
        frame = frame.withColumn(name, frame.doc_id + n)
    for part, rows, bench in (("full", frame, items), ("empty", frame.limit(0), items), ("neither", frame.limit(0), [])):
        sf = str(tmp_path / part)
        rows.repartition(2).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        now = spark.read.parquet(f"{sf}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            stage(spark, now, sf).write.parquet(f"{sf}/{name}")
            now = spark.read.parquet(f"{sf}/{name}")
            assert now.columns == frame.columns
            assert all(r[c] == r.doc_id + n for r in now.collect() for n, c in enumerate(names))
        pieces = corpus_pipeline.STAGES[-1][1](spark, now, sf).count()
        assert (pieces > 0) == (now.count() > 0) == (part == "full")
