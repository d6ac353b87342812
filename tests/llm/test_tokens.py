import random
import time

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import packing, tokens
from millrace.llm.registry import MASKS

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [*" \n\t  aé'ts,.1½\x1c　日ж🙂", "<|endoftext|>", "<|endof", "text|>"]


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_ids_are_those_of_the_library(text):
    tok = Tokenizer.from_file(PATH)
    for t in (text, f"{text}<|endoftext|>{text}", f"<|endoftext|>  {text}"):
        assert tokens.encoder(PATH).ids(t).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_other_files_use_the_library():
    enc = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert enc.slow and enc.ids("Two words").tolist() == Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode("Two words", add_special_tokens=False).ids


def test_trees_follow_edits():
    rnd, enc = random.Random(1), tokens.encoder(PATH)
    for _ in range(600):
        text = "".join(rnd.choices(ALPHABET, k=rnd.randint(0, 90)))
        parts = tokens.leaves(text, rnd.choice([1, 4, 12]))
        assert "".join(parts) == text
        tree = tokens.SegmentTree(parts, [enc.count(p) for p in parts])
        assert tree.tokens[1] == enc.count(text)
        for _ in range(3):
            at = sorted(rnd.randint(0, len(text)) for _ in range(2 * rnd.randint(1, 4)))
            edits = [(a, b, "".join(rnd.choices(ALPHABET, k=rnd.randint(0, 5)))) for a, b in zip(at[::2], at[1::2], strict=True)]
            tree.edit(edits, enc)
            for a, b, new in reversed(edits):
                text = text[:a] + new + text[b:]
            assert "".join(tree.parts) == text and tree.tokens[1] == enc.count(text) and tree.chars[1] == len(text)


def test_edits_of_a_table(spark):
    enc = tokens.encoder(PATH)
    rows = [(1, "mail a@b.c or call 555 1234 567 now " * 40, 0), (2, None, 0), (3, "", 0), (4, "nothing here", 0), (4, "nothing here", 0), (None, "x@y.z", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    masked = tokens.mask_edits(docs, [(r"\S+@\S+", "<mail>"), (r"\d[\d ]{6,}\d", "<number>")])
    out = tokens.apply_edits(tokens.build_trees(masked, PATH, 64), PATH).collect()
    assert len(out) == len(rows)
    for r in out:
        assert sum(r.leaf_tokens) == r.n_tokens == enc.count(r.text or "") and sum(r.leaf_chars) == len(r.text or "")
    long = next(r for r in out if r.doc_id == 1)
    assert long.n_edits == 80 and "@" not in long.text and long.n_tokens_before == enc.count(rows[0][1])
    edits = spark.createDataFrame([(4, 0, 7, "some"), (4, 3, 9, "late"), (4, 50, 60, "out"), (1, 0, 4, "post"), (9, 0, 0, "none")], "doc_id long, start long, end long, replacement string")
    out = tokens.apply_edits(tokens.build_trees(tokens.with_edits(docs, edits), PATH, 64), PATH).collect()
    assert {(r.doc_id, r.n_edits, r.n_ignored, (r.text or "")[:9]) for r in out} == {(1, 1, 0, "post a@b."), (2, 0, 0, ""), (3, 0, 0, ""), (4, 1, 2, "some here"), (None, 0, 0, "x@y.z")}
    one = next(r for r in out if r.doc_id == 1)
    assert 0 < one.n_chars_encoded < 200 and one.n_tokens == enc.count(one.text)
    assert tokens.apply_edits(tokens.build_trees(docs.limit(0), PATH), PATH).count() == 0


def test_long_texts_without_blanks(spark):
    rows = [(1, "日本語" * 350_000), (2, "a" * 1_000_000), (3, "日12345678本" * 100_000), (4, "x@" * 500_000), (5, "1-" * 500_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    start = time.perf_counter()
    masked = tokens.mask_edits(docs, MASKS)
    out = {r.doc_id: r for r in tokens.apply_edits(tokens.build_trees(masked, PATH), PATH).collect()}
    assert time.perf_counter() - start < 60
    assert out[3].n_edits == 100_000 and out[3].text == "日<number>本" * 100_000 and out[3].n_chars_encoded <= 2 * len(out[3].text)
    assert out[1].n_tokens == tokens.encoder(PATH).count(rows[0][1]) and out[1].n_edits == 0


def test_long_runs_of_white_space_and_texts_without_any(spark):
    library, enc = Tokenizer.from_file(PATH), tokens.encoder(PATH)
    same = lambda t: enc.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids
    n = tokens._RUN
    for run in (" ", "\n", "\t", " \n\t", "　", "\xa0 "):
        long_run = run * (n // len(run) + 3)
        for text in (long_run, "a" + long_run, long_run + "b", f"a{long_run}b, c{long_run}{long_run}", f"a {long_run}<|endoftext|>{long_run}'s", f"<|endoftext|>{long_run}"):
            assert same(text), (run, text[:3], text[-3:])
    assert same("日本語" * 20_000) and same("a\t" * 50_000)
    texts = [" " * 10_000_000, "x" + "\n" * 1_000_000 + "y", "\t" * 1_000_000 + "z"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    counts = {r.doc_id: r.n for r in packing.pack(docs, PATH).groupBy("doc_id").sum("length").withColumnRenamed("sum(length)", "n").collect()}
    assert counts == {i: enc.count(t) + 1 for i, t in enumerate(texts)}
    edits = tokens.mask_edits(docs, [(r"y", "yy")])
    found = tokens.apply_edits(tokens.build_trees(edits, PATH), PATH).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {i: enc.count(t.replace("y", "yy")) for i, t in enumerate(texts)}
