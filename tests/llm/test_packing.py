import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from millrace.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def corpus(spark, n=60):
    rows = [(i, ("word " * (1 + i * 7 % 50) + f"tail {i}. ") * (1 + i % 4), "big" if i % 3 == 0 else f"s{i % 5}", i) for i in range(n)]
    rows += [(500, None, "big", 1), (501, "", None, 2), (7, "again the same id", "s1", 3), (None, "no id <|endoftext|>", "s1", 4), (502, "long " * 9000, "big", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, start long").repartition(4), rows


def check(pieces, rows, window):
    tok = Tokenizer.from_file(PATH)
    whole = defaultdict(list)
    for i, t, *_ in rows:
        whole[i].append(tok.encode(t or "", add_special_tokens=False).ids + [1])
    sequences, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0
        sequences[p.sequence_id].append((p.offset, p.length, p.source))
        docs[p.doc_id].append((p.start, ids, p.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, n, _ in sorted(parts):
            assert offset == at
            at += n
        assert at == window or (at < window and at & (at - 1) == 0)
    for i, texts in whole.items():
        if len(texts) == 1:
            found = sorted(docs[i])
            assert sum((x for _, x, _ in found), []) == texts[0]
            assert [s for s, _, _ in found] == np.cumsum([0, *(len(x) for _, x, _ in found)])[:-1].tolist()
            assert {n for *_, n in found} == {len(texts[0])}
        else:
            assert sum(len(x) for _, x, _ in docs[i]) == sum(map(len, texts))
    return sequences


def test_every_id_once_and_no_padding(spark):
    docs, rows = corpus(spark)
    for window in (64, 2048):
        pieces = packing.pack(docs, PATH, window).collect()
        check(pieces, rows, window)
    digest = {(r.doc_id, r.start): r.ids_crc32 for r in packing.pack_digest(packing.pack(docs, PATH)).collect()}
    want = {(p.doc_id, p.start): zlib.crc32(p.ids) for p in pieces}
    assert digest == want


def test_target_shares_hold_while_queues_last(spark):
    rows = [(i, "some words here " * 8, "a" if i % 4 else "b", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, start long")
    sequences = check(packing.pack(docs, PATH, 256, shares={"a": 1, "b": 1}).collect(), rows, 256)
    first = [x for k in range(20) for x in sequences[k]]
    share = sum(n for _, n, s in first if s == "b") / sum(n for _, n, _ in first)
    assert abs(share - 0.5) < 0.03
    check(packing.pack(docs, PATH, 256, shares={"a": 1}).collect(), rows, 256)
    check(packing.pack(docs, PATH, 256, max_queues=1).collect(), rows, 256)


def test_shares_hold_for_any_number_of_sources(spark):
    rows = [(i, "some words here " * 8, "a" if i % 4 else f"b{i % 3}", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, start long")
    for shares in ({"a": 1, "b0": 1}, None):
        few, many = (packing.pack(docs, PATH, 256, shares=shares, max_queues=n).drop("ids").collect() for n in (1024, 2))
        assert sorted(few) == sorted(many)
        if shares:
            first = [p for p in many if p.sequence_id < 5]
            assert abs(sum(p.length for p in first if p.source == "b0") / sum(p.length for p in first) - 0.5) < 0.06


def test_empty_table(spark):
    docs, _ = corpus(spark)
    assert packing.pack(docs.limit(0), PATH).count() == 0
