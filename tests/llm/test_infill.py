import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import infill

PATTERNS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\t\n\x0b\x0c\r ]*[^\t\n\x0b\x0c\r ]+|[\t\n\x0b\x0c\r ]+\Z", "char": r"(?s)."}


def brute(doc_id, text, unit="line", seed=7, percent=100, spm_percent=50):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(PATTERNS[unit], text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc_id, len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_percent:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "a\r\nb\r\n", " a  b ", "é日😀\n\n x y\x0bz", "x <P> y\n", "<S>", "a<\nM>\n", "<<P", "S>\nP>\n<M\n", "  \x1c a\x85b", "z\n" * 40 + "end",
]


@pytest.mark.parametrize("unit", list(PATTERNS))
def test_against_plain_version(spark, unit):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS * 3)] + [(None, "a\nb\nc\n", None, None), (1, "p\nq\n", None, None), (1, "p\nq\n", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, h1 int")
    for percent, spm in ((100, 50), (60, 10), (0, 50)):
        cut = infill.fill_in_middle(docs, unit, 7, percent, spm)
        got = cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", infill.restore(cut["output"], cut["form"]).alias("restored")).collect()
        want = [(*brute(i, t, unit, 7, percent, spm), t or "") for i, t, *_ in rows]
        key = lambda r: str(tuple(r))
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a \n\t<PSM>é日", max_size=40), st.sampled_from(list(PATTERNS)), st.integers(1, 9))
def test_units_end_where_the_pattern_says(text, unit, piece):
    before, infill._PIECE = infill._PIECE, piece
    try:
        units, blocked = infill.Scanner(unit, infill.Sentinels()).scan(text)
    finally:
        infill._PIECE = before
    found = [m.end() for m in re.finditer(PATTERNS[unit], text)]
    assert units.count == len(found) and [units.end(k) for k in range(len(found) + 1)] == [0, *found]
    assert blocked == any(s in text for s in infill.Sentinels())


def test_a_long_text_and_an_empty_table(spark):
    text = "日本\n" * 700_000 + "x" * 3_000_000 + "\nend"
    docs = spark.createDataFrame([(5, text)], "doc_id long, text string")
    want = brute(5, text)
    got = infill.infill_digest(infill.fill_in_middle(docs)).first()
    assert tuple(got)[:5] == want[:5] and got.output_sha256 == hashlib.sha256(want[5].encode()).hexdigest() and got.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert infill.infill_digest(infill.fill_in_middle(docs.limit(0))).collect() == []


def test_sentinels_that_could_be_mistaken():
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "><", "<M>"), ("<S><", "<S>", "x")):
        with pytest.raises(ValueError):
            infill.Sentinels(*bad)
    assert list(infill.Sentinels("[[p]]", "[[s]]", "[[m]]")) == ["[[p]]", "[[s]]", "[[m]]"]
