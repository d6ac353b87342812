"""Line-first quality rules.

Every line of a text is judged by itself: too many symbols, words mostly in capitals, a list of links,
boilerplate phrases, one word over and over, a repetition of an earlier line, or no sentence end. Lines that
fail are removed, and a document that loses more than ``max_loss`` of its words' characters is rejected.
Before that, two rules on the whole text reject texts that are too short or repeat themselves.

An end is any script's sentence mark; lines mostly in scripts that write none (Thai, Lao) needn't have one.

Defined results: a null or empty text has no words and is rejected; blank lines are dropped and count for
nothing; repeated rows are judged one by one; an empty table gives no rows. Whole texts are read, however long, in
time that grows with their length. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
# Sentence marks by script (Latin and Greek, CJK, Devanagari, Arabic and Urdu, Armenian, Ethiopic, Khmer,
# Burmese, Tibetan), letters of scripts without any, and phrases of boilerplate in the languages that are common on the web.
_ENDS = re.compile(r"""[.!?…:;;。！？．｡।॥؟۔؛։።፧។၊။།]["'”’»)\]」』）]*$""")
_UNMARKED = re.compile("[\u0e00-\u0eff]")
_LINKS = re.compile(r"[|»›·•>]|\s/\s|\s-\s")
BOILERPLATE = (
    r"all rights reserved|©|copyright \(?c?\)?\s?\d{4}|terms (of (use|service)|and conditions)|privacy policy|cookie"
    r"|javascript|lorem ipsum|click here|subscribe|sign (in|up)|log ?in|spdx-license-identifier|licensed under"
    r"|alle rechte vorbehalten|datenschutzerkl|impressum|nutzungsbedingungen|hier klicken|newsletter abonnieren"
    r"|tous droits réservés|mentions légales|politique de confidentialité|cliquez ici|s'abonner"
    r"|todos los derechos reservados|aviso legal|política de privacidad|haga clic|suscríbete"
    r"|todos os direitos reservados|política de privacidade|tutti i diritti riservati|informativa sulla privacy"
    r"|все права защищены|политика конфиденциальности|版权所有|隐私政策|無断転載|プライバシーポリシー|जुमला अधिकार|جميع الحقوق محفوظة"
)
_BOILERPLATE = re.compile(BOILERPLATE, re.IGNORECASE)
#: A line's verdicts, in the order in which they are tried.
REASONS = ("symbols", "capitals", "navigation", "boilerplate", "repeated_word", "repeated_line", "no_end")


def judge_line(line: str, words: list[str], seen: set[str], end_words: int = 4, long_words: int = 40, boilerplate: re.Pattern = _BOILERPLATE) -> str | None:
    """Why the line fails, if it does.

    Lines under end_words words (headings) may lack an end; so may lines from long_words words on (cut off) that
    have a sentence mark inside (a word with a sentence's end) for each full long_words words, as prose does.
    """
    n = len(words)
    if sum(map(line.count, SYMBOLS)) > 0.3 * n + 1:
        return "navigation" if line.count("|") > 0.3 * n else "symbols"
    if n >= 3:
        if sum(map(str.isupper, words)) > 0.6 * n:
            return "capitals"
        if len(_LINKS.findall(line)) >= max(3, 0.3 * n):
            return "navigation"
        if n >= 6 and max(sum(a == b for a, b in zip(words, words[1:], strict=False)), n - 3 * len(set(words))) > 0.3 * n:
            return "repeated_word"
    if n <= 20 and boilerplate.search(line):
        return "boilerplate"
    if line in seen:
        return "repeated_line"
    if n >= end_words and not _ENDS.search(line.rstrip(BLANKS)) and 2 * len(_UNMARKED.findall(line)) < sum(map(len, words)):
        if n < long_words or sum(1 for w in words if _ENDS.search(w)) < n // long_words:
            return "no_end"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three words that occur twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    n = len(ids)
    if n < 2_000_000:
        codes = (w[:-2] * n + w[1:-1]) * n + w[2:]
    else:  # pairs are numbered first, so that a code fits
        pairs = np.unique(w[:-1] * n + w[1:], return_inverse=True)[1]
        codes = pairs[:-1] * n + w[2:]
    _, which, counts = np.unique(codes, return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def judge_text(text: str | None, max_loss: float = 0.5, boilerplate: re.Pattern = _BOILERPLATE) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean text, removed lines)."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, BLANKS))
    seen: set[str] = set()
    dup_lines = lost = 0
    clean, removed = [], []
    for line in text.split("\n"):
        own = [w for w in re.split("[ \t\v\f\r]+", line) if w]
        if not own:
            continue
        why = judge_line(line, own, seen, boilerplate=boilerplate)
        dup_lines += line in seen
        seen.add(line)
        if why:
            lost += sum(map(len, own))
            removed.append(why)
        else:
            clean.append(line)
    repeats = repeated_words(words)
    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    kept = not failed and lost <= max_loss * chars
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup_lines, repeats, failed, kept, "\n".join(clean), removed


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, clean_text string, removed_lines array<string>"
)


def clean_lines(docs: DataFrame, max_loss: float = 0.5, boilerplate: str = BOILERPLATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA's columns for every row: counts, verdict, the text of the lines that pass, and why others failed.

    boilerplate is a regular expression, of phrases that give a short line away whatever their case.
    """
    types = [pa.int64()] * 6 + [pa.bool_(), pa.bool_(), pa.string(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(boilerplate, re.IGNORECASE)
        for batch in batches:
            rows = [(i, *judge_text(t, max_loss, pattern)) for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")]
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)
