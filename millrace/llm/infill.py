"""Fill-in-the-middle: documents cut into prefix, middle and suffix, put in another order between sentinels.

One Aho-Corasick automaton reads a text once, piece by piece. Its events are the sentinels, and the ASCII
characters that change the class a unit is made of (line breaks for lines, blanks for words, none for characters).
What lies between two events is a gap, and how many units end in a gap follows from its length alone; so running
sums over the events tell how many units there are, and where any of them ends is a binary search in these sums
and a subtraction within one gap. Units themselves are never listed.

Units: ``line``, a line with its line break; ``word``, a run of other characters than ASCII blanks, with the blanks
before it (blanks at the end are one more unit); ``char``, a code point.

Defined results: a null text is empty; empty texts, those that contain a sentinel, and those that the draw leaves
out are plain, and come out as they are. Draws depend on the seed and the id alone, so rows that repeat an id are cut
by equal draws, each by its own units, and rows without an id by those of an empty one. Whole texts are cut, however
long. An empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that change the class of what stands beside them, by the kind of unit.
CHANGES = {"line": "\n", "word": "\t\n\x0b\x0c\r ", "char": ""}
_PIECE = 1 << 20


@dataclass(frozen=True)
class Sentinels:
    """What stands before the prefix, the suffix and the middle. None may be found where two others or a text meet them."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        names = (self.prefix, self.suffix, self.middle)
        if len(set(names)) < 3 or not all(names):
            raise ValueError("sentinels must be three different texts")
        for a in names:
            for b in names:
                if (a != b and a in b) or any(a.endswith(b[:n]) for n in range(1, len(b))):
                    raise ValueError(f"an end of {a!r} may begin {b!r}: what was cut could not be told from the sentinels")

    def __iter__(self) -> Iterator[str]:
        return iter((self.prefix, self.suffix, self.middle))


class Units:
    """How many units a text has and where each ends, from the places of its class-changing characters."""

    def __init__(self, kind: str, events: np.ndarray, length: int):
        edges = np.concatenate(([-1], events, [length]))
        gaps = np.diff(edges) - 1  # characters between events; the last gap has no event behind it
        self.kind, self.starts = kind, edges[:-1] + 1
        if kind == "char":
            in_gap, at_event = gaps, np.ones(len(gaps), np.int64)
        elif kind == "word":
            in_gap, at_event = (gaps > 0).astype(np.int64), np.zeros(len(gaps), np.int64)
        else:
            in_gap, at_event = np.zeros(len(gaps), np.int64), np.ones(len(gaps), np.int64)
        at_event[-1] = 0
        self.gaps, self.sums = gaps, np.cumsum(in_gap + at_event)
        whole = int(self.sums[-1])
        # what is left behind the last end is a unit of its own: a line without a break, blanks without a word
        self.count = whole + (length > (self._place(whole) if whole else 0))
        self.whole, self.length = whole, length

    def _place(self, k: int) -> int:
        g = int(np.searchsorted(self.sums, k))
        before = int(self.sums[g - 1]) if g else 0
        if self.kind == "char":
            return int(self.starts[g]) + k - before
        return int(self.starts[g] + self.gaps[g]) + (self.kind == "line")

    def end(self, k: int) -> int:
        """The place behind the k-th unit; 0 for none."""
        return 0 if k == 0 else self._place(k) if k <= self.whole else self.length


class Scanner:
    """The automaton of a kind of unit and some sentinels."""

    def __init__(self, kind: str, sentinels: Sentinels):
        self.kind, self.automaton = kind, ahocorasick.Automaton()
        for c in CHANGES[kind]:
            self.automaton.add_word(c, False)
        for s in sentinels:
            self.automaton.add_word(s, True)
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[Units, bool]:
        """The units of a text, and whether a sentinel is in it."""
        found, blocked, places = None, False, [np.zeros(0, np.int64)]
        for at in range(0, len(text), _PIECE):
            piece = text[at : at + _PIECE]
            if found is None:
                found = self.automaton.iter(piece)
            else:
                found.set(piece)  # goes on in the state that the piece before it led to
            events = [(place, sentinel) for place, sentinel in found]
            blocked = blocked or any(s for _, s in events)
            places.append(np.array([p for p, s in events if not s], np.int64))
        return Units(self.kind, np.concatenate(places), len(text)), blocked


def _draws(ident: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(
    docs: DataFrame,
    unit: str = "line",
    seed: int = 7,
    percent: int = 100,
    spm_percent: int = 50,
    sentinels: Sentinels = Sentinels(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain) and output of every row.

    Of n units, the smaller and the larger of two draws from 0 to n end the prefix and the middle. percent of the
    documents are cut; of these, spm_percent begin with the suffix (spm), the others with the prefix (psm).
    """
    if unit not in CHANGES:
        raise ValueError(f"units are {', '.join(CHANGES)}")
    ident = F.col(id_col).cast("long")
    rows = docs.select(ident.alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *_draws(ident, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, (p, s, m) = Scanner(unit, sentinels), sentinels
        for batch in batches:
            counts, forms, prefixes, middles, outputs = [], [], [], [], []
            for text, h1, h2, h3, h4 in zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True):
                units, blocked = scanner.scan(text)
                n, first, second, out = units.count, None, None, text
                form = "plain" if not text or blocked or h3 % 100 >= percent else "spm" if h4 % 100 < spm_percent else "psm"
                if form != "plain":
                    first, second = (units.end(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                    parts = (p, text[:first], s, text[second:]) if form == "psm" else (s, text[second:], p, text[:first])
                    out = "".join((*parts, m, text[first:second]))
                counts.append(n)
                forms.append(form)
                prefixes.append(first)
                middles.append(None if first is None else second - first)
                outputs.append(out)
            new = [pa.array(counts, pa.int64()), pa.array(forms), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text that an output was made of, from it and its form alone."""
    quoted = "|".join("".join(c if c.isalnum() else "\\" + c for c in s) for s in sentinels)
    parts = F.split(output, quoted, -1)  # nothing, then the three parts
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def infill_digest(cut: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of fill_in_middle()'s rows."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


#: infill_digest() of documents cut at lines, with the seed 7.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l FROM documents),
k AS (
  SELECT *, CAST(len(l) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(l) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(l) + 1) AS b,
         text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain,
         CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 AS spm FROM d),
c AS (
  SELECT doc_id, text, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(l[1 : least(a, b)], '') AS p, array_to_string(l[least(a, b) + 1 : greatest(a, b)], '') AS m,
         array_to_string(l[greatest(a, b) + 1 :], '') AS s FROM k)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form != 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""
