"""Token ids by public tokenizer files, and token counts that follow edits.

Counting keeps a segment tree for each document. Its leaves are stretches of about ``leaf_chars`` characters
that end where a pre-token is bound to end (before white space that follows something else), so the leaves'
tokens are the text's tokens. An edit encodes the leaves that it touches, and one more where it reaches a leaf's
border, and updates the sums on the way to the root; the rest of the text is never encoded again. Edits that
touch a common leaf encode it once, all together.

Ids are those that the tokenizers library gives without special tokens around a text: an added token's string
in a text is that token. Whole texts are encoded, however long. A text without any blank (or one of tabs alone) is
one leaf, and encoded whole at each edit.

Defined results: a null text is empty and has no tokens; edits refer to the text before all edits of the batch;
edits that overlap an earlier one, are out of order, or lie outside of the text are ignored and counted
(n_ignored); repeated rows are counted one by one. Other columns are ignored. A document's edits can't be more
than its characters plus one, so they travel with the document.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


# Fixed value: white space as the pre-tokenizer's pattern has it.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space in a row from which on it is encoded by itself, as the pattern can't take back as much as a million.
_RUN = 100_000
_LONG_RUN = re.compile(f"[{_WHITE}]{{{_RUN},}}")


class Encoder:
    """Ids of a byte-level BPE tokenizer file (JSON), by tiktoken's merging where its ids follow the order of merges.

    Any other file is left to the tokenizers library. An added token's string in a text is that token, as there.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens", ())
        special = {t["content"]: t["id"] for t in added}
        plain = not any(t.get(x) for t in added for x in ("single_word", "lstrip", "rstrip", "normalized"))
        vocab = {k: v for k, v in model["vocab"].items() if k not in special}
        self.size = 1 + max([*model["vocab"].values(), *special.values()])
        merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", ())]
        ranks = [vocab.get("".join(m), -1) for m in merges]
        by_rank = plain and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.fast = self.slow = None
        if by_rank and all(a < b for a, b in zip(ranks, ranks[1:], strict=False)) and len(vocab) == 256 + len(merges):
            import tiktoken
            from public_tokenizers import PATTERN

            letters = _byte_letters()
            ranked = {bytes(letters[c] for c in word): i for word, i in vocab.items()}
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranked, special_tokens=special)
            self.whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=ranked, special_tokens={})
            self.special = tuple(special)
        else:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(path)

    def ids(self, text: str) -> np.ndarray:
        """The text's ids, without special tokens around it, as unsigned 32-bit integers."""
        if not self.fast:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        out, at = [np.zeros(0, np.uint32)], 0
        # a long run of white space is a pre-token, but for its last character if more text follows
        for run in _LONG_RUN.finditer(text) if len(text) >= _RUN else ():
            end = run.end() - (run.end() < len(text) and not text.startswith(self.special, run.end()))
            out += [self._plain(text[at : run.start()]), self.whole.encode_to_numpy(text[run.start() : end])]
            at = end
        return np.concatenate([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> np.ndarray:
        return self.fast.encode_to_numpy(text, allowed_special="all") if text else np.zeros(0, np.uint32)

    def count(self, text: str) -> int:
        return len(self.ids(text))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a file, loaded once in each Python worker."""
    return Encoder(path)


_BREAK = re.compile(r"(?<=\S)[ \n]")


def leaves(text: str, leaf_chars: int) -> list[str]:
    """The text in stretches of leaf_chars characters or more, cut where a pre-token ends in any case."""
    out, at = [], 0
    while len(text) - at > leaf_chars:
        cut = _BREAK.search(text, at + leaf_chars)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


class SegmentTree:
    """Sums of characters and tokens over a text's leaves; node i has the children 2i and 2i + 1, leaves come last."""

    def __init__(self, parts: list[str], tokens: list[int]):
        self.parts = parts
        self.base = 1 << max(0, (len(parts) - 1).bit_length())
        self.chars, self.tokens = np.zeros((2, 2 * self.base), np.int64)
        self.chars[self.base : self.base + len(parts)] = [len(p) for p in parts]
        self.tokens[self.base : self.base + len(parts)] = tokens
        for sums in (self.chars, self.tokens):
            width = self.base
            while width > 1:
                sums[width // 2 : width] = sums[width : 2 * width].reshape(-1, 2).sum(1)
                width //= 2

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at this place (the last leaf for the end), and where it starts."""
        node, start = 1, 0
        while node < self.base:
            node *= 2
            if start + self.chars[node] <= at and self.chars[node + 1]:
                start += int(self.chars[node])
                node += 1
        return node - self.base, start

    def put(self, leaf: int, part: str, tokens: int) -> None:
        self.parts[leaf] = part
        node = leaf + self.base
        for sums, value in ((self.chars, len(part)), (self.tokens, tokens)):
            change, i = value - sums[node], node
            while i and change:
                sums[i] += change
                i //= 2

    def _touched(self, start: int, end: int) -> tuple[int, int, int]:
        """The first and last leaf that an edit of [start, end) bears on, and where the first one starts."""
        first, at = self.find(start)
        last, last_at = self.find(end)
        if start == at and first:
            first, at = self.find(at - 1)
        if end >= last_at + len(self.parts[last]) - 1 and last_at + len(self.parts[last]) < self.chars[1]:
            last, _ = self.find(last_at + len(self.parts[last]))
        return first, last, at

    def edit(self, edits: list[tuple[int, int, str]], enc: Encoder) -> int:
        """Replaces characters [start, end) by new ones, for each of some edits (in order, disjoint, all of the text
        as it is); returns the number of characters that were encoded again."""
        groups: list[list] = []  # first leaf, last leaf, start of the first, edits
        for e in edits:
            first, last, at = self._touched(e[0], e[1])
            if groups and first <= groups[-1][1]:
                groups[-1][1] = max(last, groups[-1][1])
                groups[-1][3].append(e)
            else:
                groups.append([first, last, at, [e]])
        encoded = 0
        for first, last, at, own in groups:
            old = "".join(self.parts[first : last + 1])
            pieces, upto = [], 0
            for start, end, new in own:
                pieces += [old[upto : start - at], new]
                upto = end - at
            part = "".join([*pieces, old[upto:]])
            self.put(first, part, enc.count(part))
            encoded += len(part)
            for leaf in range(first + 1, last + 1):
                if self.parts[leaf]:
                    self.put(leaf, "", 0)
        return encoded


TREE = "doc_id long, text string, edits array<struct<start:long,end:long,replacement:string>>, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long"
_EDIT = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("replacement", pa.string())])


def build_trees(docs: DataFrame, tokenizer: str, leaf_chars: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """TREE's columns for every row: the text with its leaves' sizes and token counts. Edits, if there are any, go along."""
    edits = F.col("edits") if "edits" in docs.columns else F.lit(None).cast("array<struct<start:long,end:long,replacement:string>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            chars, tokens = [], []
            for text in batch.column(1).to_pylist():
                parts = leaves(text or "", leaf_chars)
                chars.append([len(p) for p in parts])
                tokens.append([enc.count(p) for p in parts])
            sums = pa.array([sum(t) for t in tokens], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32())), sums],
                names=["doc_id", "text", "edits", "leaf_chars", "leaf_tokens", "n_tokens"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), edits.alias("edits")).mapInArrow(run, TREE)


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with the edits (doc_id, start, end, replacement) of each document, in their order."""
    by_doc = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("edits"))
    return docs.drop("edits").join(by_doc, "doc_id", "left")


EDITED = "doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens_before long, n_tokens long, n_edits long, n_ignored long, n_chars_encoded long"


def apply_edits(trees: DataFrame, tokenizer: str) -> DataFrame:
    """EDITED's columns for rows of TREE: the edited text with its tree, and how many characters were encoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text, before = r["text"] or "", r["n_tokens"]
                wanted = r["edits"] or []
                if not wanted:
                    rows.append((r["doc_id"], r["text"], r["leaf_chars"], r["leaf_tokens"], before, before, 0, 0, 0))
                    continue
                ends = np.cumsum(r["leaf_chars"])
                tree = SegmentTree([text[e - n : e] for e, n in zip(ends, r["leaf_chars"], strict=True)], r["leaf_tokens"])
                kept, upto = [], 0
                for e in wanted:
                    if e["start"] is not None and e["end"] is not None and upto <= e["start"] <= e["end"] <= len(text):
                        kept.append(e)
                        upto = e["end"]
                again = tree.edit([(e["start"], e["end"], e["replacement"] or "") for e in kept], enc)
                n = len(tree.parts)
                rows.append(
                    (
                        r["doc_id"],
                        "".join(tree.parts),
                        tree.chars[tree.base : tree.base + n].tolist(),
                        tree.tokens[tree.base : tree.base + n].tolist(),
                        before,
                        int(tree.tokens[1]),
                        len(kept),
                        len(wanted) - len(kept),
                        again,
                    )
                )
            types = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.int64()] * 5]
            columns = zip(*rows, strict=True) if rows else [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in EDITED.split(", ")])

    return trees.select("doc_id", "text", "edits", "leaf_chars", "leaf_tokens", "n_tokens").mapInArrow(run, EDITED)


def mask_edits(docs: DataFrame, patterns: list[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, edits: an edit for every match of the first pattern that starts at its place.

    A pattern should give up on a long run of characters once, not once for each place in it.
    """
    joined = "|".join(f"({p})" for p, _ in patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(joined)
        for batch in batches:
            edits = [
                [{"start": m.start(), "end": m.end(), "replacement": patterns[m.lastindex - 1][1]} for m in find.finditer(t or "")]
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(edits, pa.list_(_EDIT))], names=["doc_id", "text", "edits"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string, edits array<struct<start:long,end:long,replacement:string>>")
