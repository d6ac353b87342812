"""Benchmark decontamination.

The n-grams of a benchmark are normalised into a hash set that every task receives; each document's
tokens are scanned once, window by window, and hits are verified word by word. The set is never
broadcast unchecked: a benchmark is dealt into blocks of at most ``block_chars`` characters, each block is
scanned in a pass of its own, and the hits of all passes are merged by text. A pass reads nothing but texts, and
writes a row for each distinct text with hits (its digest, spans and items) before the next block is read, so one
block at a time is in the driver and in the tasks; a Python worker keeps the set from one task to the next. The
pass over the last block returns the documents, joined with the hits of the passes before it.

Defined results: a null text has no words; a document without words is never contaminated; items
without words match nothing; equal items are all reported; words of an item without an id are hit, but no item is
reported; an empty benchmark reports nothing; rows that repeat a doc_id are judged one by one. Whole texts are
scanned, however long. Other columns of either table are ignored, or kept whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import unused
from millrace.plans.scratch import write_table

#: Upper- to lower-case ASCII, ASCII letters and digits kept, all other ASCII to spaces.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """ASCII-lower-cased runs of letters, digits and non-ASCII characters, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class NgramSet:
    """The windows of some benchmark items: word ids, a hash set by window length, and the exact windows."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int):
        self.ids: dict[bytes, int] = {}
        windows: dict[int, dict[bytes, set[int]]] = {}
        for item, text in items:
            ids = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            n = min(width, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                key = np.array(ids[i : i + n], np.int32).tobytes()
                windows.setdefault(n, {}).setdefault(key, set()).update(() if item is None else (item,))
        self.windows = {n: {k: tuple(v) for k, v in w.items()} for n, w in windows.items()}
        self.hashes = {
            n: np.unique(_hashes(np.frombuffer(b"".join(w), np.int32), n)[::n]) for n, w in self.windows.items()
        }

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are inside a window of the set, and the items whose windows occur."""
        found: set[int] = set()
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        hit = np.zeros(len(words) + 1, np.int32)
        for n, exact in self.windows.items():
            if len(words) < n:
                continue
            starts = np.flatnonzero(known[n:] - known[:-n] == n)  # windows of known words only
            if not len(starts):
                continue
            hashes = _hashes(ids, n)[starts]
            at = np.minimum(np.searchsorted(self.hashes[n], hashes), len(self.hashes[n]) - 1)
            for start in starts[self.hashes[n][at] == hashes]:
                if (items := exact.get(ids[start : start + n].tobytes())) is not None:  # verified word by word
                    found.update(items)
                    hit[start] += 1
                    hit[start + n] -= 1
        return np.cumsum(hit[:-1]) > 0, found


def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each window of n ids."""
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for k in range(n):
        out = (out ^ ids[k : k + len(out)].astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list]:
    """Items in blocks of at most block_chars characters each; a longer item is a block of its own."""
    block, size = [], 0
    for row in benchmark.select(item_col, text_col).toLocalIterator():
        n = 1 + len(row[1] or "")
        if block and size + n > block_chars:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    if block:
        yield block


#: The set that a Python worker has built last, under its block's key.
_built: dict[str, NgramSet] = {}


def _set_of(key: str, shared) -> NgramSet:
    if key not in _built:
        _built.clear()
        _built[key] = NgramSet(*shared.value)
    return _built[key]


#: Bytes of hits of earlier blocks that are broadcast; more are joined by a shuffle.
_BROADCAST_BYTES = 8_000_000
_SPANS = "array<struct<start:long,end:long>>"


def _mark(docs: DataFrame, marks: tuple[str, str, str], benchmark: DataFrame, width: int, block_chars: int, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """docs with three more columns: number of words, spans of hit words, items found."""
    context = docs.sparkSession.sparkContext
    earlier, held = [], []
    for block in _blocks(benchmark, item_col, item_text_col, block_chars):
        if held:
            shared = context.broadcast((held, width))
            earlier.append(_hits(docs.select(F.col(text_col).alias("text")), shared))
            shared.destroy()
        held = block
    rows = _with_hits(docs, text_col, marks, earlier) if earlier else _unmarked(docs, marks)
    return _scan(rows, text_col, marks, uuid.uuid4().hex if held else "", context.broadcast((held, width)))


def _unmarked(docs: DataFrame, marks: tuple[str, str, str]) -> DataFrame:
    types = ("long", _SPANS, "array<long>")
    return docs.select("*", *[F.lit(None).cast(t).alias(m) for m, t in zip(marks, types, strict=True)])


def _digest(text):
    return F.unhex(F.sha2(text.cast("string"), 256))


def _hits(texts: DataFrame, shared) -> DataFrame:
    """digest, spans, items of the distinct texts (one column) that a block hits, written."""
    marks = ("n_words", "spans", "items")
    found = _scan(_unmarked(texts, marks), "text", marks, uuid.uuid4().hex, shared).filter(F.size("spans") > 0)
    return write_table(found.select(_digest(F.col("text")).alias("digest"), "spans", "items").dropDuplicates(["digest"]), "hits")


def _with_hits(docs: DataFrame, text_col: str, marks: tuple[str, str, str], earlier: list[DataFrame]) -> DataFrame:
    """docs with marks that hold what earlier passes found: a text's rows, one from each block at most, put together."""
    hits = reduce(DataFrame.unionByName, earlier).groupBy("digest").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )
    hits = write_table(hits, "hits")
    size = hits.agg(F.sum(64 + 16 * F.size("spans") + 8 * F.size("items"))).first()[0] or 0
    packed = docs.select(F.struct("*").alias("row"), _digest(F.col(text_col)).alias("key"))
    joined = packed.join(F.broadcast(hits) if size <= _BROADCAST_BYTES else hits, F.col("key") == F.col("digest"), "left")
    return joined.select("row.*", F.lit(None).cast("long").alias(marks[0]), F.col("spans").alias(marks[1]), F.col("items").alias(marks[2]))


def _scan(docs: DataFrame, text_col: str, marks: tuple[str, str, str], key: str, shared) -> DataFrame:
    schema = docs.schema
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _set_of(key, shared)
        for batch in batches:
            texts, old_spans, old_items = (batch.column(x).to_pylist() for x in (text_col, *marks[1:]))
            n_words, spans, items = [], [], []
            for text, before, had in zip(texts, old_spans, old_items, strict=True):
                words = words_of(text)
                hit, found = grams.scan(words)
                for s in before or ():
                    hit[s["start"] : s["end"]] = True
                edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
                n_words.append(len(words))
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                items.append(sorted(found.union(had or ())))
            new = [pa.array(n_words, pa.int64()), pa.array(spans, spans_type), pa.array(items, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *new], names=schema.names)

    return docs.mapInArrow(run, schema)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 13,
    block_chars: int = 8_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """doc_id, text, n_words, spans (runs of hit words, [start, end)) and items (found, sorted) for every row.

    The benchmark passes through the driver one block of block_chars at a time, which bounds both the
    driver's memory and what is sent to the tasks; each further block reads the texts once more.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _mark(rows, ("n_words", "spans", "items"), benchmark, width, block_chars, "text", item_col, item_text_col)


def _n_hit(spans: str):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 13,
    block_chars: int = 8_000_000,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """docs without those of which a twentieth of the words or more is inside of windows of the benchmark."""
    marks = unused(docs.columns, "n_words", "spans", "items")
    found = _mark(docs, marks, benchmark, width, block_chars, text_col, item_col, item_text_col)
    n_hit = _n_hit(marks[1])
    return found.filter(~((n_hit > 0) & (20 * n_hit >= F.col(marks[0])))).drop(*marks)


def contamination_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of find_contamination()'s rows."""
    n_hit = _n_hit("spans")
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def remove_spans(found: DataFrame) -> DataFrame:
    """doc_id and text without the hit words (what stands between two removed words goes too)."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_without(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    return found.select("doc_id", cut("text", "spans").alias("text"))


def _without(text: str | None, spans) -> str | None:
    if text is None or spans is None or not len(spans):
        return text
    raw = text.encode("utf-8", "surrogatepass")
    folded = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], folded, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    kept, at = [], 0
    for s in spans:
        kept.append(raw[at : starts[s["start"]]])
        at = ends[s["end"] - 1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def items_sha256(items: list[int]) -> str:
    """The digest of a list of items, as contamination_digest() has it."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


#: find_contamination() and contamination_digest() of documents and benchmark, windows of 13 words.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1 : i + n], ' ') AS g FROM (SELECT *, unnest(range(len(w) - n + 1)) AS i FROM bn)),
dg AS (
  SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS g FROM (
    SELECT doc_id, w, n, unnest(range(greatest(0, len(w) - n + 1))) AS i FROM d, (SELECT DISTINCT n FROM bg))),
m AS (SELECT doc_id, i, n, item_id FROM dg JOIN bg USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
