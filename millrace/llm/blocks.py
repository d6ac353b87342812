"""Removal of repeated runs of words, found by fixed blocks and extended to maximal repeats.

A window is a run of ``width`` words. Every document is also a reference: its non-overlapping blocks of ``size``
words, at multiples of ``size``, are the index, and every rolling window of ``size`` words of every document is a probe.
size is such that a window of any document, however it lies, holds ``run`` whole blocks in a row. So of two equal
windows, the blocks in either one are met by probes in the other; and since the least of those blocks is enough, a
block is indexed, and a probe sent, only if its hash is the least of some ``run`` in a row at its own alignment
(with run=1, all are). Nothing that repeats is missed by that.

1. Tasks exchange the hashes of their probes, those that are blocks marked, each once per unit of a few million;
   ranges of hashes answer which of them are a block's and occur at two places or more: these are hits.
2. Texts with hits are written as a table, one of each group of whole copies, bucketed by digest.
3. Hits are extended: a window that holds no run of blocks with a hit can't repeat, all others are exchanged by 96 bits
   of hash (of words hashed to 128 bits each), once per unit, and ranges answer which of them occur again. Repeated
   windows that touch or overlap are one maximal repeat.
4. Spans are joined to the table of texts, which is already dealt by digest. Texts that several rows have are repeats
   as a whole, and need no windows of their own.

Every occurrence of a repeated window goes, the first included. No group of equal blocks is ever gathered, and no pairs
are made: what a range reads has one entry from each unit, however often a window occurs in it.

Defined results: words are runs of other characters than ASCII blanks, compared byte by byte; a null text has none; texts
of fewer words than a window stay; rows without an id, and rows that repeat an id, are documents of their own (so a
row repeated whole loses its text, if it has enough words); an empty table gives no rows. Other columns are ignored, or
kept whatever their names. Whole texts are read, in pieces of bounded size.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.batches import unused
from millrace.llm.repeats import merge_spans
from millrace.plans import scratch
from millrace.plans.scratch import shared_dir, write_table

#: Words worked out at once, bytes split at once, distinct words a task remembers, entries in a unit.
_WORDS, _PIECE, _VOCABULARY, _UNIT = 400_000, 4 << 20, 300_000, 1_500_000
#: Bytes of text whose entries a range takes on average.
_RANGE_BYTES = 64 << 20
_BLANK = re.compile(rb"[\t-\r ]")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NO_ID = 2**63 - 1


def block_size(width: int, run: int) -> int:
    """The most words that blocks may have if each window of ``width`` is to hold ``run`` whole ones in a row."""
    size = (width + 1) // (run + 1)
    if run < 1 or size < 1:
        raise ValueError("a window must hold whole blocks")
    return size


# -- words and windows


def split_words(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a few megabytes of it at a time."""
    at = 0
    while at < len(raw):
        cut = _BLANK.search(raw, at + _PIECE)
        end = cut.start() if cut else len(raw)
        yield raw[at:end].split()
        at = end


class WordHashes(dict):
    """128 bits of each word; forgets them when there are too many."""

    def __init__(self):
        self.digests: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.digests)
        self.digests.append(hashlib.blake2b(word, digest_size=16).digest())
        return n

    def look_up(self, words: list[bytes]) -> np.ndarray:
        if len(self) > _VOCABULARY:
            self.clear()
            self.digests.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.frombuffer(b"".join(self.digests), np.uint64).reshape(-1, 2)[at]


def hashed(texts: Iterator[str], cache: WordHashes) -> Iterator[np.ndarray]:
    """The words' hashes of each text, looked up for many texts at once."""
    waiting: list[bytes] = []
    sizes: list[int] = []

    def flush() -> Iterator[np.ndarray]:
        yield from np.split(cache.look_up(waiting), np.cumsum(sizes)[:-1]) if sizes else ()
        waiting.clear()
        sizes.clear()

    for text in texts:
        raw = text.encode("utf-8", "surrogatepass")
        if len(raw) > _PIECE:
            yield from flush()
            yield np.concatenate([np.zeros((0, 2), np.uint64), *(cache.look_up(words) for words in split_words(raw))])
            continue
        words = raw.split()
        waiting += words
        sizes.append(len(words))
        if len(waiting) >= _WORDS:
            yield from flush()
    yield from flush()


def rolled(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, put together from shorter ones (which may overlap)."""

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = (a * _M1) ^ (b * _M2)
        return out ^ (out >> np.uint64(31))

    size, out = 1, words ^ (words >> np.uint64(32))
    while 2 * size <= n:
        out = pair(out[:-size], out[size:])
        size *= 2
    return out if size == n else pair(out[: len(words) - n + 1], out[n - size :])


def _leasts(words: np.ndarray, size: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each rolling block, and the least of each ``run`` of blocks in a row."""
    blocks = rolled(words, size)
    n = len(words) - run * size + 1
    least = blocks[:n]
    for j in range(1, run):
        least = np.minimum(least, blocks[j * size : j * size + n])
    return blocks, least


def probes(words: np.ndarray, size: int, run: int, piece: int = _WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and hashes of the rolling blocks that are the least of some run, piece by piece."""
    around = (run - 1) * size
    for at in range(0, len(words) - size + 1, piece):
        low = max(0, at - around)
        part = words[low : at + piece + run * size]
        if len(part) < run * size:
            continue
        blocks, least = _leasts(part, size, run)
        chosen = np.zeros(len(blocks), bool)
        for j in range(run):
            chosen[j * size : j * size + len(least)] |= blocks[j * size : j * size + len(least)] == least
        places = np.flatnonzero(chosen[at - low : at - low + piece]) + (at - low)
        yield places + low, blocks[places]


def windows(words: np.ndarray, hits: np.ndarray, width: int, size: int, run: int, piece: int = _WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Starts and hashes (64 and 32 bits) of windows that hold a run of blocks whose least one is a hit (by place)."""
    for at in range(0, len(words) - width + 1, piece):
        part = words[at : at + piece + width - 1]
        blocks, least = _leasts(part[:, 0], size, run)
        hit = np.zeros(len(least), bool)
        for j in range(run):
            hit |= (blocks[j * size : j * size + len(least)] == least) & hits[at + j * size : at + j * size + len(least)]
        if not hit.any():
            continue
        before = np.concatenate(([0], np.cumsum(hit)))
        n = len(part) - width + 1
        starts = np.flatnonzero(before[size : size + n] > before[:n])  # the runs that begin in a window's first block's words
        yield at + starts, rolled(part[:, 0], width)[starts], (rolled(part[:, 1], width)[starts] >> np.uint64(32)).astype(np.uint32)


# -- exchanges: a unit sends each of its values once, to the range that the value is in

_SENT = "range int, unit long, is_unit boolean, high binary, low binary, flags binary, places binary, docs binary, keys binary"
_TYPES = [pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 6]
_NAMES = [x.split()[0] for x in _SENT.split(", ")]
_TWICE, _MARKED = 1, 2


def _groups(high: np.ndarray, low: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal values together, and where in it each value begins."""
    order = np.argsort(high)
    h = high[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if low is not None and ((low[order][1:] != low[order][:-1]) & ~new[1:]).any():  # equal in 64 bits, not in 96
        order = np.lexsort((low, high))
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    return order, np.flatnonzero(new)


def _spread(high: np.ndarray) -> np.ndarray:
    """Numbers from numbers, one to one, that are as dense anywhere (leasts are small), so that ranges are alike."""
    out = high * _M2
    out ^= out >> np.uint64(32)
    out *= _M1
    return out ^ (out >> np.uint64(29))


def _send(
    unit: int, ranges: int, docs: list[tuple[int, int, int]], keys: list[bytes], high: np.ndarray, low: np.ndarray | None = None, marked: np.ndarray | None = None, kept: bytes | None = None
) -> Iterator[pa.RecordBatch]:
    """The rows of a unit: its values by range, with flags and a place; and one of its own, with its documents (two numbers
    and how many values), the places of values that it has twice or more, which need no answer, and what else is to be kept."""
    high = _spread(high)
    order, starts = _groups(high, low)
    counts = np.diff(np.append(starts, len(high)))
    first = order[starts]
    flags = np.where(counts > 1, _TWICE, 0).astype(np.uint8)
    if marked is not None and len(starts):
        flags |= np.where(np.logical_or.reduceat(marked[order], starts), _MARKED, 0).astype(np.uint8)
    known = order[np.repeat(counts > 1, counts)].astype(np.uint32)
    cuts = np.searchsorted((high[first] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
    numbers = np.array(docs, np.int64).reshape(-1, 3)
    rows = [(unit % ranges, unit, True, kept, None, None, known.tobytes(), numbers.tobytes(), b"".join(keys))]
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        at = first[cuts[k] : cuts[k + 1]]
        rows.append((k, unit, False, high[at].tobytes(), None if low is None else low[at].tobytes(), flags[cuts[k] : cuts[k + 1]].tobytes(), at.astype(np.uint32).tobytes(), None, None))
    for i in range(0, len(rows), 2000):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 2000], strict=True), _TYPES, strict=True)], names=_NAMES)


def _answer(needs_mark: bool):
    """Keeps, of the rows of a range, the places of values that occur again (and are marked somewhere, if need be)."""

    def run(group: pa.Table) -> pa.Table:
        columns = {n: group.column(n).to_pylist() for n in ("is_unit", "high", "low", "flags", "places")}
        rows = [i for i, x in enumerate(columns["is_unit"]) if not x]
        places = columns["places"]
        if rows:
            high, flags = (np.concatenate([np.frombuffer(columns[n][i], t) for i in rows]) for n, t in (("high", np.uint64), ("flags", np.uint8)))
            low = None if columns["low"][rows[0]] is None else np.concatenate([np.frombuffer(columns["low"][i], np.uint32) for i in rows])
            order, starts = _groups(high, low)
            sizes = np.diff(np.append(starts, len(high)))
            again = (sizes > 1) | np.bitwise_or.reduceat(flags[order] & _TWICE, starts).astype(bool)
            if needs_mark:
                again &= np.bitwise_or.reduceat(flags[order] & _MARKED, starts).astype(bool)
            found = np.zeros(len(high), bool)
            found[order] = np.repeat(again, sizes)
            found &= (flags & _TWICE) == 0
            at = 0
            for i in rows:
                mine = np.frombuffer(places[i], np.uint32)
                places[i] = mine[found[at : at + len(mine)]].tobytes()
                at += len(mine)
        none, own = pa.nulls(len(group), pa.binary()), pa.array([h if x else None for x, h in zip(columns["is_unit"], columns["high"], strict=True)], pa.binary())
        kept = [group.column(n) for n in ("range", "unit", "is_unit")]
        return pa.table([*kept, own, none, none, pa.array(places, pa.binary()), group.column("docs"), group.column("keys")], names=_NAMES)

    return run


def _flags_of_unit(group: pa.Table) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Of each document of a unit: its numbers and key, and which of its values are found."""
    at = group.column("is_unit").to_pylist().index(True)
    docs = np.frombuffer(group.column("docs")[at].as_py(), np.int64).reshape(-1, 3)
    keys, ends = group.column("keys")[at].as_py(), np.cumsum(docs[:, 2])
    flags = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
    for x in group.column("places").to_pylist():
        flags[np.frombuffer(x, np.uint32)] = True
    for i, ((a, b, n), end) in enumerate(zip(docs.tolist(), ends.tolist(), strict=True)):
        yield a, b, keys[32 * i : 32 * i + 32], flags[end - n : end]


def _exchange_probes(width: int, size: int, run_: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, cache = TaskContext.get().partitionId() << 32, WordHashes()
        seen: dict[bytes, list] = {}
        places, hashes, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            marks = np.concatenate(places) % size == 0
            yield from _send(unit, ranges, [tuple(d) for d in seen.values()], list(seen), np.concatenate(hashes), marked=marks)
            seen.clear()
            places.clear()
            hashes.clear()

        for batch in batches:
            orders, digests, texts = (c.to_pylist() for c in batch.columns)
            for o, digest, words in zip(orders, digests, hashed(texts, cache), strict=True):
                if len(words) < width:
                    continue
                if digest in seen:
                    doc = seen[digest]
                    doc[0], doc[1] = min(doc[0], o), doc[1] + 1
                    continue
                n = 0
                for p, h in probes(words[:, 0], size, run_):
                    places.append(p)
                    hashes.append(h)
                    n += len(p)
                seen[digest] = [o, 1, n]
                held += n
                if held >= _UNIT:
                    yield from flush()
                    unit, held = unit + 1, 0
        if seen:
            yield from flush()

    return run


def _masks(group: pa.Table) -> pa.Table:
    rows = [(key, o, n, np.packbits(flags).tobytes() if flags.any() else None) for o, n, key, flags in _flags_of_unit(group)]
    columns = zip(*rows, strict=True) if rows else [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["digest", "ord", "n", "mask"])


def _hit_places(words: np.ndarray, mask: bytes, size: int, run: int) -> np.ndarray:
    """For each place of a text, whether a probe there is a hit."""
    out, bits, at = np.zeros(len(words), bool), np.unpackbits(np.frombuffer(mask, np.uint8)).astype(bool), 0
    for places, _ in probes(words[:, 0], size, run):
        out[places] = bits[at : at + len(places)]
        at += len(places)
    return out


def _stretches(numbers: np.ndarray) -> np.ndarray:
    """Rising numbers as stretches (first, how many)."""
    first = np.flatnonzero(np.diff(numbers, prepend=-2) != 1)
    return np.stack((numbers[first], np.diff(np.append(first, len(numbers)))), axis=1)


def _exchange_windows(width: int, size: int, run_: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, cache = TaskContext.get().partitionId() << 32, WordHashes()
        docs, keys, high, low, kept, held = [], [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            yield from _send(unit, ranges, docs, keys, np.concatenate(high), np.concatenate(low), kept=b"".join(kept))
            for x in (docs, keys, high, low, kept):
                x.clear()

        for batch in batches:
            digests, texts, masks = (c.to_pylist() for c in batch.columns)
            for digest, mask, words in zip(digests, masks, hashed(texts, cache), strict=True):
                found = list(windows(words, _hit_places(words, mask, size, run_), width, size, run_))
                if not found:
                    continue
                starts, h, rest = (np.concatenate(x) for x in zip(*found, strict=True))
                stretches = _stretches(starts)
                docs.append((len(stretches), 0, len(starts)))
                for x, y in ((keys, digest), (high, h), (low, rest), (kept, stretches.tobytes())):
                    x.append(y)
                held += len(starts)
                if held >= _UNIT:
                    yield from flush()
                    unit, held = unit + 1, 0
        if held:
            yield from flush()

    return run


def _repeated_spans(width: int):
    """The spans of words that each text of a unit shares with others, of texts that have some."""

    def run(group: pa.Table) -> pa.Table:
        at = group.column("is_unit").to_pylist().index(True)
        stretches, rows = np.frombuffer(group.column("high")[at].as_py(), np.int64).reshape(-1, 2), []
        at = 0
        for n, _, key, flags in _flags_of_unit(group):
            mine = stretches[at : at + n]
            at += n
            if flags.any():
                ends = np.cumsum(mine[:, 1])
                starts = (np.arange(ends[-1]) + np.repeat(mine[:, 0] - ends + mine[:, 1], mine[:, 1]))[flags]
                rows.append((key, merge_spans(np.stack((starts, starts + width), axis=1)).tobytes()))
        columns = zip(*rows, strict=True) if rows else [()] * 2
        return pa.table([pa.array(c, pa.binary()) for c in columns], names=["digest", "spans"])

    return run


# -- the operator


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ident = F.col(id_col).cast("long")
    return docs.select(ident.alias("doc_id"), F.coalesce(ident, F.lit(_NO_ID)).alias("ord"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words the spans of a text take, and the others."""
    for batch in batches:
        removed, kept = [], []
        for text, blob in zip(*(batch.column(x).to_pylist() for x in ("text", "spans")), strict=True):
            spans, left, at = np.frombuffer(blob, np.int64).reshape(-1, 2), [], 0
            for words in split_words(text.encode("utf-8", "surrogatepass")):
                edges = np.clip(np.concatenate(([0], spans.ravel() - at, [len(words)])), 0, len(words)).tolist()
                for a, b in zip(edges[::2], edges[1::2], strict=True):
                    left += words[a:b]
                at += len(words)
            removed.append(int((spans[:, 1] - spans[:, 0]).sum()))
            kept.append(b" ".join(left))
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("digest", "ord", "spans")), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["digest", "ord", "spans", "n_removed", "kept"])


def find_repeats(docs: DataFrame, width: int = 35, run: int = 3, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts that lose words to others (digest, ord, spans, n_removed, kept), and texts that several rows have (digest, n).

    digest is the text's SHA-256 and ord the least id it has; spans: disjoint [start, end) pairs of word numbers as
    64-bit numbers; kept: the other words, joined by blanks. Texts are of ``width`` words or more.
    """
    spark, size = docs.sparkSession, block_size(width, run)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    ranges = max(2 * parts, total // _RANGE_BYTES)
    long_ones = _keyed(docs, id_col, text_col).filter(F.octet_length("text") >= 2 * width - 1).select("ord", "digest", "text")

    def exchange(rows: DataFrame, send: Callable, needs_mark: bool, receive: Callable, schema: str) -> DataFrame:
        answers = rows.mapInArrow(send, _SENT).groupBy("range").applyInArrow(_answer(needs_mark), _SENT)
        return answers.groupBy("unit").applyInArrow(receive, schema)

    masks = exchange(long_ones, _exchange_probes(width, size, run, ranges), True, _masks, "digest binary, ord long, n long, mask binary")
    by_text = masks.groupBy("digest").agg(F.min(F.struct("ord", "mask")).alias("first"), F.sum("n").alias("n"))
    firsts = write_table(by_text.select("digest", "n", "first.ord", "first.mask").filter("n > 1 or mask is not null"), "firsts")
    # the same row may be there several times
    joined = long_ones.join(firsts.filter("mask is not null").drop("n"), ["digest", "ord"]).dropDuplicates(["digest", "ord"])
    name = f"millrace_blocks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/millrace/{name}"
    joined.write.option("compression", "zstd").option("path", path).bucketBy(parts, "digest").saveAsTable(name)
    scratch.remember(path)
    texts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, and are what texts reads; the catalog keeps no entry
    found = exchange(texts.select("digest", "text", "mask"), _exchange_windows(width, size, run, ranges), False, _repeated_spans(width), "digest binary, spans binary")
    lost = texts.select("digest", "ord", "text").join(found, "digest").mapInArrow(_cut, "digest binary, ord long, spans binary, n_removed long, kept binary")
    return lost, firsts.filter("n > 1").select("digest", "n")


def _with_copies(rows: DataFrame, copies: DataFrame, max_broadcast: int) -> DataFrame:
    """rows with ``copies``, the number of rows that a text of theirs has; broadcast if those texts are few."""
    few = F.broadcast(copies) if copies.limit(max_broadcast + 1).count() <= max_broadcast else copies
    return rows.join(few.withColumnRenamed("n", "copies"), "digest", "left")


def blocks_digest(docs: DataFrame, width: int = 35, run: int = 3, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = 100_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row.

    max_broadcast bounds the digests (32 bytes each) in a broadcast; beyond it the same join shuffles.
    """
    lost, copies = find_repeats(docs, width, run, id_col, text_col)
    lost = lost.select("digest", "ord", F.col("n_removed").alias("removed_here"), F.sha2("kept", 256).alias("sha_here"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, shas = [], []
            for text in batch.column("text").to_pylist():
                n, sha = 0, hashlib.sha256()
                for words in split_words(text.encode("utf-8", "surrogatepass")):
                    if words:
                        sha.update((b" " if n else b"") + b" ".join(words))
                        n += len(words)
                n_words.append(n)
                shas.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n_words, pa.int64()), pa.array(shas)], names=["doc_id", "ord", "digest", "n_words", "sha"])

    rows = _keyed(docs, id_col, text_col).mapInArrow(count, "doc_id long, ord long, digest binary, n_words long, sha string")
    rows = _with_copies(rows, copies, max_broadcast).join(lost, ["digest", "ord"], "left")
    return rows.select(
        "doc_id",
        "n_words",
        F.when(F.col("copies") > 1, F.col("n_words")).otherwise(F.coalesce("removed_here", F.lit(0))).alias("n_removed"),
        F.when(F.col("copies") > 1, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha_here", "sha")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, width: int = 35, run: int = 3, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = 100_000) -> DataFrame:
    """docs with repeated words cut from their texts (what is left of a text that loses some is joined by blanks).

    Documents that lose all their words are dropped; all other rows and columns stay.
    """
    lost, copies = find_repeats(docs, width, run, id_col, text_col)
    row, digest, order, kept = unused(docs.columns, "row", "digest", "ord", "kept")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = docs.select(F.struct("*").alias(row), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("ord"))
    rows = _with_copies(marked, copies, max_broadcast).filter("copies is null")
    rows = rows.join(lost.select("digest", "ord", F.decode("kept", "utf-8").alias(kept)), ["digest", "ord"], "left").filter(F.col(kept).isNull() | (F.col(kept) != ""))
    return rows.select(*(F.coalesce(kept, F.col(f"{row}.`{c}`")).alias(c) if c == text_col else F.col(f"{row}.`{c}`") for c in docs.columns))
