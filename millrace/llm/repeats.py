"""Removal of repeated byte strings, by merging sorted runs of suffixes.

A byte goes if a string of ``length`` bytes covers it that also starts earlier: in a document with a smaller id,
or further to the front of the same one. Sorting every suffix of a corpus isn't needed for that. Each string of
``length`` bytes holds an anchor, its 32 bytes of least hash, and equal strings hold equal anchors at the same
place; one position in about thirty is an anchor. So:

1. Whole copies of a text are found by digest; only the first goes on.
2. Hashes of anchors are exchanged; anchors that occur once in the corpus can't be part of a repeat and are
   dropped. The texts with the others are written as a table, bucketed by document.
3. The suffix at each such anchor, as far as the strings that hold it reach, is sorted within its task together
   with the others, equal ones are reduced to the first, and the run is exchanged front-coded, cut at splitters.
4. Each range merges its runs by a loser tree that keeps the length of the common prefix with the last winner:
   what is known to be equal is never compared again. Equal suffixes mark what they reach, all but the first.
   Different suffixes with one anchor are compared string by string, within the range.
5. An anchor so common that splitters fall among its suffixes is in several ranges: their first strings meet in
   one more exchange.
6. Marks are joined to the table of texts, which is already dealt by document.

Defined results: a null text is empty; rows without an id come last; repeated rows of one id and text are one
document, and are cut alike; texts under ``length`` bytes stay as they are; an empty table gives no rows. Other
columns are ignored, or kept whatever their names. Long texts are read in pieces of bounded size, and nothing
grows with how often a string occurs but the number of its marks. Ranges of hashes and of suffixes are as many
as the data ask for, so what a task holds doesn't grow with the corpus.
"""

from __future__ import annotations

import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans import scratch
from millrace.plans.scratch import shared_dir, write_table

ANCHOR = 32
_PIECE = 1 << 20
_RUN = 150_000
#: Bytes of text whose anchors a range of hashes takes on average, and suffixes in a range, at most; keys of the
#: sample that ranges are cut by: for each range, and in all.
_HASH_BYTES, _RANGE, _SAMPLE, _MOST_SAMPLE = 32 << 20, 250_000, 100, 1_000_000
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_NO_ID = 2**63 - 1


def anchor_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes at each place, put together from halves."""
    h, n = raw.astype(np.uint64), 1
    while n < 8:
        h = h[:-n] | (h[n:] << np.uint64(8 * n))
        n *= 2
    with np.errstate(over="ignore"):
        while n < ANCHOR:
            h = (h[:-n] * _M1) ^ (h[n:] * _M2)
            h ^= h >> np.uint64(29)
            n *= 2
        h *= _M3
    return h ^ (h >> np.uint64(32))


def _slide(values: np.ndarray, width: int, f) -> np.ndarray:
    """f over each stretch of ``width`` values, by doubling."""
    n, out = 1, values
    while 2 * n <= width:
        out = f(out[:-n], out[n:])
        n *= 2
    return out if n == width else f(out[: len(values) - width + 1], out[width - n :])


def anchors(raw: bytes, length: int, piece: int = _PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece of a text: places of anchors, their hashes, and the first and last start of strings they are of."""
    width = length - ANCHOR + 1
    for at in range(0, max(0, len(raw) - length + 1), piece):
        h = anchor_hashes(np.frombuffer(raw[at : at + piece + length - 1], np.uint8))
        least = _slide(h, width, np.minimum)  # of the string at each place
        edge = np.zeros(width - 1, np.uint64)
        padded = np.concatenate((edge, least, edge))
        places = np.flatnonzero(h == _slide(padded, width, np.maximum))
        mine = np.lib.stride_tricks.sliding_window_view(padded, width)[places] == h[places][:, None]
        first = places - width + 1 + mine.argmax(1)
        last = places - mine[:, ::-1].argmax(1)
        # places before the piece's first string are padding; a hash of 0 would match it
        yield at + places, h[places], at + np.maximum(first, 0), at + np.minimum(last, len(least) - 1)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ident = F.col(id_col).cast("long")
    return docs.select(
        ident.alias("doc_id"), F.coalesce(ident, F.lit(_NO_ID)).alias("ord"), F.xxhash64(text).alias("th"), F.unhex(F.md5(text)).alias("digest"), text.alias("text")
    )


# -- anchors that occur more than once


def _exchange_anchors(length: int, buckets: int):
    """Per batch: a row for each bucket with the distinct anchors' hashes, and one with the batch's documents.

    An anchor that repeats within the batch is known to repeat: the batch keeps its places and sends one
    entry, so that no bucket gets more than an entry of it from each batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            me = (part << 32) + number
            firsts: dict[bytes, int] = {}
            docs, hashes = [], []
            ords, ths, digests, texts = (c.to_pylist() for c in batch.columns)
            for i, (o, digest) in enumerate(zip(ords, digests, strict=True)):
                if o < ords[firsts.setdefault(digest, i)]:
                    firsts[digest] = i
            for i, (o, th, digest, text) in enumerate(zip(ords, ths, digests, texts, strict=True)):
                if firsts[digest] == i:
                    found = [h for _, h, _, _ in anchors(text.encode("utf-8", "surrogatepass"), length)]
                    docs.append((o, th, sum(map(len, found)), digest))
                    hashes += found
            h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            values, place, which, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            known = np.flatnonzero(n[which] > 1).astype(np.uint32)
            bucket = (values >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            values, place, multi = values[order], place[order].astype(np.uint32), n[order] > 1
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            out = [
                (b, values[i:j].tobytes(), multi[i:j].tobytes(), place[i:j].tobytes())
                for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False))
                if j > i
            ]
            numbers = np.array([d[:3] for d in docs], np.int64).tobytes()
            out.append((number % buckets, numbers, b"".join(d[3] for d in docs), known.tobytes()))
            kinds = pa.array([False] * (len(out) - 1) + [True])
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array([me] * len(out), pa.int64()), kinds, *(pa.array(c, pa.binary()) for c in columns[1:])],
                names=["bucket", "batch", "is_batch", "a", "b", "places"],
            )

    return run


_ANCHORS = "bucket int, batch long, is_batch boolean, a binary, b binary, places binary"


def _repeated_in_bucket(group: pa.Table) -> pa.Table:
    """Keeps, of the rows of a bucket, the places of anchors that more than one batch has, or that a batch has twice."""
    is_batch = group.column("is_batch").to_pylist()
    a, b, places = (group.column(x).to_pylist() for x in ("a", "b", "places"))
    rows = [i for i, x in enumerate(is_batch) if not x]
    values = [np.frombuffer(a[i], np.uint64) for i in rows]
    multi = [np.frombuffer(b[i], bool) for i in rows]
    if rows:
        _, which = np.unique(np.concatenate(values), return_inverse=True)
        again = np.bincount(which, 1 + np.concatenate(multi)) > 1
        again = np.split(again[which], np.cumsum([len(v) for v in values])[:-1])
        for i, flags, own in zip(rows, again, multi, strict=True):
            places[i] = np.frombuffer(places[i], np.uint32)[flags & ~own].tobytes()
            a[i] = b[i] = None
    return pa.table([group.column("bucket"), group.column("batch"), group.column("is_batch"), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(places, pa.binary())], names=group.schema.names)


def _batch_masks(group: pa.Table) -> pa.Table:
    """For each document of a batch, a bit for each of its anchors: whether that one repeats."""
    is_batch = group.column("is_batch").to_pylist()
    a, b = group.column("a").to_pylist(), group.column("b").to_pylist()
    at = is_batch.index(True)
    docs = np.frombuffer(a[at], np.int64).reshape(-1, 3)
    ends = np.cumsum(docs[:, 2])
    flags = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
    for x in group.column("places").to_pylist():
        flags[np.frombuffer(x, np.uint32)] = True
    masks = [np.packbits(flags[e - n : e]).tobytes() if flags[e - n : e].any() else None for e, n in zip(ends, docs[:, 2], strict=True)]
    hits = [int(flags[e - n : e].sum()) for e, n in zip(ends, docs[:, 2], strict=True)]
    digests = [b[at][16 * i : 16 * i + 16] for i in range(len(docs))]
    columns = [pa.array(docs[:, 0]), pa.array(docs[:, 1]), pa.array(digests, pa.binary()), pa.array(masks, pa.binary()), pa.array(hits, pa.int64())]
    return pa.table(columns, names=["ord", "th", "digest", "mask", "hits"])


# -- sorted runs of suffixes


def _suffixes(text: str, mask: bytes, length: int) -> Iterator[tuple[bytes, int, int]]:
    """(key, first start, number of strings) at the repeated anchors of a text.

    A key is what follows from the anchor on, as far as strings with that anchor reach; then what stands before
    the anchor; then how much that is. Equal keys are equal in all of it.
    """
    raw = text.encode("utf-8", "surrogatepass")
    at, flags = 0, np.unpackbits(np.frombuffer(mask, np.uint8)).astype(bool)
    for places, _, first, last in anchors(raw, length):
        mine = flags[at : at + len(places)]
        at += len(places)
        for p, a, b in zip(places[mine].tolist(), first[mine].tolist(), last[mine].tolist(), strict=True):
            yield raw[p : b + length] + raw[a:p] + bytes((p - a,)), a, b - a + 1


def common_prefixes(keys: list[bytes]) -> list[int]:
    """How many bytes each key shares with the one before it."""
    out = [0] * len(keys)
    for i in range(1, len(keys)):
        a, b = keys[i - 1], keys[i]
        n = min(len(a), len(b))
        if a[:8] != b[:8]:
            n = min(n, 8)
        lo = 0
        while lo < n:  # the longest equal prefix, by halves
            mid = (lo + n + 1) // 2
            if a[lo:mid] == b[lo:mid]:
                lo = mid
            else:
                n = mid - 1
        out[i] = lo
    return out


def _pack_marks(marks: dict[tuple[int, int], list[tuple[int, int]]]) -> tuple[list, list, list]:
    """Documents, and their marks as sorted, disjoint pairs of 64-bit numbers."""
    ords, ths, blobs = [], [], []
    for (o, th), pairs in marks.items():
        ords.append(o)
        ths.append(th)
        blobs.append(merge_spans(np.array(pairs, np.int64)).tobytes())
    return ords, ths, blobs


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Disjoint spans in order, of any spans (start, end)."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    ends = np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)
    return np.stack((spans[new, 0], reach[ends]), axis=1)


_RUNS = "part int, n int, shared binary, sizes binary, bytes binary, docs binary, strings binary, ord long, th long, spans binary"


def _front_coded(keys: list[bytes], records: list[tuple], part: int) -> tuple:
    shared = common_prefixes(keys)
    tails = [k[n:] for k, n in zip(keys, shared, strict=True)]
    return (
        part,
        len(keys),
        np.array(shared, np.uint16).tobytes(),
        np.array([len(t) for t in tails], np.uint16).tobytes(),
        b"".join(tails),
        np.array([r[:2] for r in records], np.int64).tobytes(),
        np.array([r[2:] for r in records], np.int64).tobytes(),
        None,
        None,
        None,
    )


def decode_run(n: int, shared: bytes, sizes: bytes, tails: bytes, docs: bytes, strings: bytes) -> Iterator[tuple]:
    """(key, bytes shared with the one before, (ord, th, first start, number of strings)) of a front-coded run."""
    key, at = b"", 0
    rows = np.concatenate((np.frombuffer(docs, np.int64).reshape(n, 2), np.frombuffer(strings, np.int64).reshape(n, 2)), axis=1).tolist()
    for m, size, row in zip(np.frombuffer(shared, np.uint16).tolist(), np.frombuffer(sizes, np.uint16).tolist(), rows, strict=True):
        key = key[:m] + tails[at : at + size]
        at += size
        yield key, m, row


def _runs(length: int, splitters: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            found.sort()
            keys, records, marks = [], [], {}
            for key, *record in found:
                if keys and keys[-1] == key:  # the first stays, as records sort by document and place
                    marks.setdefault((record[0], record[1]), []).append((record[2], record[2] + record[3] - 1 + length))
                else:
                    keys.append(key)
                    records.append(record)
            found.clear()
            cuts = [0, *(bisect.bisect_left(keys, s) for s in splitters), len(keys)]
            rows = [_front_coded(keys[i:j], records[i:j], k) for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
            for n, (o, th, spans) in enumerate(zip(*_pack_marks(marks), strict=True)):
                rows.append((n % (len(splitters) + 1), 0, None, None, None, None, None, o, th, spans))
            if rows:
                types = [pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.int64(), pa.int64(), pa.binary()]
                for i in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows[i : i + 2000], strict=True), types, strict=True)],
                        names=[x.split()[0] for x in _RUNS.split(", ")],
                    )

        for batch in batches:
            for o, th, text, mask in zip(*(batch.column(x).to_pylist() for x in ("ord", "th", "text", "mask")), strict=True):
                found.extend((key, o, th, a, n) for key, a, n in _suffixes(text, mask, length))
                if len(found) >= _RUN:
                    yield from flush()
        yield from flush()

    return run


class LoserTree:
    """Merges sorted front-coded runs; yields (key, bytes shared with the key before it, record).

    Each run's head carries the length of its common prefix with the last key that left the tree. The head with
    the longer one is the smaller key; only heads with equal ones are compared, from that place on.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.heads: list = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.shared = [0] * self.size
        self.losers = [0] * self.size

    def _less(self, i: int, j: int) -> bool:
        """Whether run i's head goes before run j's; the loser's shared prefix becomes the one with the winner."""
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return b is None
        m, n = self.shared[i], self.shared[j]
        if m != n:
            return m > n
        x, y = a[0], b[0]
        if x[m:] == y[m:]:
            self.shared[i if a[2] > b[2] else j] = len(x)
            return a[2] <= b[2]
        lo, hi = m, min(len(x), len(y))
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if x[lo:mid] == y[lo:mid]:
                lo = mid
            else:
                hi = mid - 1
        if x[lo:] < y[lo:]:
            self.shared[j] = lo
            return True
        self.shared[i] = lo
        return False

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        i, j = self._build(2 * node), self._build(2 * node + 1)
        won = i if self._less(i, j) else j
        self.losers[node] = j if won == i else i
        return won

    def __iter__(self) -> Iterator[tuple]:
        won = self._build(1)
        while (head := self.heads[won]) is not None:
            yield head[0], self.shared[won], head[2]
            self.heads[won] = new = next(self.runs[won], None)
            if new is not None:
                self.shared[won] = new[1]  # with the key that just left, which was this run's last
            node = (won + self.size) // 2
            while node:
                other = self.losers[node]
                if self._less(other, won):
                    self.losers[node], won = won, other
                node //= 2


_FOUND = "ord long, th long, spans binary, string binary, start long"


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _merge_range(length: int, splitters: list[bytes]):
    """Marks of the strings in a range that start earlier elsewhere in it; the first strings that other ranges may have.

    A key shares no more with any key of another range than with the splitter between them, so a string can
    be in another range only if what it takes of the suffix is within that.
    """
    common = {s[:ANCHOR] for s in splitters if len(s) > ANCHOR}

    def run(group: pa.Table) -> pa.Table:
        marks: dict[tuple[int, int], list[tuple[int, int]]] = {}
        open_rows: list[tuple] = []
        rows = group.to_pylist()
        part = rows[0]["part"]
        borders = splitters[max(0, part - 1) : part + 1]
        runs = [decode_run(r["n"], r["shared"], r["sizes"], r["bytes"], r["docs"], r["strings"]) for r in rows if r["n"]]

        def resolve(members: list[tuple[bytes, list]]) -> None:
            """members: different keys with one anchor, each with its first record."""
            shared_anchor = members[0][0][:ANCHOR] in common
            if len(members) < 2 and not shared_anchor:
                return
            first: dict[bytes, tuple] = {}
            reach: set[bytes] = set()
            for key, (o, th, start, n) in members:
                before = key[-1]
                whole = key[len(key) - 1 - before : -1] + key[: len(key) - 1 - before]
                if shared_anchor:
                    beyond = max(_shared(key, s) for s in borders)
                    reach.update(whole[k : k + length] for k in range(n) if length - before + k <= beyond)
                for k in range(n):
                    string, mine = whole[k : k + length], (o, th, start + k)
                    old = first.setdefault(string, mine)
                    if old != mine:
                        if mine < old:
                            first[string], old = mine, old
                        else:
                            old = mine
                        marks.setdefault(old[:2], []).append((old[2], old[2] + length))
            open_rows.extend((*first[string][:2], string, first[string][2]) for string in reach)

        members: list[tuple[bytes, list]] = []
        for key, shared, record in LoserTree(runs):
            if members and shared == len(key) == len(members[-1][0]):
                least = members[-1][1]
                if record < least:
                    members[-1] = (key, record)
                    record, least = least, record
                marks.setdefault((record[0], record[1]), []).append((record[2], record[2] + record[3] - 1 + length))
                continue
            if members and shared < ANCHOR:
                resolve(members)
                members = []
            members.append((key, record))
        if members:
            resolve(members)
        ords, ths, blobs = _pack_marks(marks)
        for r in rows:
            if not r["n"]:
                ords.append(r["ord"])
                ths.append(r["th"])
                blobs.append(r["spans"])
        none = [None] * len(ords)
        a, b, strings, starts = zip(*open_rows, strict=True) if open_rows else ((),) * 4
        return pa.table(
            [
                pa.array([*ords, *a], pa.int64()),
                pa.array([*ths, *b], pa.int64()),
                pa.array([*blobs, *[None] * len(a)], pa.binary()),
                pa.array([*none, *strings], pa.binary()),
                pa.array([*none, *starts], pa.int64()),
            ],
            names=["ord", "th", "spans", "string", "start"],
        )

    return run


def _splitters(texts: DataFrame, length: int, parts: int) -> list[bytes]:
    """Keys that cut the suffixes into ranges of like size, from a sample of them. They decide nothing but sizes.

    The sample has _SAMPLE keys for each range, of about half as many documents, and no more than _MOST_SAMPLE.
    """
    docs, hits = texts.agg(F.count("*"), F.sum("hits")).first()
    ranges = max(2 * parts, (hits or 0) // _RANGE)
    docs_share = min(1.0, 0.5 * _SAMPLE * ranges / max(1, docs))
    keys_share = min(1.0, min(_SAMPLE * ranges, _MOST_SAMPLE) / max(1.0, docs_share * (hits or 0)))
    limit = int(keys_share * (1 << 32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [k[:64] for t, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, _, _ in _suffixes(t, m, length) if zlib.crc32(k) <= limit]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary())], names=["key"])

    sample = texts.filter(F.pmod(F.xxhash64("th"), F.lit(1 << 20)) < int(docs_share * (1 << 20)) + 1).select("text", "mask").mapInArrow(run, "key binary")
    keys = sorted(sample.toArrow().column("key").to_pylist())
    cuts = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
    # the suffixes of an anchor stay together, unless they are enough for ranges of their own
    return sorted({c if cuts[i - 1][:ANCHOR] == c[:ANCHOR] and i else c[:ANCHOR] for i, c in enumerate(cuts)})


def find_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ord, th, spans, kept, kept_text for each different document that loses bytes, but for whole copies.

    ord and th are the document's place in the order and its text's hash; spans: disjoint [start, end) pairs
    of 64-bit numbers; kept: the bytes outside of them; kept_text: the whole characters among those, as UTF-8.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(docs, id_col, text_col)
    long_ones = keyed.filter(F.octet_length("text") >= length)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = max(4 * parts, size // _HASH_BYTES)
    sent = long_ones.select("ord", "th", "digest", "text").mapInArrow(_exchange_anchors(length, buckets), _ANCHORS)
    answers = sent.groupBy("bucket").applyInArrow(_repeated_in_bucket, _ANCHORS)
    masks = answers.groupBy("batch").applyInArrow(_batch_masks, "ord long, th long, digest binary, mask binary, hits long")
    firsts = masks.groupBy("digest").agg(F.min(F.struct("ord", "th", "mask", "hits")).alias("first")).select("first.*").filter("mask is not null")
    # the same document may have come in several batches
    joined = long_ones.select("ord", "th", "text").join(firsts, ["ord", "th"]).dropDuplicates(["ord", "th"])
    name = f"millrace_repeats_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/millrace/{name}"
    joined.write.option("compression", "zstd").option("path", path).bucketBy(parts, "ord", "th").saveAsTable(name)
    scratch.remember(path)
    texts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, and are what texts reads; the catalog keeps no entry
    splitters = _splitters(texts, length, parts)
    runs = texts.select("ord", "th", "text", "mask").mapInArrow(_runs(length, splitters), _RUNS)
    merged = write_table(runs.groupBy("part").applyInArrow(_merge_range(length, splitters), _FOUND), "marks")
    strings = merged.filter("string is not null").select("string", F.struct("ord", "th", "start").alias("at"))
    firsts_of = strings.groupBy("string").agg(F.min("at").alias("first"))
    later = strings.join(firsts_of, "string").filter("at != first").groupBy("at.ord", "at.th").agg(F.collect_list("at.start").alias("starts"))
    spans = merged.filter("spans is not null").groupBy("ord", "th").agg(F.collect_list("spans").alias("spans"))
    found = texts.select("ord", "th", "text").join(spans, ["ord", "th"], "left").join(later, ["ord", "th"], "left").filter("spans is not null or starts is not null")
    return found.mapInArrow(_cut(length), "ord long, th long, spans binary, kept binary, kept_text binary")


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_spans, kept = [], []
            for text, blobs, starts in zip(*(batch.column(x).to_pylist() for x in ("text", "spans", "starts")), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                pairs = [np.frombuffer(b, np.int64).reshape(-1, 2) for b in blobs or ()]
                if starts:
                    pairs.append(np.stack((np.array(starts, np.int64), np.array(starts, np.int64) + length), axis=1))
                spans = merge_spans(np.concatenate(pairs))
                edges = [0, *spans.ravel().tolist(), len(raw)]
                all_spans.append(spans.tobytes())
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            whole = [x.decode("utf-8", "ignore").encode() for x in kept]
            yield pa.RecordBatch.from_arrays(
                [batch.column("ord"), batch.column("th"), *(pa.array(x, pa.binary()) for x in (all_spans, kept, whole))],
                names=["ord", "th", "spans", "kept", "kept_text"],
            )

    return run


def _copies(keyed: DataFrame, length: int, max_broadcast: int) -> DataFrame:
    """digest and first_ord of texts of length bytes or more that several rows have, with a hint to broadcast if they are few."""
    several = keyed.filter(F.col("n_bytes") >= length).groupBy("digest").agg(F.min("ord").alias("first_ord"), F.count("*").alias("rows"))
    found = write_table(several.filter("rows > 1").drop("rows"), "copies")
    return F.broadcast(found) if found.count() <= max_broadcast else found


def repeats_digest(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = 500_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row.

    max_broadcast bounds the digests (24 bytes each) in a broadcast; beyond it the same join shuffles.
    """
    found = find_repeats(docs, length, id_col, text_col)
    lost = found.select(
        "ord",
        "th",
        (F.octet_length("spans") / 16).cast("long").alias("spans_here"),
        F.octet_length("kept").cast("long").alias("kept_bytes"),
        F.sha2("kept", 256).alias("sha_here"),
    )
    keyed = _keyed(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    copies = _copies(keyed, length, max_broadcast)
    # short texts are nobody's copies; a key of their own keeps the many empty ones apart
    key = F.when(F.col("n_bytes") >= length, F.col("digest")).otherwise(F.col("ord").cast("string").cast("binary"))
    keyed = keyed.select("doc_id", "ord", "th", key.alias("digest"), "n_bytes", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    rows = keyed.join(copies, "digest", "left").join(lost, ["ord", "th"], "left")
    copy = F.col("ord") > F.col("first_ord")
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce(F.col("n_bytes") - F.col("kept_bytes"), F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("spans_here", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha_here", "sha")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = 500_000) -> DataFrame:
    """docs with the repeated bytes cut from their texts; a character that loses some of its bytes goes too.

    Documents that lose their whole text are dropped; all other rows and columns stay.
    """
    found = find_repeats(docs, length, id_col, text_col).select("ord", "th", F.decode("kept_text", "utf-8").alias("kept"))
    copies = _copies(_keyed(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text")), length, max_broadcast)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    key = F.when(F.octet_length(text) >= length, F.unhex(F.md5(text))).otherwise(order.cast("string").cast("binary"))
    marked = docs.select(F.struct("*").alias("row"), order.alias("ord"), F.xxhash64(text).alias("th"), key.alias("digest"))
    rows = marked.join(copies, "digest", "left").filter("first_ord is null or ord = first_ord")
    rows = rows.join(found, ["ord", "th"], "left").filter("kept is null or kept != ''")
    return rows.select(*(F.coalesce("kept", F.col(f"row.`{c}`")).alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))
