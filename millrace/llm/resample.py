"""Importance resampling towards a target: documents drawn in proportion to how like the target's their n-grams are.

1. Counting. Runs of one to three words are hashed into buckets, in the corpus and in the target; each task keeps
   one array of counts.
2. Scoring. A bucket's gain (how much commoner it is in the target, in thousandths of a natural logarithm) stands in
   an array; a document's weight is the sum of its features' gains, and its score adds Gumbel noise drawn from its id,
   so that the highest scores are a draw without replacement in proportion to the weights.
3. Runs. The task that scores documents sorts those that are long enough into runs by falling score, and writes them,
   in pieces. Runs are at most ``run_rows`` long; they are files in the shared folder, not memory.
4. Drawing. Regularly spaced keys of the runs give splitters; exact counts between the splitters say in which range
   the draw ends. Only pieces before that point are exchanged. Each range merges its runs by a tournament tree that
   opens a piece when its first key is due, gives ranks from the range's place on, and stops after the last draw; what
   then is left comes out without a rank.

The hash is CRC-32, which is linear: the checksum of a run of words is put together from checksums of its words, which
are worked out once per distinct word, by tables for bytes appended. That is exact, and done for a whole batch at once.

Defined results: a null text has no words, its weight is 0; a row without an id is scored by the noise of an empty
one, and comes last among equal scores; ties go to the smaller id, and rows that are equal in both are drawn in the
order in which they were written; each row that repeats an id is drawn for itself. An empty corpus gives no rows; an
empty target still gives gains (those of the smoothed counts). Other columns are ignored, whatever their names. Whole
texts are read, in pieces of bounded size.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.decontam import _FOLD
from millrace.plans.scratch import write_table

#: Words that are hashed at once, characters that are split into words at once, and distinct words that a task remembers.
_WORDS, _PIECE, _VOCABULARY = 400_000, 4 << 20, 500_000
#: Rows in a piece of a run, keys that the driver sees, and rows in a range at most.
_ROWS, _KEYS, _RANGE = 1024, 100_000, 100_000
_LAST = 2**63 - 1


# -- features


@lru_cache(maxsize=None)
def _append_tables(power: int) -> np.ndarray:
    """For each byte of a checksum and each of its values: what 2^power zero bytes behind the text make of it."""
    if power == 0:
        zero = zlib.crc32(b"\0")
        return np.array([[zlib.crc32(b"\0", v << (8 * j)) ^ zero for v in range(256)] for j in range(4)], np.uint32)
    half = _append_tables(power - 1)
    return _through(half, _through(half, np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]))


def _through(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def append_crc(crc: np.ndarray, more: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Checksums of texts with others appended, from the checksums of both and the sizes of the latter in bytes."""
    out = crc.copy()
    for power in range(int(sizes.max()).bit_length() if len(sizes) else 0):
        at = np.flatnonzero(sizes >> power & 1)
        out[at] = _through(_append_tables(power), out[at])
    return out ^ more


class Vocabulary(dict):
    """Numbers of words; checksums of each word, of it behind a blank, and the size of that."""

    def __init__(self):
        self.rows: list[tuple[int, int, int]] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.rows)
        self.rows.append((zlib.crc32(word), zlib.crc32(b" " + word), len(word) + 1))
        return n

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """The three figures of each word, as rows of an array."""
        if len(self) > _VOCABULARY:
            self.clear()
            self.rows.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.array(self.rows, np.int64).reshape(-1, 3)[at].T


def features(texts: list[str | None], buckets: int, vocabulary: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For stretches of a batch: the text that each word is of, and the texts and buckets of the features that end in the stretch."""
    words: list[bytes] = []
    owners: list[tuple[int, int]] = []  # (text, how many of the words)
    kept = np.zeros((3, 0), np.int64), np.zeros(0, np.int64)  # the last two words of the stretch before

    def flush():
        nonlocal kept
        own = np.repeat([o for o, _ in owners], [n for _, n in owners]).astype(np.int64)
        found = vocabulary.look_up(words)
        old = len(kept[1])
        (crc, tail, size), owner = np.concatenate((kept[0], found), axis=1), np.concatenate((kept[1], own))
        kept = np.stack((crc, tail, size))[:, -2:], owner[-2:]
        crc, tail = crc.astype(np.uint32), tail.astype(np.uint32)
        hashes, owns = [crc[old:]], [owner[old:]]
        run = crc
        for width in (2, 3):
            last = np.arange(max(old, width - 1), len(crc))  # words at which a run of that width may end
            last = last[owner[last] == owner[last - width + 1]]
            longer = np.zeros(len(crc), np.uint32)
            inside = np.arange(width - 1, len(crc)) if width < 3 else last
            longer[inside] = append_crc(run[inside - 1], tail[inside], size[inside])
            run = longer
            hashes.append(run[last])
            owns.append(owner[last])
        words.clear()
        owners.clear()
        return own, np.concatenate(owns), (np.concatenate(hashes) % np.uint32(buckets)).astype(np.int64)

    for i, text in enumerate(texts):
        raw, at = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD), 0
        while at < len(raw):
            end = raw.find(b" ", at + _PIECE)  # whole words
            end = len(raw) if end < 0 else end
            new = raw[at:end].split()
            at = end
            words += new
            owners.append((i, len(new)))
            if len(words) >= _WORDS:
                yield flush()
    if words:
        yield flush()


def feature_counts(texts: DataFrame, buckets: int = 10_000, text_col: str = "text") -> DataFrame:
    """bucket, n: how many features of all texts are in each bucket that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, vocabulary = np.zeros(buckets, np.int64), Vocabulary()
        for batch in batches:
            for _, _, found in features(batch.column(0).to_pylist(), buckets, vocabulary):
                counts += np.bincount(found, minlength=buckets)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(counts[full])], names=["bucket", "n"])

    return texts.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: the logarithm of its smoothed frequency in the target over that in the corpus, in thousandths, down."""
    n, all_s, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = lambda s, t: (float(t + 1) * float(all_s + n)) / (float(s + 1) * float(all_t + n))
    return np.array([math.floor(1000 * math.log(ratio(int(s), int(t)))) for s, t in zip(corpus, target, strict=True)], np.int64)


def _counted(texts: DataFrame, buckets: int, text_col: str) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for row in feature_counts(texts, buckets, text_col).toLocalIterator():  # a row for each bucket at most
        out[row["bucket"]] = row["n"]
    return out


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, down, from an id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


# -- sorted runs

_RUNS = "run long, start int, eligible boolean, doc_id array<long>, n_features array<long>, weight array<long>, score array<long>"
_TYPES = [pa.int64(), pa.int32(), pa.bool_(), *[pa.list_(pa.int64())] * 4]
_NAMES = [x.split()[0] for x in _RUNS.split(", ")]


def _order(doc_id: int | None) -> int:
    return _LAST if doc_id is None else doc_id


def _scored_runs(gain: np.ndarray, seed: int, min_words: int, run_rows: int):
    """Rows (doc_id, n_features, weight, score) of a task in pieces: of sorted runs, or of documents that are too short."""

    def pieces(rows: list[tuple], run: int | None) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(rows), _ROWS):
            columns = [[list(c)] for c in zip(*rows[start : start + _ROWS], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[run], [start], [run is not None], *columns], _TYPES, strict=True)], names=_NAMES)
        rows.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, vocabulary = TaskContext.get().partitionId() << 32, Vocabulary()
        long_ones: list[tuple] = []
        short_ones: list[tuple] = []
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            n_words, n_features, weight = (np.zeros(len(ids), np.int64) for _ in range(3))
            for words, owners, found in features(texts, len(gain), vocabulary):
                n_words += np.bincount(words, minlength=len(ids))
                n_features += np.bincount(owners, minlength=len(ids))
                weight += np.bincount(owners, weights=gain[found], minlength=len(ids)).astype(np.int64)  # whole numbers below 2^53
            for i, n, f, w in zip(ids, n_words.tolist(), n_features.tolist(), weight.tolist(), strict=True):
                (long_ones if n >= min_words else short_ones).append((i, f, w, w + noise(i, seed)))
            if len(short_ones) >= run_rows:
                yield from pieces(short_ones, None)
            if len(long_ones) >= run_rows:
                long_ones.sort(key=lambda r: (-r[3], _order(r[0])))
                yield from pieces(long_ones, number)
                number += 1
        long_ones.sort(key=lambda r: (-r[3], _order(r[0])))
        yield from pieces(long_ones, number)
        yield from pieces(short_ones, None)

    return run


def _keys(run: int, start: int, ids: list, scores: list) -> list[tuple[int, int, int, int]]:
    """What a piece's rows are sorted by, ties and repeated rows included."""
    return [(-s, _order(i), run, start + k) for k, (i, s) in enumerate(zip(ids, scores, strict=True))]


def _splitters(runs: DataFrame, total: int, ranges: int, wanted: int) -> list[tuple]:
    """Keys that cut what is wanted into ``ranges`` of like size, and the rest as coarsely as its size allows.

    From every n-th key of each run, at most _KEYS in all and one for each run. They decide sizes, not results.
    """
    every = max(1, total // _KEYS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for number, start, ids, scores in zip(*(batch.column(x).to_pylist() for x in ("run", "start", "doc_id", "score")), strict=True):
                first = -(start + zlib.crc32(b"%d" % number)) % every
                found += _keys(number, start, ids, scores)[first::every]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 4, names=["a", "b", "c", "d"])

    keys = sorted(zip(*(c.to_pylist() for c in runs.mapInArrow(run, "a long, b long, c long, d long").toArrow().columns), strict=True))
    share = len(keys) * wanted / max(1, total)
    cuts = [int(share * i / ranges) for i in range(1, ranges)]
    cuts += range(int(share + 0.01 * len(keys)) + 1, len(keys), max(1, int(share / ranges), len(keys) // (20 * ranges)))
    return sorted({keys[c] for c in cuts if 0 < c < len(keys)})


def _cut(keys: list[tuple], splitters: list[tuple]) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of the sorted keys of a piece."""
    at, part = 0, bisect.bisect_right(splitters, keys[0])
    while at < len(keys):
        end = len(keys) if part == len(splitters) else bisect.bisect_left(keys, splitters[part], at)
        if end > at:
            yield part, at, end
        at, part = end, part + 1


def _range_sizes(runs: DataFrame, splitters: list[tuple]) -> list[int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(splitters) + 1, np.int64)
        for batch in batches:
            for number, start, ids, scores in zip(*(batch.column(x).to_pylist() for x in ("run", "start", "doc_id", "score")), strict=True):
                for part, i, j in _cut(_keys(number, start, ids, scores), splitters):
                    counts[part] += j - i
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(counts[full])], names=["part", "n"])

    out = [0] * (len(splitters) + 1)
    for row in runs.mapInArrow(run, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["part"]] = row["n"]
    return out


# -- the draw

_PIECES = "part int, first_score long, first_order long, run long, start int, doc_id array<long>, n_features array<long>, weight array<long>, score array<long>"
_ROWS_OUT = "doc_id long, n_features long, weight long, score long, rank long"


class TournamentTree:
    """Merges sorted runs that come in pieces; a run's next piece may be added while its others are being read.

    Leaves hold the key that is next in each run, nodes the leaf that wins below. A run whose pieces are used up
    holds None, which loses to any key, until another piece is added.
    """

    def __init__(self):
        self.size, self.leaves, self.winners = 1, [None], [0, 0]
        self.pieces: list[deque] = [deque()]
        self.of_run: dict[int, int] = {}

    def _better(self, i: int, j: int) -> int:
        a, b = self.leaves[i], self.leaves[j]
        return i if b is None or (a is not None and a <= b) else j

    def _replay(self, leaf: int) -> None:
        node = (leaf + self.size) // 2
        while node:
            left = 2 * node
            pair = (left - self.size, left + 1 - self.size) if left >= self.size else (self.winners[left], self.winners[left + 1])
            self.winners[node] = self._better(*pair)
            node //= 2

    def add(self, run: int, keys: list[tuple], rows: list[tuple]) -> None:
        leaf = self.of_run.setdefault(run, len(self.of_run))
        if leaf == self.size:
            self.size *= 2
            self.leaves += [None] * (self.size - leaf)
            self.pieces += [deque() for _ in range(self.size - leaf)]
            self.winners = [0] * (2 * self.size)
            for i in range(0, self.size, 2):
                self._replay(i)
        self.pieces[leaf].append((iter(zip(keys[1:], rows[1:], strict=True)), keys[0], rows[0]))
        if self.leaves[leaf] is None:
            self._open(leaf)

    def _open(self, leaf: int) -> None:
        self.leaves[leaf] = self.pieces[leaf][0][1] if self.pieces[leaf] else None
        self._replay(leaf)

    def peek(self) -> tuple | None:
        """The least key of all runs."""
        return self.leaves[self.winners[1] if self.size > 1 else 0]

    def pop(self) -> tuple:
        """The row of the least key."""
        leaf = self.winners[1] if self.size > 1 else 0
        rest, _, row = self.pieces[leaf].popleft()
        following = next(rest, None)
        if following is not None:
            self.pieces[leaf].appendleft((rest, *following))
        self._open(leaf)
        return row


def _merge(offsets: list[int], wanted: int):
    """Ranks of ranges whose pieces come sorted by their first keys."""

    def full(rows: list[tuple], least: int = 10_000) -> Iterator[pa.RecordBatch]:
        if len(rows) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "n_features", "weight", "score", "rank"])
            rows.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, rank, done = None, TournamentTree(), 0, []
        for batch in batches:
            for p, s, o, number, start, *columns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = list(zip(*columns, strict=True))
                while (key := tree.peek()) is not None and (p != part or (rank < wanted and key < (s, o, number, start))):
                    rank += 1
                    done.append((*tree.pop(), rank if rank <= wanted else None))
                    yield from full(done)
                if p != part:
                    part, tree, rank = p, TournamentTree(), offsets[p]
                if rank >= wanted:  # the draw is complete: no key needs another comparison
                    done.extend((*r, None) for r in rows)
                    yield from full(done)
                else:
                    tree.add(number, _keys(number, start, columns[0], columns[3]), rows)
        while tree.peek() is not None:
            rank += 1
            done.append((*tree.pop(), rank if rank <= wanted else None))
            yield from full(done)
        yield from full(done, 1)

    return run


def _pieces(splitters: list[tuple], last: int):
    """The parts of a run's piece that fall in ranges up to the last that is needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for number, start, *columns in zip(*(batch.column(x).to_pylist() for x in ("run", "start", "doc_id", "n_features", "weight", "score")), strict=True):
                keys = _keys(number, start, columns[0], columns[3])
                for part, i, j in _cut(keys, splitters):
                    if part <= last:
                        found.append((part, *keys[i][:2], number, start + i, *(c[i:j] for c in columns)))
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 4]
            names = [x.split()[0] for x in _PIECES.split(", ")]
            columns = zip(*found, strict=True) if found else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def _undrawn(splitters: list[tuple], last: int):
    """The rows behind the last range that is needed, and those of documents that are too short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, start, eligible, *columns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = 0
                if eligible:
                    keys = _keys(number, start, columns[0], columns[3])
                    at = bisect.bisect_left(keys, splitters[last]) if last < len(splitters) else len(keys)
                rows += zip(*(c[at:] for c in columns), strict=True)
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.nulls(len(rows), pa.int64())], names=["doc_id", "n_features", "weight", "score", "rank"])

    return run


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 5,
    min_words: int = 20,
    seed: int = 42,
    buckets: int = 10_000,
    run_rows: int = 200_000,
    range_rows: int = _RANGE,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every row.

    Of the documents with min_words words or more, percent are drawn, fractions down, highest scores first.
    """
    spark = docs.sparkSession
    gain = gains(_counted(docs, buckets, text_col), _counted(target, buckets, target_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    runs = write_table(rows.mapInArrow(_scored_runs(gain, seed, min_words, run_rows), _RUNS), "runs")
    return draw(spark, runs, percent, range_rows)


def draw(spark: SparkSession, runs: DataFrame, percent: int, range_rows: int) -> DataFrame:
    """The rows of written runs with their ranks."""
    eligible = runs.filter("eligible")
    total = eligible.agg(F.sum(F.size("score"))).first()[0] or 0
    wanted = percent * total // 100
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, wanted // range_rows, min(parts, wanted // 256))
    splitters = _splitters(eligible, total, ranges, wanted) if wanted else []
    sizes = _range_sizes(eligible, splitters) if splitters else [total]
    offsets = [0, *np.cumsum(sizes).tolist()]
    last = bisect.bisect_left(offsets, wanted) - 1  # the range in which the draw ends
    if wanted == 0:
        return runs.mapInArrow(_undrawn([(-_LAST, 0, 0, 0)], 0), _ROWS_OUT)
    pieces = eligible.mapInArrow(_pieces(splitters, last), _PIECES)
    dealt = pieces.repartition(last + 1, "part").sortWithinPartitions("part", "first_score", "first_order", "run", "start")
    return dealt.mapInArrow(_merge(offsets, wanted), _ROWS_OUT).unionByName(runs.mapInArrow(_undrawn(splitters, last), _ROWS_OUT))
