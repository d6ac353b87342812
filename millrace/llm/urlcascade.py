"""URL filters by a cascade of Bloom filters.

The keys that decide about a URL are pairs of a host suffix and a path prefix. Level one of a cascade encodes
the listed keys; level two the keys of the corpus that pass level one without being listed; level three the
listed keys that pass level two; and so on until no key errs. As the levels cover every key that occurs in the
corpus, membership is exact for each of them, and no URL takes part in a join. All levels together are
broadcast, which ``max_bytes`` bounds: where they would be larger, membership is found by a join on the keys.

Defined results: a null URL, or one without ``://``, has an empty host and path and keys that no rule can name;
repeated URLs are judged one by one; an empty table gives an empty result. Other columns are ignored. URLs may be of
any length: of a host's suffixes, only those with as many labels as some listed key has are looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.scratch import write_table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (ASCII-lower-cased) and path of a URL; both are empty if it has no ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.regexp_extract(url, _PARTS, 2)


def url_keys(host: Column, path: Column, path_lengths: list[int], most_labels: int | None = None) -> Column:
    """Keys of a URL: each host suffix with each of the path's prefixes of these lengths, the longest first,
    then (if 0 is among the lengths) the bare suffixes, the longest first. Suffixes have most_labels labels at most.

    A key is suffix and prefix in one string. A path that isn't empty starts with ``/``, and a host has none,
    so a key can be read in one way only.
    """
    labels = F.split(host, "\\.")
    if most_labels is not None:
        labels = F.slice(labels, -F.least(F.size(labels), F.lit(max(1, most_labels))), F.size(labels))
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    lengths = F.filter(F.array(*[F.lit(n) for n in path_lengths if n]).cast("array<int>"), lambda n: n <= F.length(path))
    ruled = F.flatten(F.transform(suffixes, lambda s: F.transform(lengths, lambda n: F.concat(s, F.substring(path, F.lit(1), n)))))
    longest = lambda keys: F.array_sort(keys, lambda a, b: F.length(b) - F.length(a))
    return F.concat(longest(ruled), longest(suffixes)) if 0 in path_lengths else longest(ruled)


class Cascade:
    """Bit sets and their number of hash functions, level by level. Keys are given as two 64-bit hashes."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, int]] = []

    def n_bytes(self) -> int:
        return sum(bits.nbytes for bits, _ in self.levels)

    def passes(self, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        bits, hashes = self.levels[level]
        ok = np.ones(len(h1), bool)
        for at in positions(h1, h2, level, hashes, 8 * len(bits)):
            ok &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return ok

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """A key is listed if the first level that it fails is an even one (counted from 1), or it passes an odd number."""
        passed, alive = np.zeros(len(h1), np.int64), np.ones(len(h1), bool)
        for level in range(len(self.levels)):
            alive &= self.passes(level, h1, h2)
            passed += alive
        return passed % 2 == 1


def positions(h1: np.ndarray, h2: np.ndarray, level: int, hashes: int, n_bits: int) -> Iterator[np.ndarray]:
    for k in range(hashes):
        with np.errstate(over="ignore"):
            x = h1 + np.uint64(level * 64 + k + 1) * (h2 | np.uint64(1))
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        yield (x ^ (x >> np.uint64(29))) % np.uint64(n_bits)


def hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def _level(keys: DataFrame, n: int, level: int, error: float) -> tuple[np.ndarray, int]:
    """The bit set of these keys; tasks send set bytes only, merged by position before they reach the driver."""
    n_bits = max(64, int(n * -1.4427 * np.log2(error)) // 64 * 64 + 64)
    hashes = max(1, round(-np.log2(error)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns)
            at = np.unique(np.concatenate([*positions(h1, h2, level, hashes, n_bits)])) if len(h1) else np.empty(0, np.uint64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            first = np.flatnonzero(np.concatenate(([True], np.diff(word) > 0)))[: len(at)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(word[first]), pa.array(np.bitwise_or.reduceat(bit, first).view(np.int64) if len(at) else word)],
                names=["word", "bits"],
            )

    words = np.zeros(n_bits // 64, np.uint64)
    merged = keys.select("h1", "h2").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    for row in merged.toLocalIterator():
        words[row[0]] = np.uint64(row[1] & 0xFFFFFFFFFFFFFFFF)
    return words.view(np.uint8), hashes


def build_cascade(universe: DataFrame, max_bytes: int = 64 << 20, error: float = 0.02) -> Cascade | None:
    """A cascade exact on all rows of ``universe`` (key, listed), or None if it would exceed max_bytes.

    The key universe is read once for each level; a level holds about ``error`` of the level two before.
    """
    cascade = Cascade()
    rest = write_table(universe.select("listed", *hashed(F.col("key"))).distinct(), "keys")
    listed = True
    while n := rest.filter(F.col("listed") == listed).count():
        if cascade.n_bytes() + n * -1.4427 * np.log2(error) / 8 > max_bytes:
            return None
        cascade.levels.append(_level(rest.filter(F.col("listed") == listed), n, len(cascade.levels), error))
        level, shared = len(cascade.levels) - 1, rest.sparkSession.sparkContext.broadcast(cascade)

        def passing(batches, shared=shared, level=level):
            for batch in batches:
                h1, h2 = (batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (1, 2))
                yield batch.filter(pa.array(shared.value.passes(level, h1, h2)))

        passed = rest.filter(F.col("listed") != listed).mapInArrow(passing, rest.schema)
        rest = write_table(passed.unionByName(rest.filter(F.col("listed") == listed)), "keys")
        listed = not listed
    return cascade


def member_keys(urls: DataFrame, listed: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """``urls`` (id, keys) with ``member``: the first of a row's keys that is among ``listed`` (key), else null.

    Uses a cascade over the keys of all rows; or a join, if that would exceed max_bytes.
    """
    keys = urls.select(F.explode("keys").alias("key")).distinct()
    universe = keys.join(listed.select("key", F.lit(True).alias("listed")).distinct(), "key", "left").fillna(False, ["listed"])
    universe = write_table(universe, "universe")
    cascade = build_cascade(universe, max_bytes)
    if cascade is None:
        pairs = urls.select("id", F.posexplode("keys").alias("at", "key")).join(universe.filter("listed"), "key")
        best = pairs.groupBy("id").agg(F.min_by("key", "at").alias("member"))
        return urls.join(best, "id", "left")
    shared = urls.sparkSession.sparkContext.broadcast(cascade)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = batch.column("h1"), batch.column("h2")
            flat = [h.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for h in (h1, h2)]
            inside = shared.value.contains(*flat)
            sizes = h1.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(sizes)))
            hits = np.flatnonzero(inside)
            first = np.searchsorted(hits, starts[:-1])
            at = hits[np.minimum(first, len(hits) - 1)] if len(hits) else np.full(len(sizes), -1)
            ok = (first < len(hits)) & (at < starts[1:]) & (at >= starts[:-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(np.where(ok, at - starts[:-1] + 1, 0).astype(np.int32))], names=[*batch.schema.names[:-2], "at"]
            )

    with_hashes = urls.select(
        "*",
        F.transform("keys", lambda k: hashed(k)[0]).alias("h1"),
        F.transform("keys", lambda k: hashed(k)[1]).alias("h2"),
    )
    out = with_hashes.mapInArrow(run, T.StructType([*urls.schema, T.StructField("at", T.IntegerType())]))
    return out.withColumn("member", F.when(F.col("at") > 0, F.element_at("keys", F.col("at").cast("int")))).drop("at")


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    listed: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    max_bytes: int = 64 << 20,
) -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    rules: (allow or block, host and path prefix in one string) - a handful, given with the call. The longest
    rule that fits decides. Where none does, the block list does: the hosts in ``listed`` (host), in lower case, of
    any number, with all their subdomains. Null and empty ones are ignored.
    """
    spark = pages.sparkSession
    lengths = sorted({len(r) - r.index("/") for _, r in rules} | {0})
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    blocked = listed.filter("host != ''").select(F.col("host").alias("key"))
    labels = max([blocked.agg(F.max(F.size(F.split("key", "\\.")))).first()[0] or 1, *(r[: r.index("/")].count(".") + 1 for _, r in rules)])
    urls = parts.withColumn("keys", url_keys(F.col("host"), F.col("path"), lengths, labels)).withColumnRenamed("page_id", "id")
    ruled = spark.createDataFrame([(r,) for _, r in rules], "key string")
    found = member_keys(urls, ruled.unionByName(blocked).distinct(), max_bytes)
    # a rule has a path, a listed host has none
    listed_host = F.when(~F.contains("member", F.lit("/")), F.col("member"))
    rule = F.when(F.contains("member", F.lit("/")), F.col("member"))
    action = F.create_map(*[F.lit(x) for a, r in rules for x in (r, a)])
    return found.select(F.col("id").alias("page_id"), "host", "path", rule.alias("rule"), listed_host.alias("listed_host")).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.when(F.col("rule").isNotNull(), F.element_at(action, F.col("rule")))
        .otherwise(F.when(F.col("listed_host").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
        .alias("verdict"),
        "listed_host",
    )
