"""Self-join of texts on the Jaccard similarity of their word n-grams, and the groups that its links form.

A text is the set of its distinct shingles (64-bit hashes). Sets that are equal are one class. Shingles are put
in one global order, rare ones first, by exact document frequency over all texts, then by hash. Two sets that
are similar enough share a shingle among the first few of both (their prefixes), so classes meet in one bucket
per prefix shingle that several texts have. Pairs there are tried by length, by the place of the shingle in both
sets, by 256 bits of each set (whether the shingles that fall on a bit are odd in number: where bits differ, so do
the sets), then by how many shingles both prefixes must have in common; pairs that remain are verified once each, on whole sets,
first by the suffix filter and then exactly.

Frequencies come from one exchange: each batch of texts sends its shingles, packed and sorted, to ranges of
hashes; a range answers which of them other texts have too, and how many. A prefix takes its places from those
answers; shingles that no other text has fill its front, and needn't be listed, as no pair shares them.

A bucket never lists all of its pairs. One member, the pivot, is paired with the others; the groups that
follow from the links so far are worked out; and only where members other than the pivots so far are still in
different groups the next pivots are paired with members of other groups, sixteen times as many in each round,
until every pair is either verified or within a group. So near copies by the thousand take a pair each, no link
between groups is lost, and groups are exact.

Defined results: null or empty texts and texts without words have an empty set, no links, and their own id as
group; texts with fewer words than a shingle have one shingle, of all of them; rows without an id have no group;
rows that repeat an id are one document that has all of their texts, so their groups are one; an empty table gives no rows. Whole texts
are read, however long: a text takes about ten times its size in one task's memory. Other columns are ignored.
``docs`` should be a scan or a written table: a batch of texts is one unit of the exchange, and must come out
the same if a lost executor's task is run again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shingles import set_classes, shingle_sets
from millrace.plans.graph import connected
from millrace.plans.scratch import write_table

#: Bytes of text whose shingles a range of hashes takes on average, at most; and ranges for each shuffle partition, at least.
_RANGE_BYTES, _RANGES = 32 << 20, 4
#: 64-bit numbers that hold a set's bits.
_BITS = ["bits0", "bits1", "bits2", "bits3"]
#: A token is a shingle's upper 48 bits: shingles that share them count as one in the order, not in the verification.
_DROPPED = np.uint64(16)


def needed(nx: int, ny: int, percent: int) -> int:
    """The least overlap that makes sets of these sizes similar."""
    return -(-percent * (nx + ny) // (100 + percent))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar: the suffix filter's bound on what they don't share, then exactly."""
    need = needed(len(x), len(y), percent)
    if _differ_at_least(x, y, 4) > len(x) + len(y) - 2 * need:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= need


def _differ_at_least(x: np.ndarray, y: np.ndarray, depth: int) -> int:
    """A lower bound of how many elements are in one set only: both are cut at y's middle, again and again."""
    if not depth or len(x) < 2 or len(y) < 2:
        return abs(len(x) - len(y))
    j = len(y) // 2
    i = int(np.searchsorted(x, y[j]))
    return _differ_at_least(x[:i], y[:j], depth - 1) + _differ_at_least(x[i:], y[j:], depth - 1)


# -- document frequencies, and prefixes in their order


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted, non-negative 64-bit integers as their differences, of 32 bits where these suffice."""
    steps = np.diff(values, prepend=0)
    small = len(steps) < 2 or steps[1:].max() < 1 << 32
    return bytes((int(small),)) + values[:1].astype("<i8").tobytes() + steps[1:].astype("<u4" if small else "<u8").tobytes()


def unpack_sorted(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(packed, "<u4" if packed[0] else "<u8", offset=9) if len(packed) > 1 else np.zeros(0, "<u4")
    return np.cumsum(np.concatenate((np.frombuffer(packed, "<i8", 1 if len(packed) > 1 else 0, 1), steps.astype(np.int64))))


#: What a batch tells of its documents (their id, whether they have one, their class's number or -1) and of its classes.
_DOC = np.dtype([("id", "<i8"), ("has", "?"), ("at", "<i4")])
_CLASS = np.dtype([("cls", "<i8"), ("n", "<i4"), ("bits", "<i8", 4)])
#: a, b, c: tokens, the numbers of their classes in the batch, their frequencies; or documents and classes.
_PARTS = "bucket int, batch long, is_docs boolean, a binary, b binary, c binary"


def _part_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, types, strict=True)], names=["bucket", "batch", "is_docs", "a", "b", "c"]
    )


def _prefix_lengths(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def _exchange_tokens(width: int, buckets: int):
    """Per batch: a row for each range of hashes with the tokens in it, and one with the batch's documents and classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            me = (part << 32) + number
            shingles, sizes = shingle_sets(batch.column(1), width)
            cls = set_classes(shingles, sizes)
            full = np.flatnonzero(sizes)
            _, firsts, which = np.unique(cls[full], return_index=True, return_inverse=True)
            docs = np.zeros(len(sizes), _DOC)
            docs["id"] = batch.column(0).fill_null(0).to_numpy()
            docs["has"] = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            docs["at"] = -1
            docs["at"][full] = which
            firsts = full[firsts]  # the first document of each class
            mine = np.full(len(sizes), -1)
            mine[firsts] = np.arange(len(firsts))
            owner = np.repeat(mine, sizes)
            tokens = (shingles[owner >= 0] >> _DROPPED).astype(np.int64)
            owner = owner[owner >= 0].astype("<i4")
            classes = np.zeros(len(firsts), _CLASS)
            classes["cls"], classes["n"] = cls[firsts], sizes[firsts]
            times = np.bincount(owner.astype(np.int64) * 256 + (tokens & 255), minlength=len(firsts) * 256)
            classes["bits"] = np.packbits((times & 1).astype(bool)).view("<i8").reshape(-1, 4)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            bucket = (tokens >> 16) * buckets >> 32
            cuts = np.concatenate((np.flatnonzero(np.diff(bucket, prepend=-1)), [len(bucket)]))
            rows = [(int(bucket[i]), me, False, pack_sorted(tokens[i:j]), owner[i:j].tobytes(), None) for i, j in zip(cuts, cuts[1:], strict=False)]
            yield _part_rows([*rows, (number % buckets, me, True, docs.tobytes(), classes.tobytes(), None)])

    return run


def _count_tokens(group: pa.Table) -> pa.Table:
    """Keeps, of the rows of a range, the tokens that more than one text has, with their frequencies."""
    out, rows = [], group.to_pylist()
    parts = [r for r in rows if not r["is_docs"]]
    found = [unpack_sorted(r["a"]) for r in parts]
    if parts:
        _, which, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        at = 0
        for r, tokens in zip(parts, found, strict=True):
            n = times[which[at : at + len(tokens)]]
            at += len(tokens)
            if (n > 1).any():
                owner = np.frombuffer(r["b"], "<i4")[n > 1]
                out.append((r["bucket"], r["batch"], False, pack_sorted(tokens[n > 1]), owner.tobytes(), n[n > 1].astype("<u4").tobytes()))
    out += [tuple(r.values()) for r in rows if r["is_docs"]]
    return pa.Table.from_batches([_part_rows(out)])


#: A row for each document (doc_id, cls, n), and for each class of a batch whose prefix has tokens that other texts have.
_FOUND = "is_doc boolean, doc_id long, cls long, n int, bits0 long, bits1 long, bits2 long, bits3 long, tokens array<long>, places array<int>"


def _prefixes(percent: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        own = next(r for r in rows if r["is_docs"])
        docs, classes = np.frombuffer(own["a"], _DOC), np.frombuffer(own["b"], _CLASS)
        rows = [r for r in rows if not r["is_docs"]]
        tokens = np.concatenate([np.zeros(0, np.int64), *(unpack_sorted(r["a"]) for r in rows)])
        owner = np.concatenate([np.zeros(0, "<i4"), *(np.frombuffer(r["b"], "<i4") for r in rows)])
        times = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(r["c"], "<u4") for r in rows)])
        order = np.lexsort((tokens, times, owner))
        tokens, owner = tokens[order], owner[order]
        n = classes["n"].astype(np.int64)
        shared = np.bincount(owner, minlength=len(classes))
        rank = np.arange(len(owner)) - (np.cumsum(shared) - shared)[owner]
        places = (n - shared)[owner] + rank  # those that no other text has go before
        kept = places < _prefix_lengths(n, percent)[owner]
        tokens, owner, places = tokens[kept], owner[kept], places[kept]
        has = np.bincount(owner, minlength=len(classes))
        heads = np.flatnonzero(has)
        offsets = np.concatenate((np.zeros(len(docs), np.int64), np.cumsum([0, *has[heads]]))).astype(np.int32)
        none, listed = np.arange(len(docs) + len(heads)) < len(docs), docs["at"] >= 0
        all_cls = np.append(classes["cls"], 0)
        columns = [
            pa.array(none),
            pa.array(np.concatenate((docs["id"], np.zeros(len(heads), np.int64))), mask=np.concatenate((~docs["has"], np.ones(len(heads), bool)))),
            pa.array(np.concatenate((all_cls[docs["at"]], classes["cls"][heads])), mask=np.concatenate((~listed, np.zeros(len(heads), bool)))),
            pa.array(np.concatenate((np.append(classes["n"], 0)[docs["at"]], classes["n"][heads])).astype(np.int32)),
            *(pa.array(np.concatenate((np.zeros(len(docs), np.int64), classes["bits"][heads, k]))) for k in range(4)),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens)),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(places.astype(np.int32))),
        ]
        return pa.table(columns, names=["is_doc", "doc_id", "cls", "n", *_BITS, "tokens", "places"])

    return run


def _files(rows: int, each: int = 100_000) -> int:
    """Files for a table of so many rows: a small one has few, a large one as many as its tasks make."""
    return 3 + rows // each


def _index(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """_FOUND's rows."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(_RANGES * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // _RANGE_BYTES)
    sent = texts.mapInArrow(_exchange_tokens(width, buckets), _PARTS)
    counted = sent.groupBy("bucket").applyInArrow(_count_tokens, _PARTS)
    return write_table(counted.groupBy("batch").applyInArrow(_prefixes(percent), _FOUND), "prefixes", most_files=_files(size, 4 << 20))


# -- pairs


def _set_rows(docs: DataFrame, width: int) -> DataFrame:
    """cls and the sorted set of each of these documents (each class once per batch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles, sizes = shingle_sets(batch.column(1), width)
            cls, at = np.unique(set_classes(shingles, sizes), return_index=True)
            ends = np.cumsum(sizes)
            sets = [shingles[ends[i] - sizes[i] : ends[i]].tobytes() for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(sets, pa.binary())], names=["cls", "shingles"])

    return docs.mapInArrow(run, "cls long, shingles binary")


def _both_sides(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """pairs with the columns of both classes' rows, as a_... and b_...."""
    side = lambda x: table.select(F.col("cls").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in columns])
    return pairs.join(side("b"), "b").join(side("a"), "a")


_PAIR = ["a", "b", "a_label", "b_label"]


def _screen(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Pairs of which the prefixes share as much as they must: if x and y share k shingles, then their first
    |x| - k + m and |y| - k + m ones share m. Shingles that no other text has aren't listed in a prefix; none is shared."""
    rows = _both_sides(pairs, heads, ["n", "tokens"])
    need = F.expr(f"({percent} * (a_n + b_n) + {99 + percent}) div {100 + percent}")
    beyond = lambda n: F.lit(1) - F.expr(f"({percent} * {n} + 99) div 100")  # noqa: E731  the prefix's length less the set's size
    least = F.least(beyond("a_n"), beyond("b_n")) + need
    return rows.filter(F.size(F.array_intersect("a_tokens", "b_tokens")) >= least).select(*_PAIR)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are similar."""
    both = _both_sides(pairs, sets, ["shingles"]).select(*_PAIR, "a_shingles", "b_shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [
                similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
            ]
            yield batch.select([0, 1, 2, 3]).filter(pa.array(linked, pa.bool_()))

    return both.mapInArrow(run, "a long, b long, a_label long, b_label long")


def _candidates(members: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """_PAIR's columns (a < b) of the pairs of a pivot and a later member of another group that length, place and bits let pass.

    The bound by place holds at the first shingle that both sets share. A pair that it turns away at a later
    one is in the bucket of the first one too, and is tried there. A bit that differs
    is a shingle at least that one set has and the other doesn't.
    """
    n, m = F.col("n"), F.col("pivot.n")
    rest = F.least(n - F.col("place"), m - F.col("pivot.place"))
    ok = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * rest >= percent * (n + m))
    apart = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"pivot.{c}"))) for c in _BITS)
    ok &= (100 + percent) * apart <= (100 - percent) * (n + m)
    met = members.join(pivots, "token").filter((F.col("cls") > F.col("pivot.cls")) & (F.col("label") != F.col("pivot.label")) & ok)
    return met.select(F.col("pivot.cls").alias("a"), F.col("cls").alias("b"), F.col("pivot.label").alias("a_label"), F.col("label").alias("b_label")).distinct()


def _key() -> Column:
    # by the class, a hash, so that near copies find the same pivot at most of their shingles
    return F.struct("cls", "n", "place", "label", *_BITS)


def _pivots(members: DataFrame, most: int) -> DataFrame:
    """token and pivot, for the first members of each bucket, at most so many; a hot bucket is ranked in parts first."""
    if most == 1:
        return members.groupBy("token").agg(F.min(_key()).alias("pivot"))
    rows = members.select("token", _key().alias("pivot"))
    part = Window.partitionBy("token", F.pmod("pivot.cls", F.lit(64))).orderBy("pivot")
    few = rows.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= most)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("token").orderBy("pivot")))
    return ranked.filter(F.col("rank") <= most).drop("rank")


def link_groups(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = 2_000_000
) -> DataFrame:
    """doc_id, n_shingles, cls (the class of equal sets, null if empty), component_id for every row.

    component_id is the smallest doc_id that links lead to; a link is a similarity of percent / 100 or more.
    max_broadcast bounds the keys (8 bytes each) in a broadcast; beyond it the same joins shuffle.
    """
    texts = _texts(docs, id_col, text_col)
    found = _index(texts, width, percent)
    rows = found.filter("is_doc").select("doc_id", "cls", F.col("n").cast("long").alias("n_shingles"))
    firsts = rows.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    heads = write_table(found.filter("not is_doc").drop("is_doc", "doc_id").dropDuplicates(["cls"]), "heads", most_files=_files(found.count()))
    own = ["cls", "n", *_BITS]
    left = heads.select(*own, F.explode(F.arrays_zip("tokens", "places")).alias("z"))
    left = left.select(*own, F.col("z.tokens").alias("token"), F.col("z.places").alias("place"), F.col("cls").alias("label"))

    def fetch(pairs: DataFrame, n_close: int, have: list[DataFrame]) -> None:
        """Adds the sets of those classes in pairs that aren't there yet, read from one document of each."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        for table in have:
            wanted = wanted.join(table.select("cls"), "cls", "left_anti")
        ids = write_table(firsts.filter("doc_id is not null").join(wanted, "cls").select("doc_id", "cls"), "wanted", most_files=_files(n_close))
        n_ids = ids.count()
        hint = F.broadcast if n_ids <= max_broadcast else lambda x: x
        chosen = texts.join(hint(ids.select("doc_id").distinct()), "doc_id", "left_semi")
        have.append(write_table(_set_rows(chosen, width).join(hint(ids.select("cls")), "cls", "left_semi").dropDuplicates(["cls"]), "shingles", most_files=_files(n_ids, 10_000)))

    have: list[DataFrame] = []
    tried: list[DataFrame] = []
    labels, most, n_members = _by_id(rows), 1, 10 * heads.count()
    if labels is not None:
        left = left.drop("label").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    while True:
        # what is left: buckets with members of different groups, without the pivots so far
        active = left.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("token")
        members = write_table(left.join(active, "token"), "members", most_files=_files(n_members))
        n_members = members.count()
        if not n_members:
            break
        pivots = write_table(_pivots(members, most), "pivots", most_files=_files(n_members)) if most > 1 else _pivots(members, 1)
        pairs = _candidates(members, pivots, percent)
        if tried:
            pairs = pairs.join(reduce(DataFrame.unionByName, tried), ["a", "b"], "left_anti")
        pairs = write_table(pairs, "pairs", most_files=_files(n_members))
        tried.append(pairs.select("a", "b"))
        last = pivots.groupBy("token").agg(F.max("pivot.cls").alias("last"))
        left = members.join(last, "token").filter("cls > last").drop("last")
        most *= 16
        close = write_table(_screen(pairs, heads, percent), "close", most_files=_files(pairs.count()))
        n_close = close.count()
        if not n_close:
            continue
        fetch(close, n_close, have)
        links = write_table(_verify(close, reduce(DataFrame.unionByName, have), percent), "links", most_files=_files(n_close, 10_000))
        n_links = links.count()
        if not n_links:
            continue
        # only what the new links change is worked out: groups of the groups so far
        new = connected(links.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")), n_links)
        if labels is None:
            labels = new.select(F.col("node").alias("cls"), F.col("group").alias("label"))
        else:
            n_labels = labels.count()
            known = labels.unionByName(new.select(F.col("node").alias("cls"), F.col("node").alias("label"))).distinct()
            joined = known.join(new.withColumnRenamed("node", "label"), "label", "left")
            labels = write_table(joined.select("cls", F.coalesce("group", "label").alias("label")), "labels", most_files=_files(n_labels + 2 * n_links))
        left = left.join(new.withColumnRenamed("node", "label"), "label", "left").withColumn("label", F.coalesce("group", "label")).drop("group")
    if labels is None:
        labels = firsts.limit(0).select("cls", F.col("cls").alias("label"))
    named = firsts.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    groups = named.join(smallest, "label").select("cls", "component_id")
    group = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    linked = rows.filter("cls is not null").join(groups, "cls").select("doc_id", "n_shingles", "cls", group.alias("component_id"))
    return linked.unionByName(rows.filter("cls is null").select("doc_id", "n_shingles", "cls", F.col("doc_id").alias("component_id")))


def _by_id(rows: DataFrame) -> DataFrame | None:
    """cls and label of classes that are linked as rows of one id have them; None if there are none."""
    known = rows.filter("doc_id is not null and cls is not null")
    several = known.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).filter("a != b").select("doc_id", "a")
    links = write_table(known.join(several, "doc_id").filter("cls != a").select("a", F.col("cls").alias("b")).distinct(), "same_id")
    n = links.count()
    return connected(links, n).select(F.col("node").alias("cls"), F.col("group").alias("label")) if n else None


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = 2_000_000) -> DataFrame:
    """docs with one document of each group, that of the smallest id. Rows without an id stay. No column name is reserved."""
    found = link_groups(docs, width, percent, id_col, text_col, max_broadcast)
    gone = write_table(found.filter("component_id != doc_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= max_broadcast else gone
    packed = docs.select(F.struct("*").alias("row"))
    return packed.join(gone, F.col(f"row.`{id_col}`").cast("long") == F.col("gone"), "left_anti").select("row.*")
