"""Operators over the order of rows: latest, keepers, margins, hash changes, spaced selection, accepted views, merges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def latest_per_key(df: DataFrame, keys: list[str], at: str, *, columns: list[str]) -> DataFrame:
    """Of each key the columns of its latest row, by aggregation: partial maxima are made before the shuffle."""
    best = df.groupBy(*keys).agg(F.max(F.struct(at, *columns)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in [at, *columns]])


def keepers(df: DataFrame, keys: list[str], order: list[Column], id_col: str) -> DataFrame:
    """Marks each key's first row as ``keep`` and gives every row the ``keep_id`` of its key."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.select("*", (F.row_number().over(window) == 1).alias("keep"), F.first(id_col).over(window).alias("keep_id"))


def winner_margin(df: DataFrame, key: str, candidate: str, score: str, least: float, margin: float) -> DataFrame:
    """key, winner, top, second, decided: whether the top score is high enough and far enough above the next one.

    Only two rows of a key are kept from each task on.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), F.desc(candidate)))
    two = df.select(key, candidate, score, rank.alias("_rank")).filter("_rank <= 2")
    of = lambda c, n: F.max(F.when(F.col("_rank") == n, F.col(c)))
    top = two.groupBy(key).agg(of(candidate, 1).alias("winner"), of(score, 1).alias("top"), F.coalesce(of(score, 2), F.lit(0)).alias("second"))
    return top.select("*", ((F.col("top") >= least) & (F.col("top") - F.col("second") >= margin)).alias("decided"))


def hash_changes(df: DataFrame, key: str, at: str, digest: str) -> DataFrame:
    """Adds ``state``: NEW, SAME or CHANGED against the key's row before, whatever that one was."""
    before = F.lag(digest).over(Window.partitionBy(key).orderBy(at))
    first = F.row_number().over(Window.partitionBy(key).orderBy(at)) == 1
    return df.withColumn("state", F.when(first | before.isNull(), "NEW").when(before == F.col(digest), "SAME").otherwise("CHANGED"))


def fetch_stability(df: DataFrame, key: str, at: str, kind: str, gap_seconds: int, required: int = 3, consider: int = 12) -> DataFrame:
    """key, stable, reason and count: whether a key's newest observations, spaced_selection()'s way, are of one kind.

    NOT_ENOUGH_OBSERVATIONS with how many there are, SPACING_NOT_MET with how many are far enough apart, else STABLE or
    UNSTABLE_FETCH. Of observations at one time, the least kind counts as the newest.
    """
    newest = first_k(df, key, [F.col(at).desc(), F.col(kind)], consider).withColumn("_at", F.unix_micros(F.col(at).cast("timestamp")))
    seen = F.array_sort(F.collect_list(F.struct((-F.col("_at")).alias("t"), F.col(kind).alias("kind"))))  # ``consider`` at most
    kept = F.aggregate(
        "_seen",
        F.array().cast(f"array<struct<t:bigint,kind:{df.schema[kind].dataType.simpleString()}>>"),
        lambda acc, x: F.when((F.size(acc) == 0) | ((F.size(acc) < required) & (x["t"] - F.element_at(acc, -1)["t"] >= gap_seconds * 1_000_000)), F.array_append(acc, x)).otherwise(acc),
    )
    rows = newest.groupBy(key).agg(seen.alias("_seen")).select(key, F.size("_seen").alias("_n"), kept.alias("_kept"))
    kinds = F.size(F.array_distinct(F.transform("_kept", lambda x: x["kind"])))
    few, close = F.col("_n") < required, F.size("_kept") < required
    reason = F.when(few, "NOT_ENOUGH_OBSERVATIONS").when(close, "SPACING_NOT_MET").when(kinds == 1, "STABLE").otherwise("UNSTABLE_FETCH")
    return rows.select(key, (reason == "STABLE").alias("stable"), reason.alias("reason"), F.when(few, F.col("_n")).otherwise(F.size("_kept")).alias("count"))


def spaced_selection(df: DataFrame, key: str, at: str, gap_seconds: int, most: int = 3, consider: int = 12) -> DataFrame:
    """key and ``kept``: newest first, times of a key at least gap_seconds older than the one kept before, up to ``most``.

    Only the newest ``consider`` rows of a key count, so what is gathered of a key is bounded.
    """
    newest = first_k(df, key, [F.col(at).desc()], consider)
    times = F.sort_array(F.collect_list(at), asc=False)
    kept = F.aggregate(
        "_times",
        F.array().cast("array<timestamp>"),
        lambda acc, t: F.when(
            (F.size(acc) == 0) | ((F.size(acc) < most) & (F.unix_micros(F.element_at(acc, -1)) - F.unix_micros(t) >= gap_seconds * 1_000_000)),
            F.array_append(acc, t),
        ).otherwise(acc),
    )
    return newest.withColumn(at, F.col(at).cast("timestamp")).groupBy(key).agg(times.alias("_times")).select(key, kept.alias("kept"))


def first_k(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def numbered_slugs(df: DataFrame, slug: str, order: list[Column], taken: DataFrame | None = None) -> DataFrame:
    """Adds ``unique_slug``: the slug for its first row (if it isn't taken), else the slug with the least free number from 2 on.

    A number isn't free if the slug with it is taken, or is the slug of any row. So no two rows get one slug.
    """
    names = df.select(F.col(slug).alias("_name"))
    if taken is not None:
        gone = taken.select(F.col(slug).alias("_name")).distinct()
        names = names.unionByName(gone)
    used = names.distinct().select(F.regexp_extract("_name", "^(.*)-([1-9][0-9]{0,8})$", 1).alias(slug), F.regexp_extract("_name", "^(.*)-([1-9][0-9]{0,8})$", 2).try_cast("bigint").alias("_n"))
    used = used.filter("_n >= 2").join(df.select(slug).distinct(), slug, "left_semi")
    # the j-th used number u has u - j - 1 free ones below it; the r-th row that needs a number passes those with fewer than r
    passed = F.col("_n") - F.row_number().over(Window.partitionBy(slug).orderBy("_n")) - 1
    used = used.select(slug, passed.cast("double").alias("_at"))
    rank = F.row_number().over(Window.partitionBy(slug).orderBy(*order))
    rows = df.select(F.struct("*").alias("_row"), F.col(slug), rank.alias("_rank"))
    if taken is not None:
        rows = rows.join(gone.select(F.col("_name").alias(slug), F.lit(1).alias("_taken")), slug, "left")
        rows = rows.withColumn("_rank", F.col("_rank") + F.coalesce("_taken", F.lit(0))).drop("_taken")
    needs = (F.col("_rank") - 1).cast("double")
    both = rows.select(slug, "_row", "_rank", needs.alias("_at")).unionByName(used.select(slug, (F.col("_at") + 0.5).alias("_at")), allowMissingColumns=True)
    skipped = F.count_if(F.col("_row").isNull()).over(Window.partitionBy(slug).orderBy("_at").rangeBetween(Window.unboundedPreceding, 0))
    number = F.col("_rank") + skipped
    named = both.withColumn("_number", number).filter("_row is not null")
    return named.select("_row.*", F.when(F.col("_rank") == 1, F.col(slug)).otherwise(F.concat_ws("-", slug, F.col("_number").cast("string"))).alias("unique_slug"))


def merge_ranked(preferred: DataFrame, fallback: DataFrame, id_col: str, owner: str, rank: str, most: int) -> DataFrame:
    """Two ranked lists as one: first at most one row per owner, then other rows, no id twice, ``most`` rows."""
    both = preferred.withColumn("_list", F.lit(0)).unionByName(fallback.withColumn("_list", F.lit(1)))
    once = first_per_key(both, [id_col], [F.col("_list"), F.col(rank)])
    turn = F.row_number().over(Window.partitionBy(owner).orderBy("_list", rank))
    out = once.withColumn("_turn", (turn > 1).cast("int")).orderBy("_turn", "_list", rank, id_col).limit(most)
    return out.drop("_turn", "_list")


def accepted(df: DataFrame, keys: list[str], at: str, id_col: str, window_seconds: int) -> DataFrame:
    """The rows that count: those without an accepted one of their (null-safe) key in the window before, bounds included.

    The window starts at the last *accepted* row, so this is neither a tumbling nor a session window. Keys are
    dealt to tasks and sorted there; a task walks through its rows batch by batch and holds one time, however many
    rows a key has.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.to_json(F.struct(*keys)).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(id_col).alias("id"))
    rows = rows.filter("at is not null").repartition("key").sortWithinPartitions("key", "at", "id")
    gap = window_seconds * 1_000_000

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            kept = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = k != key or t - last > gap
                if counts:
                    key, last = k, t
                kept.append(counts)
            yield batch.select([2]).filter(pa.array(kept, pa.bool_()))

    ids = rows.mapInArrow(walk, f"id {kind}").withColumnRenamed("id", id_col)
    return df.join(ids, id_col, "left_semi")
