"""Analytic read models: rollups, periods, series, funnels, facets, duplicates."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numbers import change, in_window, percent
from millrace.functions.urls import is_public_http
from millrace.operators.rank import first_per_key


def rollup_with_unknown(counts: DataFrame, n: str, dims: dict[str, tuple[DataFrame, str, str]], unknown: str = "unknown") -> DataFrame:
    """dimension, id, n: the counts by each dimension, ``unknown`` where the key is null or names no row.

    dims: the dimension's name, with its frame, its key in the counts, and that key's name in the frame. All
    dimensions are one pass over the counts: joined first, then summed over grouping sets by one shuffle.
    """
    joined = counts
    for name, (frame, key, other) in dims.items():
        known = frame.select(F.col(other).alias(f"_{name}")).distinct()
        joined = joined.join(known, F.col(key) == F.col(f"_{name}"), "left")
        joined = joined.withColumn(f"_{name}", F.coalesce(F.col(f"_{name}").cast("string"), F.lit(unknown)))
    entries = F.array(*[F.struct(F.lit(name).alias("dimension"), F.col(f"_{name}").alias("id")) for name in dims])
    return joined.select(F.explode(entries).alias("e"), n).groupBy("e.dimension", "e.id").agg(F.sum(n).alias("n"))


def weighted_sum(df: DataFrame, key: str, weights: dict[str, float], name: str) -> DataFrame:
    """One row: the sum of each row's weight (keys without one count 0), and twelve times that."""
    table = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, w)])
    total = F.coalesce(F.sum(F.coalesce(F.element_at(table, F.col(key)), F.lit(0))), F.lit(0))
    return df.agg(total.alias(name), (total * 12).alias(f"{name}_yearly"))


def funnel(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """One row: how many rows reach each step, and the percentage of the step before (0 if that has none)."""
    row = df.agg(*[F.count_if(c).alias(name) for name, c in steps.items()])
    names = list(steps)
    return row.select("*", *[percent(F.col(b), F.col(a)).alias(f"{b}_of_{a}") for a, b in zip(names, names[1:], strict=False)])


def top_values(df: DataFrame, raw: str, at: str, flag: Column, k: int) -> DataFrame:
    """Values by trimmed lower case: the newest spelling, rows, flagged rows; the k most frequent. Blank ones are left out."""
    key = F.lower(F.trim(F.col(raw)))
    groups = df.filter(key != "").groupBy(key.alias("value_key"))
    counted = groups.agg(F.max_by(raw, at).alias("label"), F.count("*").alias("n"), F.count_if(flag).alias("flagged"))
    return counted.orderBy(F.desc("n"), F.desc("flagged"), "value_key").limit(k)


def period_over_period(df: DataFrame, at: str, now: datetime, days: list[int]) -> DataFrame:
    """days, current, previous, change for the windows of each length before now, all in one pass."""
    ends = [F.lit(now - timedelta(days=d)) for d in [0]]
    windows = [(d, F.lit(now - timedelta(days=d)), F.lit(now - timedelta(days=2 * d))) for d in days]
    column = F.col(at)
    sums = [F.count_if(in_window(column, start, ends[0])).alias(f"c{d}") for d, start, _ in windows]
    sums += [F.count_if(in_window(column, before, start)).alias(f"p{d}") for d, start, before in windows]
    first = F.lit(now - timedelta(days=2 * max(days)))
    row = df.filter(in_window(column, first, ends[0])).agg(*sums)
    parts = F.array(*[F.struct(F.lit(d).alias("days"), F.col(f"c{d}").alias("current"), F.col(f"p{d}").alias("previous")) for d in days])
    return row.select(F.inline(parts)).withColumn("change", change(F.col("current"), F.col("previous")))


def daily_series(df: DataFrame, at: str, now: datetime, days: int, measures: dict[str, Column]) -> DataFrame:
    """day and the measures' counts for each of the last days, zero where there is nothing."""
    first = now.date() - timedelta(days=days - 1)
    spark = df.sparkSession
    spine = spark.range(days).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))
    recent = df.filter((F.col(at) >= F.lit(datetime.combine(first, datetime.min.time()))) & (F.col(at) < F.lit(datetime.combine(now.date() + timedelta(days=1), datetime.min.time()))))
    counts = recent.groupBy(F.to_date(at).alias("day")).agg(*[F.count_if(c).alias(n) for n, c in measures.items()])
    return spine.join(F.broadcast(counts), "day", "left").fillna(0, list(measures))


def two_streams(df: DataFrame, key: str, first: Column, second: Column, names: tuple[str, str], k: int) -> DataFrame:
    """The k keys with most rows of the second kind, then of the first, in one pass over rows of both kinds."""
    a, b = names
    both = df.filter(first | second).groupBy(key).agg(F.count_if(first).alias(a), F.count_if(second).alias(b))
    return both.orderBy(F.desc(b), F.desc(a), key).limit(k)


def labelled_counts(df: DataFrame, column: str, default: str, k: int | None = None) -> DataFrame:
    """label, n: rows by a text column, null and blank under a default label; the k most frequent."""
    label = F.coalesce(F.when(F.trim(column) != "", F.trim(column)), F.lit(default))
    out = df.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "label").limit(k) if k else out


def bucket_counts(df: DataFrame, bucket: Column, buckets: list[str]) -> DataFrame:
    """bucket, n for every declared bucket, zero where there is nothing."""
    declared = df.sparkSession.createDataFrame([(b,) for b in buckets], "bucket string")
    return declared.join(df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")), "bucket", "left").fillna(0, ["n"])


def facet_counts(df: DataFrame, facet: Column, entity: str) -> DataFrame:
    """facet, n: distinct entities of each facet value."""
    return df.select(facet.alias("facet"), entity).filter("facet is not null and facet != ''").groupBy("facet").agg(F.countDistinct(entity).alias("n"))


def duplicate_values(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).filter("n > 1")


def collected(df: DataFrame, key: str, columns: dict[str, Column], most: int | None = None) -> DataFrame:
    """Distinct values of each group as sorted text lists joined by `` | ``.

    A group's list is as long as its distinct values; ``most`` keeps the first of them in order where a report
    wants a top of the list.
    """
    def listed(c: Column) -> Column:
        values = F.array_sort(F.collect_set(c.cast("string")))
        return F.array_join(F.slice(values, 1, most) if most else values, " | ")

    return df.groupBy(key).agg(F.count("*").alias("n"), *[listed(c).alias(n) for n, c in columns.items()])


def click_through(df: DataFrame, by: list[str], shown: str, clicked: str) -> DataFrame:
    """by, shown, clicked, ctr (percent, two digits), share of all clicks (percent, one digit)."""
    groups = df.groupBy(*by).agg(F.sum(shown).alias("shown"), F.sum(clicked).alias("clicked"))
    total = groups.agg(F.sum("clicked").alias("_total"))
    return groups.join(F.broadcast(total)).select(*by, "shown", "clicked", percent(F.col("clicked"), F.col("shown"), 2).alias("ctr"), percent(F.col("clicked"), F.col("_total")).alias("share"))


def reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one frame has more often than the other, with ``side``: none if they match exactly."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def union_entities(parts: list[DataFrame]) -> DataFrame:
    """Frames of different columns as one, absent ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def owner_profiles(cards: DataFrame, owner: str, id_col: str, verified: Column, url: str, topics: DataFrame) -> DataFrame:
    """owner, verified_count, official_count (verified cards with a public URL that no card before has), topics (distinct).

    topics: owner and slug of what the owner's cards are about, one row for each card and topic.
    """
    shown = cards.filter(verified & is_public_http(F.col(url)))
    official = first_per_key(shown, [owner, url], [F.col(id_col)]).groupBy(owner).agg(F.count("*").alias("official_count"))
    counts = cards.groupBy(owner).agg(F.count_if(verified).alias("verified_count"))
    about = topics.select(owner, "slug").distinct().groupBy(owner).agg(F.count("*").alias("topics"))
    return counts.join(official, owner, "left").join(about, owner, "left").fillna(0, ["official_count", "topics"])


def media_summary(cards: DataFrame, media: DataFrame, key: str, alt: str) -> DataFrame:
    """media_count, with_media, missing_media, missing_alt (cards with media, none of which has a text) in one row."""
    by_card = media.groupBy(key).agg(F.count("*").alias("_n"), F.count_if(F.coalesce(alt, F.lit("")) != "").alias("_alt"))
    has = F.col("_n").isNotNull()
    found = cards.join(by_card, key, "left").agg(F.count_if(has).alias("with_media"), F.count_if(~has).alias("missing_media"), F.count_if(has & (F.col("_alt") == 0)).alias("missing_alt"))
    return found.join(F.broadcast(media.agg(F.count("*").alias("media_count")))).select("media_count", "with_media", "missing_media", "missing_alt")


def remediation_queues(df: DataFrame, id_col: str, queues: list[tuple[str, Column]]) -> DataFrame:
    """queue, id_col: a row for each queue whose condition a row meets; queues may overlap."""
    named = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in queues]))
    return df.select(F.explode(named).alias("queue"), id_col)
