"""Event capture as Structured Streaming: views that count once per window, and clicks that a person made."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _as_text(key: Column, kind: str) -> Column:
    """A key as text, null as null, so that tasks can compare keys of any simple type; _from_text() gives it back unchanged."""
    if kind == "binary":
        return F.hex(key)
    if kind == "timestamp":
        return F.unix_micros(key).cast("string")
    return (key + F.lit(0).cast(kind) if kind in ("float", "double") else key).cast("string")  # no negative zero


def _from_text(text: Column, kind: str) -> Column:
    if kind == "binary":
        return F.unhex(text)
    return F.timestamp_micros(text.cast("long")) if kind == "timestamp" else text.cast(kind)


def accept_views(stream: DataFrame, keys: list[str], at: str, window_seconds: int = 1800, late: str = "10 minutes", groups: int = 4096) -> DataFrame:
    """keys and at of the views that count: those without an accepted one of their key in the window before.

    The state is the last accepted time of a key and goes once the watermark has passed its window. Within a
    batch a key's views are folded in the order of their times; a view that is older than the last accepted one
    counts for nothing. Null keys are one key. Keys are of simple types, and views without a time count for nothing.

    Keys are dealt by hash into so many groups, and a group's keys share one row of state, so that Python is called
    for each group of a batch, not for each key. A checkpoint holds for the number of groups that it began with; a
    task holds one group's keys and its views of one batch at a time.
    """
    kinds = {k: stream.schema[k].dataType.simpleString() for k in keys}
    names = [f"_key{n}" for n in range(len(keys))]

    def fold(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = {tuple(key): t for *key, t in json.loads(state.get[0])} if state.exists else {}
        views = pd.concat(list(frames)).sort_values("_micros")
        kept = []
        for *parts, t in zip(*[views[c].tolist() for c in [*names, "_micros"]], strict=True):
            before = last.get(key := tuple(parts))
            if before is None or t - before > window_seconds * 1_000_000:
                kept.append((*key, t))
                last[key] = t
        ends = {key: t // 1000 + window_seconds * 1000 for key, t in last.items()}
        now = state.getCurrentWatermarkMs()
        state.update((json.dumps([[*key, t] for key, t in last.items() if ends[key] >= now]),))
        state.setTimeoutTimestamp(max(now + 1, *ends.values()))
        if kept:
            yield pd.DataFrame(kept, columns=[*names, "_micros"])

    texts = [_as_text(F.col(f"`{k}`"), kind).alias(n) for n, (k, kind) in zip(names, kinds.items(), strict=True)]
    rows = stream.withWatermark(at, late).filter(F.col(f"`{at}`").isNotNull()).select(f"`{at}`", F.unix_micros(f"`{at}`").alias("_micros"), *texts)
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64(*names), F.lit(groups)))
    fields = ", ".join(f"{n} string" for n in names)
    kept = dealt.groupBy("_group").applyInPandasWithState(fold, f"{fields}, _micros long", "last string", "append", GroupStateTimeout.EventTimeTimeout)
    back = [_from_text(F.col(n), kind).alias(k) for n, (k, kind) in zip(names, kinds.items(), strict=True)]
    return kept.select(*back, F.timestamp_micros("_micros").alias(at))


def human_clicks(stream: DataFrame, method: Column, purpose: Column) -> DataFrame:
    """Clicks that aren't HEAD requests, prefetches or prerenders."""
    fetched = F.rlike(F.lower(F.coalesce(purpose, F.lit(""))), F.lit("prefetch|prerender"))
    return stream.filter((F.upper(F.coalesce(method, F.lit("GET"))) != "HEAD") & ~fetched)


def only_active(stream: DataFrame, parents: DataFrame, fk: str, key: str) -> DataFrame:
    """Events whose parent is in a static frame of active ones; others are dropped without a word."""
    active = parents.select(F.col(key).alias("_active")).distinct()
    return stream.join(active, F.col(fk) == F.col("_active"), "left_semi")


def window_counts(stream: DataFrame, at: str, by: list[str], window: str, late: str) -> DataFrame:
    """Rows by event-time window, once the watermark has passed it."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), *by).agg(F.count("*").alias("n"))
