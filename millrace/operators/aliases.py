"""Many names at once: which of thousands of aliases texts mention, and how well a list of brands is covered."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import catalog_form
from millrace.functions.urls import host
from millrace.operators.linkage import host_suffixes
from millrace.plans.scratch import write_table

#: The automaton that a Python worker has built last, under its key.
_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(key: str, forms: list[str]) -> ahocorasick.Automaton:
    if key not in _built:
        _built.clear()
        found = ahocorasick.Automaton()
        for form in forms:
            found.add_word(f" {form} ", form)
        found.make_automaton()
        _built[key] = found
    return _built[key]


def mentions(df: DataFrame, id_col: str, text: str, aliases: DataFrame, key: str, alias: str, max_bytes: int = 2 << 20) -> DataFrame:
    """id_col, key, n: how often each text has an alias of each key, as whole words, in catalogue form.

    One automaton of all aliases reads each text once. It is broadcast while the aliases have max_bytes or less; beyond
    it, runs of as many words as some alias has are joined with the aliases. Overlapping mentions all count; null and
    empty texts and aliases mention nothing; aliases that are equal in catalogue form count once for a key.
    """
    known = write_table(aliases.select(F.col(key).alias("key"), catalog_form(F.col(alias).cast("string")).alias("form")).filter("form != ''").distinct(), "aliases")
    rows = df.select(F.col(id_col).alias("id"), catalog_form(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("form")).filter("form != ''")
    forms = known.select("form").distinct()
    size = forms.agg(F.sum(F.octet_length("form"))).first()[0] or 0
    found = _by_automaton(rows, [r.form for r in forms.collect()]) if size <= max_bytes else _by_runs(rows, forms)
    hits = found.join(F.broadcast(known) if size <= max_bytes else known, "form")
    return hits.groupBy("id", "key").agg(F.sum("n").alias("n")).select(F.col("id").alias(id_col), F.col("key").alias(key), "n")


def _by_automaton(rows: DataFrame, forms: list[str]) -> DataFrame:
    shared, own = rows.sparkSession.sparkContext.broadcast(forms), uuid.uuid4().hex
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(own, shared.value)
        for batch in batches:
            at, names, counts = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = Counter(form for _, form in automaton.iter(f" {text} ")) if len(automaton) else {}
                at += [i] * len(found)
                names += found.keys()
                counts += found.values()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["id", "form", "n"])

    return rows.mapInArrow(run, f"id {kind.simpleString()}, form string, n long")


def _by_runs(rows: DataFrame, forms: DataFrame) -> DataFrame:
    sizes = forms.select(F.size(F.split("form", " ")).alias("size")).distinct()
    words = rows.select("id", F.split("form", " ").alias("words")).join(F.broadcast(sizes), F.size("words") >= F.col("size"))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)
    runs = words.select("id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.col("size")), " "))).alias("form"))
    return runs.groupBy("id", "form").agg(F.count("*").alias("n")).join(forms, "form", "left_semi")


def brand_coverage(brands: DataFrame, key: str, aliases: DataFrame, alias: str, domains: DataFrame, domain: str, shops: DataFrame, shop_id: str, name: str, url: str, cards: DataFrame, active: Column, verified: Column) -> DataFrame:
    """key, shops, cards, active, classification of every brand: whether a shop has its name or is on its domain, and what that shop sells.

    A shop is a brand's if its name is one of the brand's aliases, in catalogue form, or its host is one of the brand's
    domains or below one. cards refer to shops by the column shop_id. Both matches are equal joins.
    """
    named = aliases.select(key, catalog_form(F.col(alias)).alias("_form")).filter("_form != ''")
    by_name = shops.select(shop_id, catalog_form(F.col(name)).alias("_form")).join(named, "_form").select(key, shop_id)
    sites = domains.select(key, F.lower(domain).alias("_site")).filter("_site != ''")
    hosts = shops.select(shop_id, host(F.col(url)).alias("_host")).filter("_host is not null and _host != ''")
    by_site = hosts.select(shop_id, F.explode(host_suffixes(F.col("_host"))).alias("_site")).join(sites, "_site").select(key, shop_id)
    matched = by_name.union(by_site).distinct()
    sold = cards.groupBy(shop_id).agg(F.count("*").alias("cards"), F.count_if(active).alias("active"), F.count_if(active & verified).alias("verified"))
    totals = matched.join(sold, shop_id, "left").groupBy(key).agg(F.count("*").alias("shops"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("cards", "active", "verified")])
    rows = brands.select(key).distinct().join(totals, key, "left").fillna(0, ["shops", "cards", "active", "verified"])
    best = F.when(F.col("verified") > 0, "ACTIVE_VERIFIED_CARD_PRESENT").when(F.col("active") > 0, "ACTIVE_CARD_PRESENT").when(F.col("shops") > 0, "MERCHANT_ONLY").otherwise("MISSING_MERCHANT")
    return rows.select(key, "shops", "cards", "active", best.alias("classification"))
