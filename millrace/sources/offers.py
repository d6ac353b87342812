"""Names and prices that pages give in JSON-LD, by a table function that is joined laterally to the pages' blocks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.numbers import parse_number

# Keys of names and prices, and how currencies are written, in the order in which they are tried.
NAME_KEYS = ["name", "headline"]
PRICE_KEYS = ["price", "lowPrice", "highPrice", "minPrice", "maxPrice"]
CURRENCIES = {
    "GBP": r"£|\bgbp\b",
    "CHF": r"\bchf\b",
    "USD": r"\busd\b|\$",
    "EUR": r"€|\beur(?:o)?s?\b|ευρώ|ευρω|\d\s*[eε]\b",
}


def offers_function(currencies: dict[str, str] = CURRENCIES):
    """A table function of a JSON text: kind (name or price), source, value (as it stands), currency; nothing of bad JSON.

    An object's currency is that of its own priceCurrency, if that can be read, else that of the object around it.
    Objects and lists may be nested as deep as JSON can be read.
    """
    compiled = {name: re.compile(pattern, re.I) for name, pattern in currencies.items()}

    @F.udtf(returnType="kind string, source string, value string, currency string")
    class Offers:
        def eval(self, block: str):
            try:
                todo = [(json.loads(block), None)]
            except (TypeError, ValueError, RecursionError):
                return
            while todo:
                node, around = todo.pop()
                if isinstance(node, list):
                    todo += [(x, around) for x in reversed(node)]
                if not isinstance(node, dict):
                    continue
                stated = node.get("priceCurrency")
                own = next((c for c, p in compiled.items() if isinstance(stated, str) and p.search(stated)), None) or around
                yield from ((("name", k, node[k], own)) for k in NAME_KEYS if isinstance(node.get(k), str))
                yield from (("price", f"JSONLD_{k.upper()}", value, own) for k in PRICE_KEYS for value in _as_text(node.get(k)))
                todo += [(x, own) for x in reversed(node.values())]

    return Offers


def _as_text(value) -> Iterator[str]:
    """A price as text: a number that isn't negative, or a text's digits and marks."""
    if isinstance(value, bool) or not isinstance(value, int | float | str):
        return
    if isinstance(value, str):
        yield re.sub(r"[^\d.,]", "", value)
    elif value >= 0:
        yield str(int(value)) if value == int(value) else repr(value)


def json_ld_blocks(html):
    """The texts of a page's JSON-LD blocks, read or not."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)


def page_offers(pages: DataFrame, id_col: str, html: str, least: float = 5, most: float = 10_000, currencies: dict[str, str] = CURRENCIES) -> DataFrame:
    """id_col, kind, source, name, amount, currency: each name and each price (from least to most) in a page's JSON-LD."""
    blocks = pages.select(F.col(id_col), F.explode(json_ld_blocks(F.col(html))).alias("_block"))
    found = blocks.lateralJoin(offers_function(currencies)(F.col("_block").outer()))
    amount = F.when(F.col("kind") == "price", parse_number(F.col("value")))
    name = F.when(F.col("kind") == "name", F.trim(F.regexp_replace("value", r"\s+", " ")))
    rows = found.select(F.col(id_col), "kind", "source", name.alias("name"), amount.alias("amount"), F.when(F.col("kind") == "price", F.col("currency")).alias("currency"))
    return rows.filter((F.col("name") != "") | F.col("amount").between(least, most))
