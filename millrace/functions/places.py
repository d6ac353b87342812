"""Addresses, localities and names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import catalog_form, fold, squeeze


def postal_code(text: Column) -> Column:
    """The first five-digit code (``123 45`` or ``12345``), without the space; '' if there is none."""
    return F.replace(F.regexp_extract(text, r"(?<!\d)(\d{3}\s?\d{2})(?!\d)", 1), F.lit(" "), F.lit(""))


def street_numbers(text: Column) -> Column:
    """Numbers of one to three digits, with a letter or a range, that aren't part of a longer one or of a postal code."""
    rest = F.regexp_replace(text, r"(?<!\d)\d{3}\s?\d{2}(?!\d)", " ")
    return F.regexp_extract_all(rest, F.lit(r"(?<![\d-])(\d{1,3}(?:-\d{1,3})?[A-Za-zΑ-Ω]?)(?![\d-])"), 1)


def number_near_postal(text: Column, before: int = 90, without: int = 140) -> Column:
    """The street number (1 to 499, with a letter perhaps) nearest before a text's first postal code, at most ``before``
    characters away; without a code the last one in its first ``without`` characters; '' if there is none."""
    clean = squeeze(F.coalesce(text, F.lit("")))
    at = F.regexp_instr(clean, F.lit(r"\b\d{3}\s?\d{2}\b"))
    start = F.greatest(at - before, F.lit(1))
    stretch = F.when(at > 0, F.substr(clean, start, at - start)).otherwise(F.left(clean, F.lit(without)))
    found = F.regexp_extract_all(stretch, F.lit(r"(?U)\b([0-9]{1,3}[A-Za-zΑ-Ωα-ω]?)\b"), 1)
    fitting = F.filter(found, lambda x: F.regexp_extract(x, r"^\d+", 0).cast("int").between(1, 499))
    return F.when(F.size(fitting) > 0, F.element_at(fitting, -1)).otherwise("")


def locality(text: Column, aliases: list[tuple[str, str]]) -> Column:
    """The place of the first alias, in the list's order, that a text contains as a word; null if none."""
    words = catalog_form(text)
    out = F.lit(None).cast("string")
    for alias, place in reversed(aliases):
        inside = F.concat(F.lit(" "), words, F.lit(" "))
        out = F.when(F.contains(inside, F.concat(F.lit(" "), catalog_form(F.lit(alias)), F.lit(" "))), F.lit(place)).otherwise(out)
    return out


def region_label(*parts: Column, aliases: dict[str, str] | None = None) -> Column:
    """The first part that isn't blank, by its name in the alias map if it is there."""
    first = F.coalesce(*[F.when(F.trim(p) != "", squeeze(p)) for p in parts])
    if not aliases:
        return first
    table = F.create_map(*[F.lit(x) for k, v in aliases.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(table, fold(first)), first)


def valid_name(name: Column, reserved: list[str], words: list[str], shortest: int = 2, longest: int = 60) -> Column:
    """Whether a name has a fitting length, isn't reserved, and holds more than generic words."""
    plain = squeeze(fold(F.coalesce(name, F.lit(""))))
    rest = F.filter(F.split(plain, " "), lambda w: (w != "") & ~w.isin(words))
    return F.length(plain).between(shortest, longest) & ~plain.isin(reserved) & (F.size(rest) > 0)


def address_chunks(text: Column, markers: str, most: int = 20, longest: int = 420) -> Column:
    """Stretches of a text before marker words that hold a postal code or a number, the first ``most`` of them."""
    chunks = F.transform(F.split(text, rf"(?i)(?=\b(?:{markers})\b)"), lambda c: squeeze(c))
    fitting = F.filter(chunks, lambda c: (F.length(c) <= longest) & F.rlike(c, F.lit(r"\d")))
    return F.slice(fitting, 1, most)
